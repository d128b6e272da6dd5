"""EPUB canonical fragment identifiers: values, grammar, order.

A CFI is a point (one path) or a range (a parent path and two local ones). Paths are steps with an
optional terminal offset. The text form is read with one regular expression per token kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

MAX_LENGTH = 65536
_SPECIAL = r"\^\[\](),;="
_VALUE = rf"(?:\^[{_SPECIAL}]|[^{_SPECIAL}])+"
_PARAMETER = rf";{_VALUE}={_VALUE}(?:,{_VALUE})*"
_ASSERTION = rf"\[(?:{_VALUE}(?:,{_VALUE})?|,{_VALUE})?(?:{_PARAMETER})*\]"
_INTEGER = r"(?:0|[1-9][0-9]{0,14})(?![0-9])"
_NUMBER = rf"{_INTEGER}(?:\.[0-9]{{0,19}}[1-9](?![0-9]))?"
_STEP = re.compile(rf"(?P<far>!?)/(?P<index>{_INTEGER})(?P<note>{_ASSERTION})?")
_CHARACTER = re.compile(rf"(?P<far>!?):(?P<at>{_INTEGER})(?P<note>{_ASSERTION})?")
_MEDIA = re.compile(rf"(?P<far>!?)(?=[~@])(?:~(?P<seconds>{_NUMBER}))?(?:@(?P<x>{_NUMBER}):(?P<y>{_NUMBER}))?(?P<note>{_ASSERTION})?")

Parameters = tuple[tuple[str, tuple[str, ...]], ...]


class CfiError(ValueError):
    """`at` is the offset where reading stopped, when a text was read."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message)
        self.at = at


def _check_parameters(parameters: Parameters) -> None:
    names = [n for n, _ in parameters]
    if len(set(names)) < len(names) or any(not n or " " in n or not v or not all(v) for n, v in parameters):
        raise CfiError("parameters need distinct names without spaces, and values")


@dataclass(frozen=True)
class Step:
    index: int
    id: str | None = None
    parameters: Parameters = ()
    far: bool = False  # follows an indirection

    def __post_init__(self):
        if self.index < 0 or self.id == "":
            raise CfiError("a step has a non-negative index and no empty id")
        _check_parameters(self.parameters)


@dataclass(frozen=True)
class Offset:
    """A character offset (at, before, after) or a place in media (seconds and/or x, y)."""

    at: int | None = None
    before: str | None = None
    after: str | None = None
    seconds: float | None = None
    x: float | None = None
    y: float | None = None
    parameters: Parameters = ()
    far: bool = False

    def __post_init__(self):
        media = (self.seconds, self.x, self.y)
        if self.at is None:
            if media == (None, None, None) or (self.x is None) != (self.y is None):
                raise CfiError("a media offset has a time, or both coordinates")
            if self.seconds is not None and not 0 <= self.seconds < 1e15:
                raise CfiError("a time is finite and not negative")
            if self.x is not None and not (0 <= self.x <= 100 and 0 <= self.y <= 100):
                raise CfiError("coordinates are percentages")
        if (self.at or 0) < 0 or "" in (self.before, self.after):
            raise CfiError("an offset is not negative, and its text is not empty")
        _check_parameters(self.parameters)


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...] = ()
    offset: Offset | None = None

    def __post_init__(self):
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            if a.index % 2 and not b.far:
                raise CfiError("character data has no children")

    def join(self, local: Path) -> Path:
        if self.offset:
            raise CfiError("a path that ends with an offset can't go on")
        return Path(self.steps + local.steps, local.offset)


@dataclass(frozen=True)
class Cfi:
    path: Path
    start: Path | None = None
    end: Path | None = None

    def __post_init__(self):
        if not self.path.steps or self.path.steps[0].far:
            raise CfiError("a path starts with a direct step")
        if self.start is not None:
            if self.path.offset:
                raise CfiError("the parent of a range ends with a step")
            if sort_key(self.start_path) > sort_key(self.end_path):
                raise CfiError("a range does not end before it starts")

    @property
    def is_range(self) -> bool:
        return self.start is not None

    @property
    def start_path(self) -> Path:
        return self.path if self.start is None else self.path.join(self.start)

    @property
    def end_path(self) -> Path:
        return self.path if self.end is None else self.path.join(self.end)

    def first(self) -> Cfi:
        return Cfi(self.start_path)

    def last(self) -> Cfi:
        return Cfi(self.end_path)

    def keys(self) -> tuple[list, list]:
        return sort_key(self.start_path), sort_key(self.end_path)

    def contains(self, other: Cfi) -> bool:
        (a, b), (c, d) = self.keys(), other.keys()
        return a <= c and d <= b

    def __str__(self) -> str:
        return f"epubcfi({expression(self)})"


def side_bias(parameters: Parameters) -> str | None:
    return {("a",): "after", ("b",): "before"}.get(dict(parameters).get("s", ()))


# --- order -----------------------------------------------------------------------------------

# Ranks of the specification; a path's end (no entry) sorts before all of them.
_CHARACTER_RANK, _CHILD_RANK, _MEDIA_RANK, _FAR_RANK = 1, 2, 3, 4


def sort_key(path: Path) -> list[tuple[int, float, float, float]]:
    """Lists that compare as paths do: assertions don't count, what is absent comes first."""
    none = (-1.0, -1.0)
    out: list[tuple[int, float, float, float]] = []
    for s in path.steps:
        if s.far:
            out.append((_FAR_RANK, -1.0, *none))
        out.append((_CHILD_RANK, float(s.index), *none))
    if o := path.offset:
        if o.far:
            out.append((_FAR_RANK, -1.0, *none))
        if o.at is not None:
            out.append((_CHARACTER_RANK, float(o.at), *none))
        else:
            out.append((_MEDIA_RANK, *(-1.0 if v is None else v for v in (o.seconds, o.y, o.x))))
    return out


# --- writing ---------------------------------------------------------------------------------


def _escaped(value: str) -> str:
    return re.sub(rf"[{_SPECIAL}]", r"^\g<0>", value)


def _note(first: str | None, second: str | None, parameters: Parameters) -> str:
    parts = [_escaped(first) if first else "", f",{_escaped(second)}" if second else ""]
    parts += [f";{_escaped(n)}={','.join(map(_escaped, v))}" for n, v in parameters]
    return f"[{''.join(parts)}]" if any(parts) else ""


def _number(value: float) -> str:
    return str(int(value)) if value == int(value) else f"{value:.20f}".rstrip("0") if "e" in repr(value) else repr(value)


def _path_text(path: Path) -> str:
    out = [f"{'!' * s.far}/{s.index}{_note(s.id, None, s.parameters)}" for s in path.steps]
    if o := path.offset:
        out.append("!" * o.far)
        if o.at is not None:
            out.append(f":{o.at}{_note(o.before, o.after, o.parameters)}")
        else:
            out.append(f"~{_number(o.seconds)}" if o.seconds is not None else "")
            out.append(f"@{_number(o.x)}:{_number(o.y)}" if o.x is not None else "")
            out.append(_note(None, None, o.parameters))
    return "".join(out)


def expression(cfi: Cfi) -> str:
    """The canonical form without its wrapper."""
    return ",".join(_path_text(p) for p in (cfi.path, cfi.start, cfi.end) if p is not None)


# --- reading ---------------------------------------------------------------------------------


def _parts(note: str | None, at: int) -> tuple[str | None, str | None, Parameters]:
    if not note:
        return None, None, ()
    body = note[1:-1]
    if not body:
        raise CfiError("an assertion is not empty", at)
    plain = lambda v: re.sub(r"\^(.)", r"\1", v, flags=re.S)
    head = re.match(rf"({_VALUE})?(?:,({_VALUE}))?", body)
    parameters = []
    for m in re.finditer(rf";({_VALUE})=({_VALUE}(?:,{_VALUE})*)", body[head.end() :]):
        parameters.append((plain(m[1]), tuple(plain(v) for v in re.findall(_VALUE, m[2]))))
    return plain(head[1]) if head[1] else None, plain(head[2]) if head[2] else None, tuple(parameters)


class _Reader:
    def __init__(self, source: str, at: int):
        self.source, self.at = source, at

    def take(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.source, self.at):
            self.at = m.end()
        return m

    def path(self) -> Path:
        steps: list[Step] = []
        while True:
            begin = self.at
            if m := self.take(_STEP):
                name, second, parameters = _parts(m["note"], begin)
                if second is not None:
                    raise CfiError("a step's assertion is an id", begin)
                steps.append(Step(int(m["index"]), name, parameters, bool(m["far"])))
            elif m := self.take(_CHARACTER):
                before, after, parameters = _parts(m["note"], begin)
                return Path(tuple(steps), Offset(at=int(m["at"]), before=before, after=after, parameters=parameters, far=bool(m["far"])))
            elif m := self.take(_MEDIA):
                first, second, parameters = _parts(m["note"], begin)
                if first or second:
                    raise CfiError("text is asserted at character offsets", begin)
                numbers = {k: float(m[k]) for k in ("seconds", "x", "y") if m[k] is not None}
                return Path(tuple(steps), Offset(**numbers, parameters=parameters, far=bool(m["far"])))
            else:
                return Path(tuple(steps))

    def expect(self, text: str) -> None:
        if not self.source.startswith(text, self.at):
            raise CfiError(f"expected {text!r}", self.at)
        self.at += len(text)


def parse(source: str) -> Cfi:
    """A CFI with or without its wrapper; CfiError tells where reading stopped."""
    if len(source) > MAX_LENGTH:
        raise CfiError("too long", MAX_LENGTH)
    wrapped = source.startswith("epubcfi(")
    reader = _Reader(source, 8 if wrapped else 0)
    begin = reader.at
    try:
        path = reader.path()
        if source.startswith(",", reader.at):
            reader.expect(",")
            start = reader.path()
            reader.expect(",")
            out = Cfi(path, start, reader.path())
        else:
            out = Cfi(path)
    except CfiError as error:
        raise CfiError(str(error), begin if error.at is None else error.at) from None
    if wrapped:
        reader.expect(")")
    if reader.at != len(source):
        raise CfiError("unexpected character", reader.at)
    return out


def try_parse(source: str | None) -> Cfi | None:
    try:
        return None if source is None else parse(source)
    except CfiError:
        return None


# --- combining -------------------------------------------------------------------------------


def between(a: Cfi, b: Cfi) -> Cfi:
    """The range with the longest common parent that leaves both ends something of their own."""
    if a.is_range or b.is_range:
        raise CfiError("a range is made of two points")
    x, y = a.path, b.path
    shared = 0
    for p, q in zip(x.steps, y.steps, strict=False):
        if p != q:
            break
        shared += 1
    longest = min(len(p.steps) if p.offset else max(len(p.steps) - 1, 1) for p in (x, y))
    shared = min(shared, longest)
    if not shared:
        raise CfiError("the points share no step")
    return Cfi(Path(x.steps[:shared]), Path(x.steps[shared:], x.offset), Path(y.steps[shared:], y.offset))


def into(package: Path, content: Cfi) -> Cfi:
    """A content document's CFI below the package path of its spine item."""
    first, *rest = content.path.steps
    path = Path((*package.steps, replace(first, far=True), *rest), content.path.offset)
    return replace(content, path=path)


def split(cfi: Cfi) -> tuple[Path, Cfi | None] | None:
    """A publication CFI as (package path, content CFI or None). The ends of a range must share the
    package path (their assertions may differ)."""

    def point(path: Path) -> tuple[Path, Cfi | None] | None:
        far = next((i for i, s in enumerate(path.steps) if s.far), None)
        if far is None:
            return Path(path.steps), None
        try:
            return Path(path.steps[:far]), Cfi(Path((replace(path.steps[far], far=False), *path.steps[far + 1 :]), path.offset))
        except CfiError:
            return None

    if not cfi.is_range:
        return point(cfi.path)
    a, b = point(cfi.start_path), point(cfi.end_path)
    if not a or not b or a[1] is None or b[1] is None or [s.index for s in a[0].steps] != [s.index for s in b[0].steps]:
        return None
    try:
        return a[0], between(a[1], b[1])
    except CfiError:
        return None
