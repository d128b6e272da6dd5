"""Reading text of a content document, with a two-way map between text offsets and CFIs.

Elements, pieces of character data (chunks) and runs are rows of plain lists. A run says which units
of a chunk gave which units of the text; collapsed space gives one, dropped space none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import islice

from . import cfi as C
from .errors import BookError
from .markup import MATH, MAX_BYTES, MAX_DEPTH, MAX_ELEMENTS, SVG, XHTML, decode, line_feeds, walk_html, walk_xml
from .units import is_low, to_units

TEXT_TYPES = ("application/xhtml+xml", "text/html", "image/svg+xml")

# Elements that make blocks, keep white space, or hold no reading text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li listing main menu nav ol p plaintext pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
KEEPS_SPACE = set("pre listing xmp plaintext".split())
UNREAD = {
    XHTML: set("audio canvas datalist embed head iframe noembed noframes object rp rt rtc script select style template textarea title video".split()),
    SVG: set("clipPath defs desc filter linearGradient marker mask metadata pattern radialGradient script style symbol title".split()),
    MATH: {"annotation", "annotation-xml"},
}
_KINDS = {"li": "listItem", "td": "tableCell", "th": "tableCell", "caption": "caption", "figcaption": "caption"}
_PIECES = re.compile(r"([ \t\n\r\f]+)|[^ \t\n\r\f]+")


def collapse(text: str) -> str:
    return re.sub(r"[ \t\n\r\f]+", " ", text)


@dataclass
class Block:
    start: int
    end: int
    kind: str
    heading_level: int | None
    list_depth: int
    quote_depth: int
    language: str | None


@dataclass
class _Open:
    element: int
    silent: bool
    block: bool
    kind: str
    level: int | None
    language: str | None
    item: bool
    quote: bool
    keeps: bool
    title: bool


@dataclass
class Document:
    media_type: str
    text: str = ""
    title: str | None = None
    language: str | None = None
    blocks: list[Block] = field(default_factory=list)
    # elements
    parent: list[int] = field(default_factory=list)
    index: list[int] = field(default_factory=list)
    name_id: list[str | None] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    chunks_of: list[list[int]] = field(default_factory=list)
    # chunks
    owner: list[int] = field(default_factory=list)
    chunk_index: list[int] = field(default_factory=list)
    chunk_length: list[int] = field(default_factory=list)
    anchor: list[int] = field(default_factory=list)
    chunk_runs: list[list[list[int]]] = field(default_factory=list)  # [source start, source length, text start, text length]
    # runs that gave text, in text order: [chunk, the run]
    runs: list[tuple[int, list[int]]] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    body: int | None = None

    # offsets to CFIs

    def steps_to(self, element: int) -> tuple[C.Step, ...]:
        out = []
        while self.parent[element] >= 0:
            out.append(C.Step(self.index[element], self.name_id[element]))
            element = self.parent[element]
        return tuple(reversed(out))

    def cfi_at(self, offset: int, before: bool = False) -> C.Cfi:
        """The point at a text offset; between two runs that of the following one, or with `before`
        that of the preceding one."""
        if not 0 <= offset <= len(self.text):
            raise IndexError(offset)
        if not self.runs:
            return C.Cfi(C.Path(self.steps_to(self.body) if self.body is not None else (C.Step(2 if self.children[0] else 0),)))
        if before:
            at = max(0, bisect_left(self.runs, offset, key=lambda r: r[1][2]) - 1)
        else:
            at = min(len(self.runs) - 1, bisect_right(self.runs, offset, key=lambda r: r[1][2] + r[1][3]))
        chunk, (source, taken, begin, given) = self.runs[at]
        inside = min(max(offset, begin), begin + given) - begin
        if taken != given:
            inside = taken if inside else 0
        return C.Cfi(C.Path((*self.steps_to(self.owner[chunk]), C.Step(self.chunk_index[chunk])), C.Offset(at=source + inside)))

    def cfi_for(self, start: int, end: int) -> C.Cfi:
        first = self.cfi_at(start)
        if start == end:
            return first
        last = self.cfi_at(end, before=True)
        return first if last.keys() <= first.keys() else C.between(first, last)

    # CFIs to offsets

    def resolve(self, cfi: C.Cfi) -> tuple[int, int, str] | None:
        """(start, end, match): match is exact, corrected (an assertion was followed) or approximate."""
        a = self._point(cfi.start_path)
        b = self._point(cfi.end_path) if cfi.is_range else a
        if a is None or b is None:
            return None
        return a[0], max(a[0], b[0]), MATCHES[max(a[1], b[1])]

    def _point(self, path: C.Path) -> tuple[int, int] | None:
        here, grade = 0, 0
        for i, step in enumerate(path.steps):
            if step.far:
                return self.start[here], 2
            number = step.index // 2
            if step.index % 2:
                chunks = self.chunks_of[here]
                return self._in_chunk(chunks[number], path.offset, grade) if number < len(chunks) else None
            inner = self.children[here]
            if number in (0, len(inner) + 1):
                if i < len(path.steps) - 1:
                    return None
                return (self.end if number else self.start)[here], grade
            child = inner[number - 1] if number <= len(inner) else None
            if step.id is not None and (child is None or self.name_id[child] != step.id):
                child, grade = self.ids.get(step.id), max(grade, 1)
            if child is None:
                return None
            here = child
        return self.start[here], 2 if path.offset is not None and path.offset.far else grade

    def _chunk_to_text(self, chunk: int, offset: int) -> int:
        runs = self.chunk_runs[chunk]
        if not runs:
            return self.anchor[chunk]
        for source, taken, begin, given in runs:
            if offset < source:
                return begin
            if offset < source + taken:
                return begin + offset - source if taken == given else begin if offset == source else begin + given
        return runs[-1][2] + runs[-1][3]

    def _in_chunk(self, chunk: int, offset: C.Offset | None, grade: int) -> tuple[int, int] | None:
        if offset is None or offset.at is None:
            return self._chunk_to_text(chunk, 0), grade
        if offset.far:
            return self._chunk_to_text(chunk, 0), 2
        if offset.at > self.chunk_length[chunk]:
            grade = 2
        point = self._chunk_to_text(chunk, min(offset.at, self.chunk_length[chunk]))
        before, after = (None if x is None else collapse(to_units(x)) for x in (offset.before, offset.after))
        if (before is None or self._seen(point, -1, len(before)) == before) and (after is None or self._seen(point, 1, len(after)) == after):
            return point, grade
        needle = (before or "") + (after or "")
        if not needle.strip():
            return None
        found = nearest(self.flat, needle, len(before or ""), point)
        return None if found is None else (found, max(grade, 1))

    def _seen(self, point: int, step: int, count: int) -> str:
        """Up to `count` collapsed units before or after a point."""
        out: list[str] = []
        at = point if step > 0 else point - 1
        while 0 <= at < len(self.text) and len(out) < count:
            c = " " if self.text[at] in " \t\n\r\f" else self.text[at]
            if c != " " or not out or out[-1] != " ":
                out.append(c)
            at += step
        return "".join(out if step > 0 else reversed(out))

    @property
    def flat(self) -> str:
        return self.text.replace("\n", " ")

    # lookups

    def offset_of_id(self, name: str) -> int | None:
        return self.start[self.ids[name]] if name in self.ids else None

    def block_at(self, offset: int) -> Block | None:
        at = bisect_right(self.blocks, offset, key=lambda b: b.end)
        if at == len(self.blocks) and self.blocks and offset == self.blocks[-1].end:
            at -= 1
        return self.blocks[at] if at < len(self.blocks) else None

    def around(self, start: int, end: int, context: int = 40) -> tuple[str | None, str | None, str | None]:
        return around(self.text, start, end, context)


MATCHES = ("exact", "corrected", "approximate")
#: Occurrences that a text match looks at.
MOST_OCCURRENCES = 10_000


def nearest(haystack: str, needle: str, lead: int, point: int) -> int | None:
    """Of the first occurrences of needle, overlapping ones too, the one that is nearest to point when
    shifted by lead; the first of ties."""
    places = (m.start() + lead for m in islice(re.finditer(f"(?={re.escape(needle)})", haystack), MOST_OCCURRENCES))
    return min(places, key=lambda place: abs(place - point), default=None)


def around(self, start: int, end: int, context: int = 40) -> tuple[str | None, str | None, str | None]:
        return around(self.text, start, end, context)


MATCHES = ("exact", "corrected", "approximate")
#: Occurrences that a text match looks at.
MOST_OCCURRENCES = 10_000


def nearest(haystack: str, needle: str, lead: int, point: int) -> int | None:
    """Of the first occurrences of needle (shifted by lead), the one nearest to point; the first of ties."""
    best, at, seen = None, haystack.find(needle), 0
    while at >= 0 and seen < MOST_OCCURRENCES:
        if best is None or abs(at + lead - point) < abs(best - point):
            best = at + lead
        at, seen = haystack.find(needle, at + 1), seen + 1
    return best


def around(text: str, start: int, end: int, context: int) -> tuple[str | None, str | None, str | None]:
    """(before, highlight, after); no surrogate pair is split, what is empty is None."""
    lo, hi = max(0, start - context), min(len(text), end + context)
    if lo and is_low(text[lo]):
        lo -= 1
    if hi < len(text) and is_low(text[hi]):
        hi += 1
    return text[lo:start] or None, text[start:end] or None, text[end:hi] or None


class Extractor:
    """A sink of markup events that builds a Document."""

    def __init__(self, media_type: str):
        self.d = Document(media_type)
        self.out: list[str] = []
        self.length = 0
        self.open: list[_Open] = []
        self.keeping = 0
        self.block: _Open | None = None
        self.in_block = False
        self.block_start = self.lists = self.quotes = 0
        self.held: list[tuple[int, int, str, bool]] = []  # chunk, source start, units, collapsed
        self.breaks = 0
        self.new_elements: list[int] = []
        self.new_chunks: list[int] = []
        self.closed: set[int] = set()
        self.title: list[str] | None = None

    # events

    def start(self, ns: str | None, local: str, attributes: dict[str, str]) -> None:
        d, above = self.d, self.open[-1] if self.open else None
        name = attributes.get("id") or None
        element = len(d.parent)
        language = attributes.get("xml:lang", attributes.get("lang"))
        if above is None:
            if element:
                raise BookError("content", "the document has several roots")
            d.language = language
        d.parent.append(above.element if above else -1)
        d.index.append(2 * (len(d.children[above.element]) + 1) if above else 0)
        d.name_id.append(name)
        d.start.append(-1)
        d.end.append(-1)
        d.children.append([])
        d.chunks_of.append([])
        if above:
            d.children[above.element].append(element)
        if name:
            d.ids.setdefault(name, element)
        x = ns == XHTML
        if x and local == "body" and above and above.element == 0 and d.body is None:
            d.body = element
        self._chunk(element, 1)
        self.new_elements.append(element)

        silent = bool(above and above.silent) or (x and "hidden" in attributes) or local in UNREAD.get(ns, ())
        level = self._heading(local, attributes) if x else None
        is_block = level is not None or local in BLOCKS if x else local in ("svg", "text") if ns == SVG else ns == MATH and local == "math" and attributes.get("display") == "block"
        keeps = x and local in KEEPS_SPACE
        kind = "heading" if level is not None else "preformatted" if keeps else _KINDS.get(local, "paragraph") if x else "paragraph"
        takes_title = d.title is None and self.title is None and local == "title" and (x or ns == SVG)
        here = _Open(element, silent, is_block and not silent, kind, level, language if language is not None else above and above.language, x and local == "li", x and local == "blockquote", keeps, takes_title)
        if here.block:
            self._flush()
        self.open.append(here)
        if takes_title:
            self.title = []
        if not silent:
            self.keeping += keeps
            if x and local == "br" and self.in_block:
                self._drop_held()
                self.breaks += 1

    def end(self) -> None:
        d, here = self.d, self.open.pop()
        self.closed.add(here.element)
        if d.start[here.element] >= 0:
            d.end[here.element] = self.length
        if here.block:
            self._flush()
        if here.keeps and not here.silent:
            self.keeping -= 1
        if here.title:
            d.title = collapse("".join(self.title or [])).strip()
            self.title = None
        if d.parent[here.element] >= 0:
            self._chunk(d.parent[here.element], d.index[here.element] + 1)

    def text(self, data: str) -> None:
        if not self.open or not data:
            return
        here = self.open[-1]
        chunk = self.d.chunks_of[here.element][-1]
        base = self.d.chunk_length[chunk]
        self.d.chunk_length[chunk] += len(data)
        if self.title is not None:
            self.title.append(data)
        if here.silent:
            return
        for m in _PIECES.finditer(data):
            at, piece = base + m.start(), m[0]
            if not m[1]:
                self._begin()
                self._emit(chunk, at, len(piece), piece)
            elif not self.keeping:
                if self.in_block and not self.breaks and not any(h[3] for h in self.held):
                    self.held.append((chunk, at, piece, True))
                else:
                    self._drop(chunk, at, len(piece))
            else:
                if not self.in_block and not any(not h[3] for h in self.held):
                    feed = piece.rfind("\n") + 1  # line feeds before the first line are not read
                    if feed:
                        self._drop(chunk, at, feed)
                        at, piece = at + feed, piece[feed:]
                if piece:
                    self.held.append((chunk, at, piece, False))

    def finish(self) -> Document:
        d = self.d
        if not d.parent:
            raise BookError("content", "the document has no root element")
        self._flush()
        self._settle()
        d.text = "".join(self.out)
        d.title = d.title or None
        return d

    # parts

    @staticmethod
    def _heading(local: str, attributes: dict[str, str]) -> int | None:
        if re.fullmatch("h[1-6]", local):
            return int(local[1])
        if local not in BLOCKS or "heading" not in re.split(r"\s+", attributes.get("role", "")):
            return None
        level = attributes.get("aria-level", "").strip()
        return int(level) if re.fullmatch("[+]?0*[1-6]", level) else 2

    def _chunk(self, element: int, index: int) -> None:
        d = self.d
        d.chunks_of[element].append(len(d.owner))
        self.new_chunks.append(len(d.owner))
        d.owner.append(element)
        d.chunk_index.append(index)
        d.chunk_length.append(0)
        d.anchor.append(-1)
        d.chunk_runs.append([])

    def _write(self, units: str) -> None:
        self.out.append(units)
        self.length += len(units)

    def _emit(self, chunk: int, source: int, taken: int, units: str) -> None:
        runs = self.d.chunk_runs[chunk]
        last = runs[-1] if runs else None
        if last and last[1] == last[3] > 0 and taken == len(units) and last[0] + last[1] == source and last[2] + last[3] == self.length:
            last[1] += taken
            last[3] += taken
        else:
            run = [source, taken, self.length, len(units)]
            runs.append(run)
            self.d.runs.append((chunk, run))
        self._write(units)

    def _drop(self, chunk: int, source: int, taken: int) -> None:
        self.d.chunk_runs[chunk].append([source, taken, self.length, 0])

    def _drop_held(self) -> None:
        for collapsed in (True, False):
            for chunk, at, units, mode in self.held:
                if mode == collapsed:
                    self._drop(chunk, at, len(units))
        self.held = []

    def _begin(self) -> None:
        """What must stand before the next content."""
        if not self.in_block:
            if self.length:
                self._write("\n")
            self.in_block, self.block_start, self.breaks = True, self.length, 0
            self.block = next((o for o in reversed(self.open) if o.block), None)
            self.lists, self.quotes = sum(o.item for o in self.open), sum(o.quote for o in self.open)
            self.held = [h for h in self.held if not h[3]]
        elif self.breaks:
            self._drop_held()
            self._write("\n" * self.breaks)
            self.breaks = 0
        held, self.held = sorted(self.held, key=lambda h: not h[3]), []
        for chunk, at, units, collapsed in held:
            self._emit(chunk, at, len(units), " " if collapsed else units)
        self._settle()

    def _flush(self) -> None:
        self._drop_held()
        self.breaks = 0
        if self.in_block:
            b = self.block
            self.d.blocks.append(Block(self.block_start, self.length, b.kind if b else "paragraph", b.level if b else None, self.lists, self.quotes, b.language if b else None))
            self.in_block = False

    def _settle(self) -> None:
        """Elements and chunks that waited for content start here."""
        for e in self.new_elements:
            self.d.start[e] = self.length
            if e in self.closed:
                self.d.end[e] = self.length
        for c in self.new_chunks:
            self.d.anchor[c] = self.length
        self.new_elements, self.new_chunks = [], []


def parse(text: str, media_type: str, path: str | None = None, max_bytes: int = MAX_BYTES, max_elements: int = MAX_ELEMENTS, max_depth: int = MAX_DEPTH, bare_references: bool = True) -> Document:
    if len(text) > max_bytes:
        raise BookError("content", "the document is too large", path)
    sink = Extractor(media_type)
    if media_type == "text/html":
        walk_html(text, sink, path, max_elements, max_depth, bare_references)
    elif media_type in TEXT_TYPES:
        walk_xml(line_feeds(text), sink, path, max_elements, max_depth)
    else:
        raise BookError("content", f"unsupported type {media_type}", path)
    return sink.finish()


def read(data: bytes, media_type: str, path: str | None = None, **limits) -> Document:
    if len(data) > limits.get("max_bytes", MAX_BYTES):
        raise BookError("content", "the document is too large", path)
    return parse(decode(data, path), media_type, path, **limits)
