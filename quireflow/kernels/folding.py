"""Search folding: what a reader takes as the same text, with the source span of every folded unit."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

from .units import from_units, to_units

# The character classes of the folding rules, as inclusive ranges of code points.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
IGNORED = ((0xAD, 0xAD), (0x200B, 0x200B), (0x2060, 0x2060), (0xFEFF, 0xFEFF))
MARKS = (
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x05C7, 0x05C7), (0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670),
    (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F),
)
# Blocks whose precomposed letters fold to their base, and letters with strokes.
LETTER_BLOCKS = ((0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x600, 0x6FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB1D, 0xFB4F))
STROKES = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t"}


def char_class(ranges) -> str:
    """A regular expression class that Python and Java read alike."""
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


_space, _ignored, _mark = (re.compile(char_class(r)) for r in (SPACES, IGNORED, MARKS))


@cache
def base_letters() -> dict[str, str]:
    """Precomposed letters whose canonical decomposition adds only nonspacing marks, to their base."""
    out = dict(STROKES)
    for lo, hi in LETTER_BLOCKS:
        for letter in map(chr, range(lo, hi + 1)):
            base, *rest = unicodedata.normalize("NFD", letter)
            if rest and base != letter and all(unicodedata.category(m) == "Mn" for m in rest):
                out[letter] = base
    return out


@dataclass(frozen=True)
class Sensitivity:
    case: bool = False
    diacritics: bool = False


@cache
def _fold_char(char: str, rule: Sensitivity) -> str | None:
    """The folded form of one character, '' if it only lengthens its predecessor, None for a space."""
    if _space.match(char):
        return None
    if not rule.case:
        char = "σ" if char == "ς" else char.lower()
    if rule.diacritics:
        return char
    return "".join(base_letters().get(c, c) for c in char if not _mark.match(c))


@dataclass
class Folded:
    """Folded units; unit i came from source units starts[i] to ends[i]."""

    text: str
    starts: Sequence[int]
    ends: Sequence[int]


@cache
def _plain_table(rule: Sensitivity) -> tuple[dict[int, str], re.Pattern]:
    """What each unit that folds to one unit becomes, and a pattern of all else: runs of spaces, and
    units that vanish, grow or pair."""
    table, odd = {}, ["\ud800-\udfff"]
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        folded = "" if _ignored.match(char) else _fold_char(char, rule)
        if folded is None:
            table[code] = " "
        elif len(folded) != 1 or folded > "\uffff":
            odd.append(re.escape(char))
        elif folded != char:
            table[code] = folded
    spaces = char_class(SPACES)
    return table, re.compile(f"[{''.join(odd)}]|{spaces}{{2}}")


#: A run of spaces (what is ignored inside goes with it), what is ignored elsewhere, or one character.
_SPAN = re.compile(f"(?P<gap>{_space.pattern}(?:{_ignored.pattern}*{_space.pattern})*)|(?P<nothing>{_ignored.pattern}+)|[\ud800-\udbff][\udc00-\udfff]|.", re.DOTALL)


@cache
def _form(span: str, rule: Sensitivity) -> str:
    """What the units of one character fold to, in units."""
    return to_units(_fold_char(from_units(span) if len(span) > 1 else span, rule) or "")


def _by_spans(units: str, rule: Sensitivity) -> Folded:
    """Any text: cut into spans, each of which gives some units. One that gives none (a mark) lengthens
    the span before it."""
    forms, spans = [], []
    for m in _SPAN.finditer(units):
        form = " " if m["gap"] else "" if m["nothing"] else _form(m[0], rule)
        if form:
            forms.append(form)
            spans.append(m.span())
        elif spans and not m["nothing"]:
            spans[-1] = spans[-1][0], m.end()
    spread = [span for form, span in zip(forms, spans, strict=True) for _ in form]
    return Folded("".join(forms), [a for a, _ in spread], [b for _, b in spread])


def fold(units: str, rule: Sensitivity = Sensitivity()) -> Folded:
    table, odd = _plain_table(rule)
    if odd.search(units):
        return _by_spans(units, rule)
    # The usual text: unit for unit.
    return Folded(units.translate(table), range(len(units)), range(1, len(units) + 1))


def _part_of_word(char: str) -> bool:
    return char != "" and unicodedata.category(char)[0] in "LNM"


def stands_alone(units: str, begin: int, end: int) -> bool:
    """Whether no letter, number or mark touches a span of units."""
    return not _part_of_word(from_units(units[max(0, begin - 2) : begin])[-1:]) and not _part_of_word(from_units(units[end : end + 2])[:1])


def needle_of(query: str, rule: Sensitivity = Sensitivity()) -> str:
    return fold(to_units(query), rule).text.strip()


def find(needle: str, source: Folded, units: str, whole_word: bool = False) -> Iterator[tuple[int, int]]:
    """Source spans of a folded needle, left to right, none overlapping. Of whole words, one that is
    refused keeps none from those that overlap it."""
    if not needle:
        return
    free, literal = 0, re.escape(needle)
    for m in re.finditer(f"(?={literal})" if whole_word else literal, source.text):
        begin, end = source.starts[m.start()], source.ends[m.start() + len(needle) - 1]
        if m.start() >= free and (not whole_word or stands_alone(units, begin, end)):
            free = m.start() + len(needle)
            yield begin, end


def matches(query: str, units: str, rule: Sensitivity = Sensitivity(), whole_word: bool = False) -> Iterator[tuple[int, int]]:
    """Source spans of the matches of a query."""
    return find(needle_of(query, rule), fold(units, rule), units, whole_word)
