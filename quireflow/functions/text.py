"""Text expressions on Catalyst columns. Offsets that readers see count UTF-16 units; Spark counts
code points, so the two are converted where a text has astral characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import folding


def len16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def to_units16(text: Column, code_points: Column) -> Column:
    """The UTF-16 offset of a code point offset."""
    return len16(F.substring(text, F.lit(1), code_points.cast("int")))


def to_code_points(text: Column, units: Column) -> Column:
    """The code point offset of a UTF-16 offset; inside a pair, that of the pair."""
    plain = len16(text) == F.length(text)
    walked = F.aggregate(
        F.split(text, ""), F.struct(F.lit(0).alias("u"), F.lit(0).alias("c")),
        lambda a, ch: F.when(a["u"] + len16(ch) <= units, F.struct((a["u"] + len16(ch)).alias("u"), (a["c"] + F.length(ch)).alias("c"))).otherwise(F.struct(F.lit(1 << 30).alias("u"), a["c"].alias("c"))),
        lambda a: a["c"],
    )
    return F.when(plain, units.cast("int")).otherwise(walked)


def substring16(text: Column, start: Column, end: Column) -> Column:
    a, b = to_code_points(text, start), to_code_points(text, end)
    return F.substring(text, a + 1, b - a)


def collapse(text: Column) -> Column:
    """ASCII white space to single spaces."""
    return F.regexp_replace(text, "[ \t\n\r\f]+", " ")


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


#: Unicode white space, spelt out: Java's \s is ASCII unless told otherwise (fixed values).
WHITE = folding.char_class(folding.SPACES)


def clean(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def tokens(text: Column) -> Column:
    """Distinct white-space separated tokens, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), lambda t: t != ""))


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def search_lower(text: Column) -> Column:
    """Lower case for search: final sigma like any other."""
    return F.translate(F.lower(text), "ς", "σ")


def once(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often `use` mentions it and wherever the result is
    pushed to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column, case: bool = False, diacritics: bool = False) -> Column:
    """Folded text without offsets: equal to the kernel's for counting and containment. Text that is all
    ASCII, which its lengths tell, needs no tables."""
    lower = (lambda c: c) if case else search_lower
    ascii_only = F.octet_length(text) == F.length(text)
    plain = F.regexp_replace(text, "[\t-\r ]+", " ")
    any_text = lower(F.regexp_replace(F.regexp_replace(text, folding.char_class(folding.IGNORED), ""), WHITE + "+", " "))
    if not diacritics:
        pairs = sorted(folding.base_letters().items())
        any_text = F.translate(F.regexp_replace(any_text, folding.char_class(folding.MARKS), ""), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.when(ascii_only, plain if case else F.lower(plain)).otherwise(any_text)


def occurrences(folded: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return F.when(F.length(needle) > 0, ((F.length(folded) - F.length(F.replace(folded, needle))) / F.length(needle)).cast("int")).otherwise(0)


def whole_word(folded: Column, needle: str) -> Column:
    """Whole-word occurrences: neighbours are no letters, numbers or marks."""
    word = r"[\p{L}\p{N}\p{M}]"
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in needle)
    return F.size(F.regexp_extract_all(folded, F.lit(f"(?<!{word}){quoted}(?!{word})"), F.lit(0)))


def around(text: Column, start: Column, end: Column, context: int) -> Column:
    """Struct of before, highlight and after; what is empty is null. Code point offsets."""
    part = lambda a, b: F.nullif(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))), F.lit(""))
    return F.struct(part(F.greatest(start - context, F.lit(0)), start).alias("before"), part(start, end).alias("highlight"), part(end, end + context).alias("after"))


def snippet(before: Column, highlight: Column, after: Column) -> Column:
    """A search result in one line."""
    flat = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("…"), flat(before), flat(highlight), flat(after), F.lit("…"))


def decode_utf8(content: Column) -> Column:
    """Strict UTF-8: null where the bytes are not valid."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
