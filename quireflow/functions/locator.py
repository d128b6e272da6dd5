"""Locators in columns: strict reading of their JSON, writing without what is absent, and the ones that
need no document to be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import uri

_MEDIA = r"^[a-zA-Z0-9!#$&^_.+-]+/[a-zA-Z0-9!#$&^_.+-]+$"
#: Depth that JSON of extensions may have.
MOST_DEPTH = 64


def valid(href: Column, media_type: Column) -> Column:
    return F.coalesce((href != "") & ~F.contains(href, F.lit("#")) & media_type.rlike(_MEDIA), F.lit(False))


def _kind(v: Column, path: str) -> Column:
    """The JSON type at a path: VOID for null, null where nothing is."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, path, "double"))


def _wrong(v: Column, path: str, types: str) -> Column:
    kind = _kind(v, path)
    return F.coalesce(~kind.rlike(f"^({types}|VOID)$"), F.lit(False))


def from_json(text: Column) -> Column:
    """Struct of a locator's fields; `error` names the first field with a wrong type or value, and the
    rest is null then. Unknown fields are ignored, extensions of locations stay in `locations`."""
    v = F.try_parse_json(text)
    progression, total, position = (_number(v, f"$.locations.{k}") for k in ("progression", "totalProgression", "position"))
    checks = [
        (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "json"),
        (F.coalesce(~valid(_text(v, "$.href"), _text(v, "$.type")), F.lit(True)), "href or type"),
        (_wrong(v, "$.title", "STRING"), "title"),
        (_wrong(v, "$.locations", "OBJECT.*"), "locations"),
        (_wrong(v, "$.locations.fragments", "ARRAY<(STRING|VOID)?>"), "fragments"),
        (_wrong(v, "$.locations.progression", "BIGINT|DOUBLE|DECIMAL.*") | ~F.coalesce(progression.between(0, 1), F.lit(True)), "progression"),
        (_wrong(v, "$.locations.totalProgression", "BIGINT|DOUBLE|DECIMAL.*") | ~F.coalesce(total.between(0, 1), F.lit(True)), "totalProgression"),
        (_wrong(v, "$.locations.position", "BIGINT|DOUBLE|DECIMAL.*") | ~F.coalesce((position >= 1) & (position == F.floor(position)), F.lit(True)), "position"),
        (_wrong(v, "$.text", "OBJECT.*") | _wrong(v, "$.text.before", "STRING") | _wrong(v, "$.text.highlight", "STRING") | _wrong(v, "$.text.after", "STRING"), "text"),
    ]
    error = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(
        ok(_text(v, "$.href")).alias("href"), ok(_text(v, "$.type")).alias("type"), ok(_text(v, "$.title")).alias("title"),
        ok(F.coalesce(F.try_variant_get(v, "$.locations.fragments", "array<string>"), F.array().cast("array<string>"))).alias("fragments"),
        ok(progression).alias("progression"), ok(position.cast("int")).alias("position"), ok(total).alias("total_progression"),
        ok(_text(v, "$.text.before")).alias("before"), ok(_text(v, "$.text.highlight")).alias("highlight"), ok(_text(v, "$.text.after")).alias("after"),
        ok(F.try_variant_get(v, "$.locations", "variant")).alias("locations"), error.alias("error"),
    )


def extension(locations: Column, name: str) -> Column:
    """An extension of locations if it is a string (a number is not taken for one)."""
    return _text(locations, f"$.{name}")


def partial_cfi(locations: Column) -> Column:
    return extension(locations, "partialCfi")


def css_selector(locations: Column) -> Column:
    return extension(locations, "cssSelector")


def to_json(row: Column) -> Column:
    """JSON of a struct like that of from_json (without `locations`), with what is absent or empty left
    out; partial_cfi, where the struct has it, goes among the locations."""
    names = ["fragments", "progression", "position", "total_progression", "partial_cfi"]
    keys = {"total_progression": "totalProgression", "partial_cfi": "partialCfi"}
    some = lambda c: F.when(F.size(c) > 0, c)
    where = F.struct(*[(some(row[n]) if n == "fragments" else row[n]).alias(keys.get(n, n)) for n in names])
    text = F.struct(*[row[n].alias(n) for n in ("before", "highlight", "after")])
    return F.to_json(F.struct(
        row["href"].alias("href"), row["type"].alias("type"), row["title"].alias("title"),
        F.when(F.to_json(where) != "{}", where).alias("locations"), F.when(F.to_json(text) != "{}", text).alias("text"),
    ))


def copy_with(row: Column, **changes: Column) -> Column:
    """A struct with fields replaced where the new value is not null."""
    for name, value in changes.items():
        row = row.withField(name, F.coalesce(value, row[name]))
    return row


def is_empty(row: Column) -> Column:
    """Whether a locator says nothing about the place inside its resource."""
    return (F.coalesce(F.size(row["fragments"]), F.lit(0)) <= 0) & row["progression"].isNull() & row["position"].isNull() & row["total_progression"].isNull() & F.coalesce(row["before"], row["highlight"], row["after"]).isNull()


def from_link(href: Column, media_type: Column, title: Column, own_title: Column) -> Column:
    """The locator of a navigation link, without reading anything: its fragment, or progression 0."""
    part = uri.fragment(href)
    return F.struct(
        uri.without_fragment(href).alias("href"), F.coalesce(media_type, F.lit("application/octet-stream")).alias("type"), F.coalesce(title, own_title).alias("title"),
        F.when(part.isNull(), F.array().cast("array<string>")).otherwise(F.array(part)).alias("fragments"), F.when(part.isNull(), 0.0).alias("progression"),
    )


def offset_at_progression(progression: Column, length: Column) -> Column:
    """The text offset nearest to a progression from 0 to 1; anything else is an error."""
    ok = progression.between(0, 1) & ~F.isnan(progression)
    return F.when(ok, F.floor(progression * F.coalesce(length, F.lit(0)) + 0.5).cast("int")).otherwise(F.raise_error(F.lit("a progression is from 0 to 1")))
