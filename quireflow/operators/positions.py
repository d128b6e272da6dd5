"""Positions: fixed-width pages of reading text, numbered through a publication, and progressions.

Resources are rows (book, idx, href, length, unreadable): length in UTF-16 units, null for fixed
layout, other media and unreadable documents. Everything is column arithmetic and one running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum

WIDTH = 1024
VERSION = 1


def count_of(length: Column, width: int = WIDTH) -> Column:
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(1)).otherwise(F.ceil(length / width)).cast("long")


def resources(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """`rows` (book, idx, length, ...) with count, start (the first position's number) and total."""
    counted = rows.withColumn("count", count_of(F.col("length"), width))
    return running_sum(counted, "book", "idx", F.col("count"), "start", total="total").withColumn("start", F.col("start") + 1)


def positions(table: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a position: book, idx, position, offset, progression, total_progression."""
    k = table.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    length = F.coalesce("length", F.lit(0))
    offset = F.least(F.col("k") * width, length)
    return k.select(
        "book", "idx", (F.col("start") + F.col("k")).alias("position"), offset.alias("offset"),
        F.when(length == 0, 0.0).otherwise(offset / length).alias("progression"), ((F.col("start") - 1 + F.col("k")) / F.col("total")).alias("total_progression"),
    )


def _clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, F.lit(hi) if not isinstance(hi, Column) else hi), F.lit(lo))


def at_progression(progression: Column, width: int = WIDTH) -> Column:
    """The position at a progression of its resource; columns of resources() are in scope."""
    inside = F.floor(F.round(_clamp(progression, 0.0, 1.0) * F.col("length")) / width)
    return F.when(F.coalesce("length", F.lit(0)) == 0, F.col("start")).otherwise(F.col("start") + F.least(F.col("count") - 1, inside))


def interval_fraction(offset: Column, length: Column, width: int = WIDTH) -> Column:
    """Position intervals passed at an offset; the last, short one is stretched to its boundary."""
    full = F.col("count") - 1
    last = full * width
    plain = offset / width
    return F.when(length <= last, _clamp(plain, 0.0, F.col("count").cast("double"))).when(offset <= last, plain).otherwise(_clamp(full + (offset - last) / (length - last), 0.0, F.col("count").cast("double")))


def total_at_progression(progression: Column, width: int = WIDTH) -> Column:
    p = _clamp(progression, 0.0, 1.0)
    fraction = F.when(F.coalesce("length", F.lit(0)) == 0, p * F.col("count")).otherwise(interval_fraction(p * F.col("length"), F.col("length"), width))
    return _clamp((F.col("start") - 1 + fraction) / F.col("total"), 0.0, 1.0)


def at_offset(offset: Column, length: Column, width: int = WIDTH) -> Column:
    """(position, total progression) at a text offset of a document of `length` units."""
    unknown = (F.coalesce("length", F.lit(0)) == 0) | (length == 0)
    position = F.when(unknown, F.col("start")).otherwise(F.col("start") + F.least(F.col("count") - 1, F.floor(offset / width)))
    fraction = F.when(length == 0, 0.0).when(unknown, offset / length).otherwise(interval_fraction(offset.cast("double"), length, width))
    return F.struct(position.alias("position"), _clamp((F.col("start") - 1 + fraction) / F.col("total"), 0.0, 1.0).alias("total_progression"))


def offset_for_position(position: Column, width: int = WIDTH) -> Column:
    """The offset where a position starts in its resource; null if it lies in another one."""
    own = (position >= F.col("start")) & (position < F.col("start") + F.col("count"))
    return F.when(own, (position - F.col("start")) * width)


def locate_positions(wanted: DataFrame, table: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of wanted (book, position) with idx and offset: an interval join made an equi-join by
    buckets of `bucket` positions, of which a resource covers a few."""
    bucket = 64
    w = wanted.withColumn("_b", F.floor((F.col("position") - 1) / bucket))
    t = table.select("book", "idx", "start", "count").withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - 1) / bucket), F.floor((F.col("start") + F.col("count") - 2) / bucket))))
    joined = w.join(t, ["book", "_b"]).where("position >= start and position < start + count")
    return joined.withColumn("offset", (F.col("position") - F.col("start")) * width).drop("_b", "start", "count")


def totals(table: DataFrame) -> DataFrame:
    """Per book: positions, and the hrefs of unreadable resources in order."""
    bad = F.sort_array(F.collect_list(F.when(F.col("unreadable"), F.struct("idx", "href"))))
    return table.groupBy("book").agg(F.sum("count").alias("positions"), F.transform(bad, lambda x: x["href"]).alias("unreadable"))


def cache(table: DataFrame, width: int = WIDTH) -> DataFrame:
    """One JSON document a book, for interchange."""
    row = F.struct("idx", F.col("href"), F.col("count"), F.col("length"), F.when(F.col("unreadable"), True).alias("unreadable"))
    body = table.groupBy("book").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return body.select("book", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(width).alias("charactersPerPosition"), F.transform("r", lambda x: x.dropFields("idx")).alias("resources"))).alias("json"))


CACHE = "struct<version:int,charactersPerPosition:int,resources:array<struct<href:string,count:bigint,length:bigint,unreadable:boolean>>>"


def from_cache(cached: DataFrame) -> DataFrame:
    """Rows of cache() as resources again, with `valid`: the version is known and counts fit lengths."""
    d = cached.select("book", F.from_json("json", CACHE).alias("d"))
    rows = d.select("book", F.col("d.version").alias("version"), F.col("d.charactersPerPosition").alias("width"), F.posexplode("d.resources").alias("idx", "r"))
    flat = rows.select("book", F.col("idx").cast("long").alias("idx"), "version", "width", "r.href", "r.length", "r.count", F.coalesce("r.unreadable", F.lit(False)).alias("unreadable"))
    want = F.when(F.coalesce("length", F.lit(0)) == 0, 1).otherwise(F.ceil(F.col("length") / F.col("width")))
    good = (F.col("version") == VERSION) & (F.col("width") >= 1) & (F.col("count") == want) & ~(F.col("unreadable") & F.col("length").isNotNull()) & F.col("href").isNotNull()
    checked = flat.withColumn("_ok", F.coalesce(good, F.lit(False)))
    ok = checked.groupBy("book").agg(F.min("_ok").alias("valid"))
    numbered = running_sum(checked.drop("_ok"), "book", "idx", F.col("count"), "start", total="total").withColumn("start", F.col("start") + 1)
    return numbered.join(ok, "book")


def matches(table: DataFrame, reading_order: DataFrame, width: int = WIDTH) -> DataFrame:
    """Books whose cached table fits the reading order (book, idx, href) and width."""
    a = table.where(F.col("width") == width).select("book", "idx", "href")
    b = reading_order.select("book", "idx", "href")
    wrong = a.exceptAll(b).union(b.exceptAll(a)).select("book").distinct()
    return a.select("book").distinct().join(wrong, "book", "left_anti")
