"""Tables of contents as as-of lookups: the last entry at or before a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import last_before, numbered


def entries(nav: DataFrame, targets: DataFrame) -> DataFrame:
    """Titled contents entries that reach the reading order, in preorder: book, idx, fragment, ord,
    title. targets: (book, href, idx, fragment)."""
    toc = nav.where((F.col("kind") == "toc") & (F.length(F.coalesce("title", F.lit(""))) > 0))
    return toc.join(targets, ["book", "href"]).where("idx is not null").select("book", "idx", "fragment", "ord", "title")


def placed(toc: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries with offsets: that of the fragment's id (book, idx, id, offset), 0 without one."""
    known = ids.select("book", "idx", F.col("id").alias("fragment"), F.col("offset").alias("_at"))
    return toc.join(known, ["book", "idx", "fragment"], "left").withColumn("offset", F.coalesce("_at", F.lit(0))).drop("_at")


def title_at(points: DataFrame, toc: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """points (book, idx, offset, ...) with title: of the last entry (book, idx, offset, ord, title) at
    or before it, the later one of ties; else the title of the resource's own link (book, idx, title).

    Both sides go through one running value over (idx, offset); a book's resources are its blocks, so
    one large book spreads over tasks."""
    names = points.columns
    a = points.select("book", F.col("idx").cast("long").alias("idx"), F.col("offset").cast("long").alias("offset"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_ord"), F.lit(None).cast("string").alias("_title"), F.struct(*names).alias("_row"))
    b = toc.select("book", F.col("idx").cast("long").alias("idx"), F.col("offset").cast("long").alias("offset"), F.lit(0).alias("_kind"), F.col("ord").cast("long").alias("_ord"), F.col("title").alias("_title"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    found = last_before(a.union(b), "book", ["offset", "_kind", "_ord"], "idx", "_title", "title").where("_kind = 1")
    if links is not None:
        own = links.select("book", F.col("idx").cast("long").alias("idx"), F.col("title").alias("_own"))
        found = found.join(own, ["book", "idx"], "left").withColumn("title", F.coalesce("title", "_own"))
    return found.select("_row.*", "title")


def chapter_steps(reading_order: DataFrame) -> DataFrame:
    """The resource before and after each one; null at the ends. Neighbours meet by number, so a long
    reading order spreads over tasks."""
    rows = numbered(reading_order, "book", "idx", "_n")
    near = lambda shift, name: rows.select("book", (F.col("_n") + shift).alias("_n"), F.col("href").alias(name))
    return rows.join(near(1, "previous"), ["book", "_n"], "left").join(near(-1, "next"), ["book", "_n"], "left").drop("_n")


def outline(nav: DataFrame, kind: str = "toc") -> DataFrame:
    """A contents page in one HTML string a book: nested lists by depth changes."""
    from ..functions.text import escape_html

    rows = nav.where(F.col("kind") == kind)
    w = Window.partitionBy("book").orderBy("ord")
    before, after = F.coalesce(F.lag("depth").over(w), F.lit(0)), F.coalesce(F.lead("depth").over(w), F.lit(0))
    label = F.when(F.col("href") == "", escape_html(F.col("title"))).otherwise(F.concat(F.lit('<a href="'), escape_html(F.col("href")), F.lit('">'), escape_html(F.col("title")), F.lit("</a>")))
    opens = F.when(F.col("depth") > before, F.repeat(F.lit("<ol>"), (F.col("depth") - before).cast("int"))).otherwise("")
    closes = F.when(after > F.col("depth"), "").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), (F.col("depth") - F.greatest(after, F.lit(1))).cast("int")), F.when(after == 0, "</ol>").otherwise("")))
    marked = rows.withColumn("html", F.concat(opens, F.lit("<li>"), label, closes))
    return marked.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "html"))), lambda x: x["html"]), "").alias("html"))
