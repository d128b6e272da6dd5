"""A bulk run over a library: open, read everything, extract, prepare, count positions, check, and say how
each book came out. Errors are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import len16
from ..sources.library import Library
from . import positions, reader, text


def positions_of(library: Library, width: int = positions.WIDTH) -> DataFrame:
    """Position resources of all books: fixed layout is decided before anything is read."""
    order = library.reading_order.join(library.books.select("book", F.col("metadata.layout").alias("book_layout")), "book")
    fixed = F.coalesce(F.when(F.col("properties")["layout"].isin("fixed", "reflowable"), F.col("properties")["layout"] == "fixed"), F.col("book_layout") == "fixed", F.lit(False))
    order = order.select("book", "idx", "href", fixed.alias("fixed"))
    read = text.extract(library.documents().drop("error"), keep=["book", "idx"]).select("book", "idx", "len16", F.col("error").isNotNull().alias("bad"))
    joined = order.join(read, ["book", "idx"], "left")
    length = F.when(~F.col("fixed"), F.col("len16")).cast("long")
    return positions.resources(joined.select("book", "idx", "href", length.alias("length"), (F.coalesce("bad", F.lit(False)) & ~F.col("fixed")).alias("unreadable")), width)


def run(library: Library, expectations: DataFrame | None = None) -> DataFrame:
    """(book, outcome, detail, documents, unreadable, positions, prepared). expectations (book, check, want)
    are compared with checks(); a book fails if any differs."""
    opened = library.books.select("book", F.col("error").alias("open_error"))
    documents = library.documents()
    read = text.extract(documents.drop("error"), keep=["book", "idx"]).groupBy("book").agg(F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("unreadable"))
    shown = reader.prepared(documents.withColumn("fixed", F.lit(False))).groupBy("book").agg(F.count_if(F.col("error").isNull()).alias("prepared"))
    placed = positions_of(library).groupBy("book").agg(F.sum("count").alias("positions"))
    out = opened.join(read, "book", "left").join(shown, "book", "left").join(placed, "book", "left")
    if expectations is not None:
        wrong = expectations.join(checks(library), ["book", "check"], "left").where("not (want <=> value)").groupBy("book").agg(F.array_join(F.sort_array(F.collect_list("check")), ", ").alias("wrong"))
        out = out.join(wrong, "book", "left")
    else:
        out = out.withColumn("wrong", F.lit(None).cast("string"))
    outcome = F.when(F.col("open_error").isNotNull(), F.concat(F.lit("refused:"), F.col("open_error.kind"))).when(F.col("wrong").isNotNull(), "failed").when(F.coalesce("unreadable", F.lit(0)) > 0, "unreadable").otherwise("passed")
    return out.select("book", outcome.alias("outcome"), F.coalesce("wrong", F.col("open_error.message")).alias("detail"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("unreadable", F.lit(0)).alias("unreadable"), "positions", F.coalesce("prepared", F.lit(0)).alias("prepared"))


def checks(library: Library) -> DataFrame:
    """(book, check, value): keyed facts of every book, as strings, to be joined with what is expected."""
    b = library.books.where("error is null")
    hrefs = F.transform(F.filter("spine", lambda s: s["linear"]), lambda s: s["href"])
    facts = {
        "title": F.col("metadata.title"), "language": F.element_at("metadata.languages", 1), "layout": F.col("metadata.layout"), "direction": F.col("metadata.reading_progression"),
        "spine": F.size("spine").cast("string"), "linear": F.size(F.filter("spine", lambda s: s["linear"])).cast("string"), "manifest": F.size("manifest").cast("string"),
        "toc": F.size(F.filter("nav", lambda n: n["kind"] == "toc")).cast("string"), "landmarks": F.size(F.filter("nav", lambda n: n["kind"] == "landmarks")).cast("string"),
        "pages": F.size(F.filter("nav", lambda n: n["kind"] == "page-list")).cast("string"), "missing": F.size("missing").cast("string"), "encrypted": F.size("encryption").cast("string"),
        "warnings": F.array_join(F.array_sort(F.array_distinct(F.col("warnings.code"))), ","), "authors": F.array_join(F.col("metadata.authors.name"), ", "),
        "package": F.col("package_path"), "identifier": F.col("identifier"), "subtitle": F.col("metadata.subtitle"), "languages": F.array_join("metadata.languages", ", "),
        "order": F.array_join(hrefs, " "), "first": F.element_at(hrefs, 1), "repeated": (F.size(hrefs) - F.size(F.array_distinct(hrefs))).cast("string"), "contributors": F.array_join(F.col("metadata.contributors.name"), ", "),
        "author_directions": F.array_join(F.transform("metadata.authors", lambda a: F.coalesce(a["direction"], F.lit("none"))), ", "), "toc_titles": F.array_join(F.transform(F.filter("nav", lambda n: n["kind"] == "toc"), lambda n: n["title"]), "|"),
        "published": F.date_format("metadata.published", "yyyy-MM-dd"), "modified": F.date_format("metadata.modified", "yyyy-MM-dd"), "duration": (F.col("metadata.duration_us") / 1e6).cast("bigint").cast("string"), "cover": F.col("metadata.cover"),
        "collections": F.array_join(F.transform("collections", lambda c: c["role"]), ", "), "links": F.array_join(F.flatten(F.transform("links", lambda x: x["rels"])), ", "), "external": F.size(F.filter("manifest", lambda i: i["external"])).cast("string"),
        "fonts": F.array_join(F.array_sort(F.map_keys("encryption")), ", "), "fallbacks": F.size(F.filter("manifest", lambda i: i["fallback"].isNotNull())).cast("string"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value")) for k, v in facts.items()])
    return b.select("book", F.explode(rows).alias("f")).select("book", "f.check", "f.value")


def text_lengths(documents: DataFrame) -> DataFrame:
    """(book, idx, length) of plain text documents (book, idx, text)."""
    return documents.select("book", "idx", len16(F.col("text")).cast("long").alias("length"))


def document_checks(library: Library) -> DataFrame:
    """(book, idx, check, value) of what a reader shows of each document: whether anything active or any file
    URL is left, whether it is laid out in columns, how many references climb out, and what can't be shown."""
    shown = reader.prepared(library.documents().withColumn("fixed", F.lit(False)).withColumn("book", F.struct("book", "idx")))
    count = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("string")
    facts = {
        "active": F.coalesce(F.col("html").rlike("(?i)<iframe|<script[^>]*>[^<]|javascript:"), F.lit(False)).cast("string"), "file_urls": count('(?i)(src|href|data)="\\s*file:'), "columns": F.coalesce(F.contains("html", F.lit("column-width")), F.lit(False)).cast("string"),
        "images": count("(?i)<img"), "error": F.col("error"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value")) for k, v in facts.items()])
    return shown.select(F.col("book.book").alias("book"), F.col("book.idx").alias("idx"), F.explode(rows).alias("f")).select("book", "idx", "f.check", "f.value")
