"""Metadata picks as aggregations over records: (book, ord, name, value, id, refines, property, ...).

The first of several is the one first in document order, whatever partition it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.package import META, PREFIXES

LAST = 2147483647


def prefix_map(declared: Column) -> Column:
    """Reserved prefixes, and those that 'p: uri' pairs declare."""
    text = F.coalesce(declared, F.lit(""))
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z][\w.-]*):\s+([A-Za-z][A-Za-z0-9+.-]*:\S*)"), F.lit(1))
    uris = F.regexp_extract_all(text, F.lit(r"([A-Za-z][\w.-]*):\s+([A-Za-z][A-Za-z0-9+.-]*:\S*)"), F.lit(2))
    reserved = F.create_map(*[F.lit(x) for p in PREFIXES.items() for x in p])
    kept = F.map_filter(reserved, lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(kept, F.map_from_entries(F.arrays_zip(names, uris)))


def expand(name: Column, prefixes: Column) -> Column:
    prefix = F.substring_index(name, ":", 1)
    uri = F.try_element_at(prefixes, prefix)
    return F.when(~F.contains(name, F.lit(":")), F.concat(F.lit(META), name)).when(uri.isNull(), name).otherwise(F.concat(uri, F.regexp_replace(name, "^[^:]*:", "")))


def canonical(full: Column) -> Column:
    out = full
    for name, uri in [("schema", "https://schema.org/"), *reversed(PREFIXES.items())]:
        out = F.when(F.startswith(full, F.lit(uri)), F.concat(F.lit(name + ":"), F.substring(full, len(uri) + 1, 10_000))).otherwise(out)
    return F.when(F.startswith(full, F.lit(META)), F.substring(full, len(META) + 1, 10_000)).otherwise(out)


def refinements(records: DataFrame) -> DataFrame:
    """(book, id, property, value, ord): what refines what, first values of a property first."""
    return records.where(F.startswith("refines", F.lit("#"))).select("book", F.expr("substring(refines, 2)").alias("id"), "property", "value", "ord")


def refined(rows: DataFrame, records: DataFrame, prop: str, name: str) -> DataFrame:
    """rows (book, id) with the first value of a refining property."""
    one = refinements(records).where(F.col("property") == prop).groupBy("book", "id").agg(F.min_by("value", "ord").alias(name))
    return rows.join(one, ["book", "id"], "left")


def first_values(records: DataFrame) -> DataFrame:
    """(book, property, value): of each unrefined property the first value."""
    return records.where("refines is null and property is not null").groupBy("book", "property").agg(F.min_by("value", "ord").alias("value"))


def all_values(records: DataFrame) -> DataFrame:
    """(book, property, values): every value, in document order."""
    rows = records.where("refines is null and property is not null")
    return rows.groupBy("book", "property").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))


def main_titles(titles: DataFrame) -> DataFrame:
    """(book, title, subtitle) from titles (book, ord, value, title_type, display_seq): by display
    sequence, then document order; the main one, else the first that is no subtitle, else the first."""
    seq = F.coalesce(F.col("display_seq").try_cast("int"), F.lit(LAST))
    rank = F.when(F.col("title_type") == "main", 0).when(F.coalesce(F.col("title_type"), F.lit("")) != "subtitle", 1).otherwise(2)
    return titles.groupBy("book").agg(
        F.min_by("value", F.struct(rank.alias("rank"), seq.alias("seq"), F.col("ord"))).alias("title"),
        F.min_by(F.when(F.col("title_type") == "subtitle", F.col("value")), F.struct((rank != 2).alias("other"), seq.alias("seq"), F.col("ord"))).alias("subtitle"),
    )


def with_roles(people: DataFrame, records: DataFrame, role_property: str) -> DataFrame:
    """people (book, id, ord, name, default_role) with roles: refined ones by their last segment, else the default."""
    own = refinements(records).where(F.col("property") == role_property).groupBy("book", "id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: F.element_at(F.split(x["value"], "/"), -1))).alias("_roles"))
    return people.join(own, ["book", "id"], "left").withColumn("roles", F.coalesce("_roles", F.array("default_role"))).drop("_roles")


def by_role(people: DataFrame, role: str) -> DataFrame:
    """Authors (aut), editors (edt), translators (trl): people with that role and a name."""
    return people.where(F.array_contains("roles", role) & (F.col("name") != ""))


def publication_date(dates: DataFrame) -> DataFrame:
    """(book, date): of dates (book, ord, value, event) that of the publication event, else the first."""
    return dates.groupBy("book").agg(F.min_by("value", F.struct(~(F.coalesce(F.col("event"), F.lit("")) == "publication"), F.col("ord"))).alias("date"))


def missing_warnings(books: DataFrame) -> DataFrame:
    """(book, code) for books (book, title, identifier, languages) that lack one of them."""
    lacks = F.array_compact(F.array(
        F.when(F.coalesce("title", F.lit("")) == "", "metadata-missing-title"), F.when(F.col("identifier").isNull(), "metadata-missing-identifier"),
        F.when(F.coalesce(F.size("languages"), F.lit(0)) <= 0, "metadata-missing-language"),
    ))
    return books.select("book", F.explode(lacks).alias("code"))


def series(records: DataFrame, legacy: DataFrame) -> DataFrame:
    """(book, name, type, position): declared collections, else the legacy series entry (book, name, position)."""
    declared = records.where((F.col("property") == META + "belongs-to-collection") & F.col("refines").isNull()).select("book", "id", "ord", F.col("value").alias("name"))
    typed = refined(refined(declared, records, META + "collection-type", "type"), records, META + "group-position", "position")
    old = legacy.join(declared.select("book"), "book", "left_anti").select("book", "name", F.lit("series").alias("type"), F.col("position").try_cast("double").alias("position"))
    return typed.select("book", "name", "type", F.col("position").try_cast("double").alias("position")).union(old)
