"""Package semantics as relations: manifest, spine and resources of many books at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import is_displayable
from ..functions.uri import fragment, resource_path, without_fragment


def spine_with_items(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Itemrefs (book, pos, idref, linear) with their items; duplicates stay, missing items don't."""
    linear = F.coalesce(F.lower("linear"), F.lit("yes"))
    out = spine.withColumn("linear_invalid", ~linear.isin("yes", "no")).withColumn("linear", linear != "no")
    return out.join(manifest.withColumnRenamed("item_id", "idref"), ["book", "idref"])


def spine_errors(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """What is fatal: itemrefs without an item, and books without a linear one."""
    lost = spine.join(manifest.withColumnRenamed("item_id", "idref"), ["book", "idref"], "left_anti").select("book", F.lit("spine names a missing item").alias("message"))
    none = spine.groupBy("book").agg(F.count_if(F.coalesce(F.lower("linear"), F.lit("yes")) != "no").alias("n")).where("n = 0").select("book", F.lit("no linear reading order").alias("message"))
    return lost.union(none).distinct()


def resources_not_linear(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """Manifest items outside the linear reading order, in manifest order."""
    linear = spine.where(F.coalesce(F.lower("linear"), F.lit("yes")) != "no").select("book", F.col("idref").alias("item_id"))
    return manifest.join(linear, ["book", "item_id"], "left_anti")


def missing_resources(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Local items without an entry in the container."""
    return manifest.where("not external").join(entries.select("book", "path"), ["book", "path"], "left_anti")


def duplicates(manifest: DataFrame) -> DataFrame:
    """Ids and hrefs that a manifest declares more than once: both are fatal."""
    by = lambda c: manifest.groupBy("book", F.col(c).alias("value")).count().where("count > 1").select("book", F.lit(c).alias("what"), "value", "count")
    return by("item_id").union(by("href"))


def merged_properties(*maps: Column) -> Column:
    """Maps overlaid from left to right: the last one to name a key wins, keys keep their first place."""
    entries = F.concat(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))


def rendition(names: Column) -> Column:
    """Layout, orientation, spread, flow and page spread out of canonical property names."""

    def value(prefix: str) -> Column:
        found = F.filter(names, lambda n: F.startswith(n, F.lit(prefix)))
        return F.substring(F.try_element_at(found, F.lit(-1)), len(prefix) + 1, 1000)

    layout = value("rendition:layout-")
    return F.struct(
        F.when(layout == "pre-paginated", "fixed").when(layout == "reflowable", "reflowable").alias("layout"),
        value("rendition:orientation-").alias("orientation"), value("rendition:spread-").alias("spread"), value("rendition:flow-").alias("flow"),
        F.coalesce(value("rendition:page-spread-"), value("page-spread-")).alias("page"),
    )


def is_fixed(link_layout: Column, book_layout: Column) -> Column:
    return F.coalesce(F.when(link_layout.isin("fixed", "reflowable"), link_layout == "fixed"), book_layout == "fixed", F.lit(False))


#: Steps of a fallback chain beyond which a package is refused.
MOST_FALLBACKS = 128
_CHAIN = pa.schema([("item_id", pa.string()), ("step", pa.int32()), ("target", pa.string()), ("cyclic", pa.bool_())])


def _chains(items: list[str], fallbacks: list[str | None]) -> Iterator[tuple[str, int, str, bool]]:
    following = dict(zip(items, fallbacks, strict=True))
    for item in items:
        at, seen = following[item], {item}
        while at in following:
            yield item, len(seen), at, at in seen
            if at in seen:
                break
            seen.add(at)
            at = following[at]


def fallback_chains(manifest: DataFrame) -> DataFrame:
    """(book, item_id, step, target, cyclic): every item's fallbacks, nearest first. A chain ends where an
    item has none, is missing, or comes a second time (cyclic); its length has no bound here, see
    fallback_errors().

    Each book's items are walked in one grouped pass over their ids alone: a book has no more of them
    than its container has entries."""
    book = manifest.schema["book"].dataType

    def walk(key: tuple, items: pa.Table) -> pa.Table:
        rows = list(_chains(items.column("item_id").to_pylist(), items.column("fallback").to_pylist()))
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHAIN)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), items.schema.field("book").type), *columns], names=["book", *_CHAIN.names])

    return manifest.select("book", "item_id", "fallback").groupBy("book").applyInArrow(walk, f"book {book.simpleString()}, item_id string, step int, target string, cyclic boolean")


def fallback_errors(manifest: DataFrame, most: int = MOST_FALLBACKS) -> DataFrame:
    """(book, item_id, message): items whose fallbacks name themselves again, or go on for too long."""
    chains = fallback_chains(manifest).groupBy("book", "item_id").agg(F.max("step").alias("steps"), F.bool_or("cyclic").alias("cyclic"))
    message = F.when(F.col("cyclic"), "the fallbacks go in a circle").when(F.col("steps") > most, "the fallback chain is too long")
    return chains.select("book", "item_id", message.alias("message")).where("message is not null")


def accepted_fallback(manifest: DataFrame, missing: DataFrame, accept: Column | None = None) -> DataFrame:
    """(book, item_id, target): the item itself, or its nearest fallback that is local, present and
    accepted (by default: displayable). Items without any are left out."""
    itself = manifest.select("book", "item_id", F.lit(0).alias("step"), F.col("item_id").alias("target"))
    chains = itself.union(fallback_chains(manifest).where("not cyclic").select("book", "item_id", "step", "target"))
    good = manifest.where(accept if accept is not None else is_displayable(F.col("media_type"))).where("not external")
    good = good.join(missing.select("book", "item_id"), ["book", "item_id"], "left_anti").select("book", F.col("item_id").alias("target"))
    return chains.join(good, ["book", "target"]).groupBy("book", "item_id").agg(F.min_by("target", "step").alias("target"))


def targets(hrefs: DataFrame, reading_order: DataFrame, resources: DataFrame) -> DataFrame:
    """hrefs (book, href) with path, idx (null outside the reading order) and decoded fragment; hrefs
    that name nothing in the publication are left out. The first spine occurrence wins."""
    own = lambda df, rank: df.select("book", resource_path(F.col("href")).alias("path"), F.lit(rank).alias("rank"), F.col("idx").cast("long") if "idx" in df.columns else F.lit(None).cast("long").alias("idx"))
    known = own(reading_order, 0).unionByName(own(resources, 1)).where("path is not null")
    first = known.groupBy("book", "path").agg(F.min_by("idx", F.struct("rank", "idx")).alias("idx"))
    wanted = hrefs.withColumn("path", resource_path(without_fragment(F.col("href")))).withColumn("fragment", fragment(F.col("href")))
    return wanted.join(first, ["book", "path"])


def spine_item_of(steps: DataFrame, spine: DataFrame) -> DataFrame:
    """steps (book, step, id) with pos: the item at that step unless the id disagrees, then the itemref
    with the id, then the item with it. spine: (book, pos, step, ref_id, idref)."""
    s = spine.select("book", "pos", "step", "ref_id", "idref")
    wanted = steps.withColumn("_n", F.monotonically_increasing_id())
    at = wanted.join(s.select("book", "step", F.col("pos").alias("p"), "ref_id"), ["book", "step"]).where("id is null or id <=> ref_id").select("_n", F.lit(0).alias("rank"), (-F.col("p")).alias("o"), "p")
    by_ref = wanted.join(s.select("book", F.col("ref_id").alias("id"), F.col("pos").alias("p")), ["book", "id"]).select("_n", F.lit(1).alias("rank"), F.col("p").alias("o"), "p")
    by_item = wanted.join(s.select("book", F.col("idref").alias("id"), F.col("pos").alias("p")), ["book", "id"]).select("_n", F.lit(2).alias("rank"), F.col("p").alias("o"), "p")
    best = at.union(by_ref).union(by_item).groupBy("_n").agg(F.min_by("p", F.struct("rank", "o")).alias("pos"))
    return wanted.join(best, "_n", "left").drop("_n")

