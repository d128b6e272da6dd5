"""Search: folded matches with exact source offsets, contexts, limits, and an inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, occurrences, once, substring16, whole_word
from ..kernels import folding
from ..kernels.folding import Sensitivity
from ..kernels.units import to_units

#: Bytes of queries that one pass carries to every task; more queries go in several passes.
QUERY_BYTES = 4 << 20


def checked(max_results: int, context: int) -> None:
    if max_results <= 0 or context < 0:
        raise ValueError("a result limit is positive and a context is not negative")


def counts(blocks: DataFrame, query: str, text: str = "text", case: bool = False, diacritics: bool = False) -> DataFrame:
    """`blocks` with n, the matches in each: built-ins only, and each text is folded once."""
    needle = folding.needle_of(query, Sensitivity(case, diacritics))
    return blocks.withColumn("n", once(F.col(text), lambda t: once(fold(t, case, diacritics), lambda f: occurrences(f, F.lit(needle)))))


def word_counts(blocks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The same for whole words; the pattern only runs where the folded text holds the query at all."""
    needle = folding.needle_of(query)
    found = lambda f: F.when(F.contains(f, F.lit(needle)), whole_word(f, needle)).otherwise(0)
    return blocks.withColumn("n", once(F.col(text), lambda t: once(fold(t), found)))


def hits(blocks: DataFrame, queries: DataFrame, keys: list[str], text: str = "text", case: bool = False, diacritics: bool = False, whole: bool = False, most: int | None = None) -> DataFrame:
    """keys, query_id, query, start, end (UTF-16 units of the block's text) of every match. With `most`, a
    partition stops looking for a query after so many matches in the order of its rows; see first_hits().

    queries (query_id, query) are collected in passes of at most QUERY_BYTES, checked by a sum first; each
    block is folded once a pass, and then searched for each query."""
    rule = Sensitivity(case, diacritics)
    total = queries.agg(F.sum(F.octet_length("query"))).first()[0] or 0
    passes = max(1, -(-total // QUERY_BYTES))
    source = blocks.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in source.schema if c.name != "_text"), "query_id bigint, query string, start int, end int"])

    def with_queries(asked: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            needles = [(i, q, n) for i, q in asked if (n := folding.needle_of(q, rule))]
            open_ = [[*needle, most] for needle in needles]
            for batch in batches:
                owner, out = [], []
                for row, value in enumerate(batch.column(len(keys)).to_pylist() if open_ else ()):
                    if not value or not open_:
                        continue
                    units = to_units(value)
                    folded = folding.fold(units, rule)
                    for needle in open_:
                        i, q, n, left = needle
                        spans = list(islice(folding.find(n, folded, units, whole), left))
                        owner += [row] * len(spans)
                        out += [(i, q, a, b) for a, b in spans]
                        needle[3] = left and left - len(spans)
                    open_ = [needle for needle in open_ if needle[3] != 0]
                kept = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=[*keys, "query_id", "query", "start", "end"])

        return run

    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id", "query"), F.lit(passes)) == p)
        asked = [(r["query_id"], r["query"]) for r in part.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("string").alias("query")).collect() if r["query"]]
        found = source.mapInArrow(with_queries(asked), schema)
        out = found if out is None else out.union(found)
    return out


def first_per_query(found: DataFrame, order: list[str], max_results: int = 1000) -> DataFrame:
    """The first results of every query. Spark limits each task's rows before the exchange, so a query
    with very many hits sends max_results rows a task."""
    checked(max_results, 0)
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_results)


def first_hits(blocks: DataFrame, queries: DataFrame, keys: list[str], max_results: int = 1000, **options) -> DataFrame:
    """The first results of every query in the order of `keys`, with rank, searched with an early stop:
    each partition is put in order, and searched until it has max_results of a query."""
    checked(max_results, 0)
    found = hits(blocks.sortWithinPartitions(*keys), queries, keys, most=max_results, **options)
    return first_per_query(found, [*keys, "start"], max_results)


def with_context(found: DataFrame, text: Column, context: int = 40) -> DataFrame:
    """before, highlight and after of each hit; offsets in UTF-16 units."""
    checked(1, context)
    part = lambda a, b: F.nullif(substring16(text, F.greatest(a, F.lit(0)), b), F.lit(""))
    return found.withColumn("before", part(F.col("start") - context, F.col("start"))).withColumn("highlight", part(F.col("start"), F.col("end"))).withColumn("after", part(F.col("end"), F.col("end") + context))


def index(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """An inverted index: (token, keys) of the folded words of each block, once each."""
    words = F.array_distinct(F.filter(F.split(fold(F.col(text)), r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != ""))
    return blocks.select(*keys, F.explode(words).alias("token"))


def candidates(blocks: DataFrame, inverted: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """Blocks that hold every inner word of a query, by semi-joins with the index: what lies between two
    spaces of the query is a whole word there too. A query without such words keeps all blocks."""
    words = folding.needle_of(query).split(" ")[1:-1]
    out = blocks
    for word in words:
        if word.isalnum():
            out = out.join(inverted.where(F.col("token") == word).select(*keys), keys, "left_semi")
    return out
