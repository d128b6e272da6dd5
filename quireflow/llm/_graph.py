"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, forget, tracked


def _towards_min(edges: DataFrame) -> DataFrame:
    """Each (u, v) as (u, v, m) with m the least of u and all its v. Minima are aggregated before
    the join, and the join's hot keys can be split, so a hub does not meet in one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) for every id of `edges` (columns a, b of one orderable type); root is the least
    id that can be reached. Every round is cut by a written table. The rounds grow with the logarithm
    of the longest shortest path, so 40 are for paths of any length that a table can hold; if they
    should not do, an error says so and no wrong answer is given."""
    spark = edges.sparkSession
    with tracked() as passed:
        e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == seen:
            break
        seen = (n, total)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _towards_min(large.where("u != v").distinct())
        joined = small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        with tracked() as made:
            e = cut(joined.distinct(), "edges")
        forget(spark, passed)
        passed = made
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
