"""Running values over a key that may hold a third of all rows.

A plain window puts all rows of a key in one task. Here rows are cut into blocks of the order column,
blocks are summed up with partial aggregation, a window runs over the few block rows, and the
rows' own windows run inside blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK, total: str | None = None) -> DataFrame:
    """`name`: the sum of value over the rows before this one (by order, then by the value itself);
    `total`: over all rows of the key."""
    rows = _blocked(df, order, block).withColumn("_value", value)
    sums = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(key).orderBy("_block")
    before = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(key)).alias("_total"))
    joined = rows.join(before, rows[key].eqNullSafe(before["_key"]) & rows["_block"].eqNullSafe(before["_b"]))
    inner = Window.partitionBy(key, "_block").orderBy(order, "_value").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(name, (F.col("_before") + F.coalesce(F.sum("_value").over(inner), F.lit(0))).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_block", "_value", "_key", "_b", "_before", "_total")


def numbered(df: DataFrame, key: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """`name`: the row's number within its key, from 0."""
    return running_sum(df, key, order, F.lit(1), name, block)


def last_before(df: DataFrame, key: str, order: list[str], block: str, value: str, name: str) -> DataFrame:
    """`name`: the last value that is not null at or before the row in (block, *order)."""
    at = F.struct("_here", *order)
    rows = df.withColumn("_here", F.col(block))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key, "_here").agg(F.max_by(value, at).alias("_end"))
    every = rows.select(key, "_here").distinct().join(ends, [key, "_here"], "left")
    w = Window.partitionBy(key).orderBy("_here").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(w)).select(key, "_here", "_carried")
    inner = Window.partitionBy(key, "_here").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, [key, "_here"]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_carried")))
    return out.drop("_here", "_carried")
