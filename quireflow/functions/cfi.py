"""CFIs in columns. Reading and writing the grammar are Arrow-batched Python functions; order and
containment are comparisons of key arrays, which Catalyst does itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import cfi as C



def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Types as objects: a type in text form needs a running session already at import.
KEY = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), *(T.StructField(v, T.DoubleType()) for v in ("v1", "v2", "v3"))]))
PARSED = T.StructType(
    [
        T.StructField("canonical", T.StringType()), T.StructField("is_range", T.BooleanType()), T.StructField("steps", T.ArrayType(T.IntegerType())), T.StructField("start_key", KEY),
        T.StructField("end_key", KEY), T.StructField("error", T.StringType()), T.StructField("error_at", T.IntegerType()),
    ]
)


def _key(rows: list[tuple]) -> list[dict]:
    return [dict(zip(("rank", "v1", "v2", "v3"), r, strict=True)) for r in rows]


def _parsed(source: str | None) -> dict:
    out = dict.fromkeys(("canonical", "is_range", "steps", "start_key", "end_key", "error", "error_at"))
    if source is None:
        return out
    try:
        c = C.parse(source)
    except C.CfiError as error:
        return out | {"error": str(error), "error_at": error.at}
    a, b = c.keys()
    return out | {"canonical": str(c), "is_range": c.is_range, "steps": [s.index for s in c.start_path.steps], "start_key": _key(a), "end_key": _key(b)}


@F.pandas_udf(PARSED)
def cfi_parse(source: pd.Series) -> pd.DataFrame:
    """Canonical form, step indices and sort keys; error and its place where the text is no CFI."""
    return pd.DataFrame([_parsed(s) for s in source], columns=["canonical", "is_range", "steps", "start_key", "end_key", "error", "error_at"])


@F.pandas_udf(T.StringType())
def cfi_between(a: pd.Series, b: pd.Series) -> pd.Series:
    """The smallest range from one point to another; null where there is none."""

    def one(x, y):
        p, q = C.try_parse(x), C.try_parse(y)
        try:
            return None if p is None or q is None else str(C.between(p, q))
        except C.CfiError:
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(_strings("package", "content"))
def cfi_split(source: pd.Series) -> pd.DataFrame:
    """A publication CFI as the package path of a spine item and the CFI inside its document."""

    def one(s):
        c = C.try_parse(s)
        parts = None if c is None else C.split(c)
        if parts is None:
            return None, None
        return C.expression(C.Cfi(parts[0])), None if parts[1] is None else C.expression(parts[1])

    return pd.DataFrame([one(s) for s in source], columns=["package", "content"])


@F.pandas_udf(_strings("bias", "step_id", "before", "after"))
def cfi_assertions(source: pd.Series) -> pd.DataFrame:
    """Side bias, the last step's id and the text assertions of a point."""

    def one(s):
        c = C.try_parse(s)
        if c is None or c.is_range:
            return None, None, None, None
        o, last = c.path.offset, c.path.steps[-1]
        return C.side_bias(o.parameters if o else last.parameters), last.id, o and o.before, o and o.after

    return pd.DataFrame([one(s) for s in source], columns=["bias", "step_id", "before", "after"])


def contains(outer: Column, inner: Column) -> Column:
    """Of two cfi_parse columns: whether the second lies within the first."""
    return (outer["start_key"] <= inner["start_key"]) & (inner["end_key"] <= outer["end_key"])


def order(parsed: Column) -> list[Column]:
    """What to sort by."""
    return [parsed["start_key"], parsed["end_key"]]


def step_key(steps: Column) -> Column:
    """The sort key of a plain path of child steps (array of indices), without Python."""
    none = F.lit(-1.0)
    return F.transform(steps, lambda s: F.struct(F.lit(2).alias("rank"), s.cast("double").alias("v1"), none.alias("v2"), none.alias("v3")))


def join_publication(package: Column, content: Column) -> Column:
    """A publication CFI from a spine item's package path and a content CFI's expression."""
    return F.concat(F.lit("epubcfi("), package, F.lit("!"), content, F.lit(")"))


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL."""
    for name, f in (("cfi_parse", cfi_parse), ("cfi_between", cfi_between), ("cfi_split", cfi_split), ("cfi_assertions", cfi_assertions)):
        spark.udf.register(name, f)
