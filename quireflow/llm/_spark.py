"""Spark plumbing shared by the operators: tables, the shared scratch folder, written cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch; a single longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where spark.checkpoint.dir is unset, as in tests on one machine, a temporary folder
    is made and set.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = jsc.getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quireflow-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of a few megabytes, however long they are: two
    workers and their executor share one memory limit. The setting stays on the session, as frames
    are evaluated later: it bounds memory and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, which reaches every store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: The lists that note what is cut, innermost last. A context variable: each thread has its own, so
#: queries that run side by side never see, or delete, each other's tables.
_noting: ContextVar[tuple[list[str], ...]] = ContextVar("noting", default=())


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths of the scratch tables that are cut inside."""
    paths: list[str] = []
    token = _noting.set((*_noting.get(), paths))
    try:
        yield paths
    finally:
        _noting.reset(token)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: a cut in its lineage that outlives
    lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    for paths in _noting.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no frame in use still reads."""
    while paths:
        remove(spark, paths.pop())


def shuffle_width(spark: SparkSession, size_bytes: float, per_task: float = 16 << 20) -> int:
    """Partitions for so many bytes, no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size_bytes // per_task) + 1)


def with_ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
