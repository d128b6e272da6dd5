"""How plain tables stand in for a library: documents by source, pages by host, chats by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import len16
from ..functions.uri import host
from ..operators.running import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan, dealt over all cores where the scan has fewer partitions than there are cores: a file of
    one row group would keep a single core busy with all its texts. A scan of as many partitions or more,
    so any large one, stays as it is and is not shuffled. For scans only: their partitions are known
    without running anything."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """(book = source, idx, doc_id, ...): a source's documents by id."""
    rows = table(spark, folder, "documents").select(F.col("source").alias("book"), "doc_id", *more)
    return numbered(rows, "book", "doc_id", "idx")


def document_resources(spark: SparkSession, folder: str) -> DataFrame:
    """documents() as position resources: lengths, no text."""
    rows = table(spark, folder, "documents").select(F.col("source").alias("book"), "doc_id", len16(F.col("text")).cast("long").alias("length"))
    return numbered(rows, "book", "doc_id", "idx").withColumn("href", F.col("doc_id").cast("string")).withColumn("unreadable", F.lit(False))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(book = host, page_id, path, media_type, content)."""
    rows = spread(table(spark, folder, "pages").select("page_id", "url", "html"))
    return rows.select(host(F.col("url")).alias("book"), "page_id", F.col("page_id").cast("string").alias("path"), F.lit("text/html").alias("media_type"), F.col("html").alias("content"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, block, text): non-empty collapsed lines of documents, as blocks."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    rows = rows.withColumn("block", F.col("block").cast("long"))
    return rows.withColumn("text", F.trim(F.regexp_replace("line", "[ \t\r\f]+", " "))).where("text != ''").drop("line")


def reader_events(spark: SparkSession, folder: str) -> DataFrame:
    """(reader, ts, type, payload, event_id) of the events table."""
    return table(spark, folder, "events").select(F.col("user_id").alias("reader"), "ts", F.col("event_type").alias("type"), F.col("props").alias("payload"), "event_id", "value")
