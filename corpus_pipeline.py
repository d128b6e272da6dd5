"""A training-corpus pipeline over the documents table: five stages, each one of the operators.

Every stage reads the whole table that its predecessor returned, as Parquet, and all but the last
return the columns of documents, whatever they are called. Ids may be null or repeat: rows are told apart
by id and text. Null and empty texts pass every filter but the first, which judges them by its bias; an
empty table gives an empty table.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import decontaminate, jaccard, pieces, quality, suffix_dedup
from quireflow.llm._spark import forget, scratch, table, tracked


#: Scratch tables of the stage that this thread called last.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def _stage(apply):
    """A stage that first deletes the scratch tables of the stage before: its result is a table by now."""

    @wraps(apply)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, list(_scratch.get()))
        with tracked() as made:
            out = apply(spark, docs, sf_dir)
        _scratch.set(tuple(made))
        return out

    return staged


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: no name of theirs can meet one of ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _column(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the
    held-out third. A null or empty text is judged by the bias alone."""
    weights = quality.train(quality.sample(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(_plain(docs), weights, text=_column(docs, "text"), name="score").where("score >= 0.5").drop("score")
    return scored.toDF(*docs.columns)


@_stage
def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at 0.8 or more: the one with the
    least id, rows without an id last. Rows that repeat one id (or none) and one text are one document,
    of which any row stays; null and empty texts link with nothing."""
    found = jaccard.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept").groupBy("key").agg(F.count("*").alias("rows"))
    plain = _plain(docs).withColumn("key", jaccard.key_of(_column(docs, "text"), _column(docs, "doc_id")))
    joined = plain.join(kept, "key")
    out = joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["key"]))
    return out.drop("key", "rows").toDF(*docs.columns)


#: Words of a passage that must not be in two places.
PASSAGE = 50


@_stage
def repeat_remover(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of PASSAGE words that also start elsewhere, in the
    same document or another; n_chars is counted anew where words go. Null and empty texts stay."""
    found = suffix_dedup.passages(docs, words=PASSAGE).select("key", "kept").dropDuplicates(["key"])
    text, n_chars = _column(docs, "text"), _column(docs, "n_chars")
    plain = _plain(docs)
    joined = plain.withColumn("key", suffix_dedup.key_of(text, _column(docs, "doc_id"))).join(found, "key", "left")
    changed = F.col("kept").isNotNull()
    out = joined.withColumn(text, F.when(changed, F.col("kept")).otherwise(F.col(text))).withColumn(n_chars, F.when(changed, F.length("kept")).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns).toDF(*docs.columns)


@_stage
def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and wordless texts never are."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def piece_sampler(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every text that is left, with their inclusion scores; a null or
    empty text has the empty one."""
    sampled = pieces.sample(docs.select("doc_id", "text"), pieces.vocabulary(), k=2, with_ids=False)
    found = [F.col("samples")[name].alias(name) for name in ("n_pieces", "log_p", "log_inclusion", "ids_sha256")]
    return sampled.select("doc_id", "n_units", *found, "round_trip", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("suffix_array_dedup", repeat_remover),
    ("benchmark_decontamination", benchmark_filter),
    ("sentencepiece_sampling", piece_sampler),
]

#: Stages 1, 3 and 5 can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
