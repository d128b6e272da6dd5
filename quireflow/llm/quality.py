"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of word bytes (letters, digits, non-ASCII) and runs of other non-space bytes, case
kept. Features are hashes of tokens and of pairs of neighbours in 2**bits cells, where a pair or
skip pair of one word with itself counts as the pattern "again" whatever the word is; a cell's value
is its count over the square root of the row's feature count, so a score is one sparse dot product.

Training reads at most `most_rows` labelled rows (a documented bound: those whose id hashes
lowest), in one task, in hash order, so the model is the same in every run. Scoring reads every
row. Only texts are inputs.

Defined results: a null or empty text gets the bias alone; repeated labels of an id count as
their maximum; null labels and ids are not learnt from; with no labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import small_batches

BITS = 18
#: Labelled rows that training reads at most.
MOST_ROWS = 6000

_SPACE = K.byte_table((0x09, 0x0D), (0x20, 0x20))
_WORD = K.byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_AGAIN = K.uniform_bits(2, 20_023)
_KIND = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(bounds: np.ndarray, data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every feature occurrence of a slice, rows in order."""
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[[0, -1]] = True
    if len(data):
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[bounds] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    told = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[told], ends[told]
    rows = np.searchsorted(bounds, starts, "right") - 1
    tokens = K.range_hashes(K.prefix_hashes(data), starts, ends)
    word = kind[starts] == 1
    pairs = K.window_starts(rows, 2)
    joint = K.window_hashes(tokens, pairs, 2)
    joint[(tokens[pairs] == tokens[pairs + 1]) & word[pairs]] = _AGAIN[0]
    skips = K.window_starts(rows, 3)
    skips = skips[(tokens[skips] == tokens[skips + 2]) & word[skips]]
    both = np.concatenate([tokens, joint, np.full(len(skips), _AGAIN[1])])
    owner = np.concatenate([rows, rows[pairs], rows[skips]])
    order = np.argsort(owner, kind="stable")
    return owner[order], (both[order] >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, cells: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(cells), np.zeros(cells)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, text: str = "text", label: str = "label", order: str = "doc_id", bits: int = BITS, epochs: int = 4, most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights of 2**bits cells and a bias, from at most `most_rows` rows of `labelled`."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            y = batch.column(1).to_pylist()
            for lo, hi, bounds, data in K.slices(batch.column(0)):
                owner, cells = features(bounds, data, bits)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    at, count = np.unique(cells[cut[i] : cut[i + 1]], return_counts=True)
                    x = count / max(1.0, float(cut[i + 1] - cut[i])) ** 0.5
                    rows.append((np.append(at, 1 << bits), np.append(x, 1.0), y[lo + i]))
        model = Ftrl((1 << bits) + 1)
        for _ in range(epochs if rows else 0):
            for at, x, y in rows:
                model.learn(at, x, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "w"])

    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(order).cast("string")).alias("h"), F.col(order).alias("o"))
    few = rows.where("y is not null").orderBy("h", "o", "t").limit(most_rows).select("t", "y")  # top rows by partition, then in one task
    weights = np.zeros((1 << bits) + 1)
    for batch in few.mapInArrow(K.lean(fit), "at bigint, w double").toArrow().to_batches():
        weights[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return weights


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """At most `most_rows` labelled ids outside the held-out third, with their texts. The ids that
    are broadcast are bounded by most_rows."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most_rows)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(few), "doc_id")


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1; a column `name` of docs is replaced."""
    docs = docs.drop(name) if name != text else docs
    small_batches(docs.sparkSession)
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, bounds, data in K.slices(batch.column(column)):
                owner, cells = features(bounds, data, bits)
                total = np.bincount(owner, w[cells], minlength=hi - lo)
                count = np.bincount(owner, minlength=hi - lo)
                out.append(1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(K.lean(run), schema)
