"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against token windows.

Words are maximal runs of ASCII letters and digits and of every non-ASCII character, A-Z
lower-cased. A window of an item is `width` consecutive words of it; an item with fewer words,
but at least one, is one window of all its words. Document windows are hashed in numpy and
looked up in the sorted window hashes; every hit is then verified word by word, so a hash
collision can't mark anything.

The needles are read in blocks of at most `block_bytes` of item text (checked by a sum before
anything is collected), so what is broadcast has a fixed bound. One block is the usual case; with
more, the documents pass over the blocks one after another, each pass cut by a written table.

Defined results: a null or wordless text has no words and is never contaminated; a null or
wordless item matches nothing; an item with a null id hits words but is not listed; repeated
items count once by id; repeated documents give one row each; extra columns are passed on, those
that bear a name of the results are replaced by them. A very long text is scanned in one task, in
memory of about ten times its size; so is a very long item, in its pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import cut, small_batches

WORD = K.byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: 2000 block_bytes of text become about ten times as much in needles.
BLOCK_BYTES = 8 << 20

_FOUND = "array<struct<begin:bigint,end:bigint,first:bigint,last:bigint>>"


@dataclass
class Needles:
    """Windows of one block of items: by width, sorted hashes; by words, the items."""

    hashes: dict[int, np.ndarray]
    items: dict[bytes, frozenset]


def _words(text: bytes) -> list[bytes]:
    data = K.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = K.runs(np.array([0, len(data)]), WORD[data])
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def needles(rows: list[tuple], width: int) -> Needles:
    """The windows of (item id, text) rows."""
    exact: dict[bytes, set] = {}
    hashes: dict[int, set] = {}
    for item, text in rows:
        words = _words((text or "").encode())
        if not words:
            continue
        n = min(width, len(words))
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, at = K.runs(np.array([0, len(data)]), data != 0x20)
        tokens = K.range_hashes(K.prefix_hashes(data), starts, ends)
        hashes.setdefault(n, set()).update(K.window_hashes(tokens, K.window_starts(at, n), n).tolist())
        for i in range(len(words) - n + 1):
            exact.setdefault(b" ".join(words[i : i + n]), set()).add(None if item is None else str(item))
    return Needles({n: np.array(sorted(x), np.uint64) for n, x in sorted(hashes.items())}, {k: frozenset(v) for k, v in exact.items()})


def _scan_slice(bounds: np.ndarray, data: np.ndarray, needle: Needles) -> tuple[np.ndarray, list[list], list[set]]:
    """Words of each row, its hit runs (begin and end byte, first and last word + 1), its items."""
    n = len(bounds) - 1
    low = K.LOWER[data]
    starts, ends, rows = K.runs(bounds, WORD[low])
    found: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    n_words = K.counts_by_row(rows, n)
    if not len(starts) or not needle.hashes:
        return n_words, found, items
    tokens = K.range_hashes(K.prefix_hashes(low), starts, ends)
    hit = np.zeros(len(starts) + 1, np.int64)
    raw = None
    for width, known in needle.hashes.items():
        at = K.window_starts(rows, width)
        if not len(at):
            continue
        hashes = K.window_hashes(tokens, at, width)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        for first in at[known[place] == hashes].tolist():
            raw = raw or low.tobytes()
            names = needle.items.get(b" ".join(raw[a:b] for a, b in zip(starts[first : first + width].tolist(), ends[first : first + width].tolist(), strict=True)))
            if names is not None:
                hit[first] += 1
                hit[first + width] -= 1
                items[rows[first]] |= names
    covered = np.cumsum(hit[:-1]) > 0
    first_word = np.searchsorted(rows, np.arange(n))
    words_at = np.append(first_word, len(rows))
    for a, b, row in zip(*K.runs(words_at, covered), strict=True):
        found[row].append((int(starts[a] - bounds[row]), int(ends[b - 1] - bounds[row]), int(a - first_word[row]), int(b - first_word[row])))
    return n_words, found, items


def _merged(runs: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for begin, end, first, last in sorted(runs, key=lambda x: x[2]):
        if out and first <= out[-1][3]:
            if last > out[-1][3]:
                out[-1][1], out[-1][3] = end, last
        else:
            out.append([begin, end, first, last])
    return [tuple(x) for x in out]


def _pass(shared, text_at: int, name_found: str, name_items: str, name_words: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needle = shared.value
        for batch in batches:
            words, found, items = [], [], []
            for lo, hi, bounds, data in K.slices(batch.column(text_at)):
                w, f, i = _scan_slice(bounds, data, needle)
                words.append(w)
                found += f
                items += i
            if name_found in batch.schema.names:
                old = batch.column(batch.schema.get_field_index(name_found)).to_pylist()
                found = [_merged([tuple(x.values()) for x in a] + b) for a, b in zip(old, found, strict=True)]
                items = [set(a) | b for a, b in zip(batch.column(batch.schema.get_field_index(name_items)).to_pylist(), items, strict=True)]
                batch = batch.drop_columns([name_words, name_found, name_items])
            span = pa.list_(pa.struct([(x, pa.int64()) for x in ("begin", "end", "first", "last")]))
            cols = [
                pa.array(np.concatenate(words) if words else [], pa.int64()),
                pa.array([[dict(zip(("begin", "end", "first", "last"), x, strict=True)) for x in f] for f in found], span),
                pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, name_words, name_found, name_items])

    return run


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, found (hit runs by byte and word) and items (ids with an occurring
    window, sorted). Columns of these names in `docs` are replaced."""
    spark = docs.sparkSession
    docs = docs.drop(*({"n_words", "found", "items"} - {text}))
    small_batches(spark)
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total > block_bytes:  # repeated items would meet in one pass
        rows = cut(rows.where("t is not null").distinct(), "items")
        total = 2 * (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0)  # dealt by hash, passes differ in size
    blocks = max(1, -(-total // block_bytes))
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema), "n_words bigint", f"found {_FOUND}", "items array<string>"])
    out = docs
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(needles([tuple(r) for r in part.collect()], width))
        out = out.mapInArrow(K.lean(_pass(shared, docs.columns.index(text), "found", "items", "n_words")), schema)
        if block + 1 < blocks:
            out = cut(out, "decontaminate")
    return out


def summary(scanned: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated: hit words times `share` reach all words."""
    n_hit = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return (
        scanned.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents that are not contaminated, with their own columns, whatever those are called."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = summary(scan(plain, items, text=f"c{docs.columns.index(text)}", **options)).where(~F.col("contaminated"))
    return kept.select(*plain.columns).toDF(*docs.columns)


def strip_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, hit runs cut out of the text (from a run's first word to its last)."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    raw, out, last = texts[i].encode(), [], 0
                    for s in spans:
                        out.append(raw[last : s["begin"]])
                        last = s["end"]
                    texts[i] = b"".join([*out, raw[last:]]).decode()
            cols = [*batch.columns[:-1]]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    cut_texts = scan(plain, items, text=f"c{at}", **options).select(*plain.columns, "found").mapInArrow(cut_out, plain.schema)
    return cut_texts.toDF(*docs.columns)


def digest_of(ids: list[str]) -> str:
    """The digest that summary() gives for these ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
