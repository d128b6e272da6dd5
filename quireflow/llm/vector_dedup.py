"""Embedding near-dedup: a subspace pigeonhole join over rotated vectors.

Unit vectors with cosine >= c are at squared distance <= 2 - 2c. They are turned by a fixed random
rotation and split into blocks of coordinates; the squared distances of the blocks add up to the
whole one, so a linking pair is within its proportional share in at least one block. Each block is a
range join: rows are tiled by the block's first coordinate, a tile meets only the tiles within
reach, and inside two tiles the block's distances are a small matrix product. What passes is
verified on the full vectors in double precision. A pair is counted in the first block where it
passes, so the union of the blocks holds each pair once.

Equal vectors are one class and never paired. Tasks give link counts and the edges of a spanning
forest, never pairs, so a group of many near copies costs products but no rows.

Every linking pair is found (recall 1). The price is that tiles within reach grow in number with
the rows: for vectors without any structure the work of an exact join stays quadratic.

Vectors of every length are compared, each with those of its own length: lengths have rotations and
tiles of their own, and all go through the same tasks. The driver holds one row for each length.

Defined results: vectors that are null, empty, zero, or contain null or non-finite components link with
nothing, and neither do vectors of different lengths; rows with a null id count as neighbours but
have a null component; repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, shuffle_width, small_batches

BLOCKS = 4
#: Rows of a tile: at least and at most. A task holds two tiles.
LEAST_TILE, MOST_TILE = 2048, 32768
_PIECE = 1024
_SLACK = 1e-7  # of a share, for rounding


@cache
def rotation(dim: int, seed: int = 20_033) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, dim, v): dim 0 for vectors that link with nothing, v their bytes."""
    for batch in batches:
        dims, raw = [], []
        for v in batch.column(1):
            x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
            dims.append(len(x) if ok else 0)
            raw.append((x + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "dim", "v"])


def edges_of(dim: int, blocks: int) -> list[tuple[int, int]]:
    """The coordinates of each block."""
    cuts = [dim * i // min(blocks, dim) for i in range(min(blocks, dim) + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def reach_of(dim: int, blocks: int, least: float) -> np.ndarray:
    """How far two vectors that link can be apart in a block that is within its share."""
    return np.sqrt((2 - 2 * least) * np.array([b - a for a, b in edges_of(dim, blocks)]) / dim + 1e-6) + 1e-9


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) of a column of vectors as bytes."""
    sizes = np.array([len(v) // 8 for v in column.to_pylist()])
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def _firsts(blocks: int):
    """(id, n, v) -> the same with the first turned coordinate of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_length(batch.column(2)):
                part = batch.take(pa.array(rows))
                starts = [a for a, _ in edges_of(dim, blocks)]
                y = _unit(np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(-1, dim)) @ rotation(dim)[:, starts]
                firsts = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), len(starts)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, firsts], names=["id", "n", "v", "at"])

    return run


def _deal(marks: dict[int, list[list[float]]], blocks: int, least: float):
    """(id, n, v, at) -> (dim, block, s, t, side, id, n, v): a row for each pair of tiles that it takes
    part in, its own and one that holds values within reach; side 0 is the earlier tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_length(batch.column(2)):
                reach = reach_of(dim, blocks, least)
                for start in range(0, len(rows), _PIECE):
                    part = batch.take(pa.array(rows[start : start + _PIECE]))
                    at = np.array(part.column(3).to_pylist(), np.float64).reshape(part.num_rows, -1)
                    for block, r in enumerate(reach):
                        m = np.array(marks[dim][block] if dim in marks else (), np.float64)
                        c = at[:, block]
                        own, lo, hi = (np.searchsorted(m, x, "right") for x in (c, c - r, c + r))
                        many = hi - lo + 1
                        row = np.repeat(np.arange(part.num_rows), many)
                        mate = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(row))
                        mine = own[row]
                        where = pa.array(row)
                        cols = [np.full(len(row), dim), np.full(len(row), block), np.minimum(mine, mate), np.maximum(mine, mate), mine > mate]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in cols), *(part.column(i).take(where) for i in range(3))], names=["dim", "block", "s", "t", "side", "id", "n", "v"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Least reachable index after joining i with j, from labels `up`."""
    while len(i):
        a, b = up[i], up[j]
        differ = a != b
        if not differ.any():
            return up
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        while (up != up[up]).any():
            up = up[up]
    return up


def tile_links(x: np.ndarray, y: np.ndarray, edges: list[tuple[int, int]], block: int, share: np.ndarray, least: float, one: bool, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link, found in `block` and in none before it; x are unit rows, y turned
    ones. With `one`, pairs within a tile; else between rows before and from `split`."""
    lo, hi = edges[block]
    z = y[:, lo:hi].astype(np.float32)
    square = (z * z).sum(axis=1)
    n = len(x)
    for a in range(0, n if one else split, _PIECE):
        a_end = min(a + _PIECE, n if one else split)
        for b in range(a if one else split, n, _PIECE):
            b_end = min(b + _PIECE, n)
            far = square[a:a_end, None] + square[None, b:b_end] - 2 * (z[a:a_end] @ z[b:b_end].T)
            i, j = np.nonzero(far <= share[block] + 1e-4)
            i, j = i + a, j + b
            if one and a == b:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= least
                p, q = p[ok], q[ok]
                if len(p):
                    parts = (y[p] - y[q]) ** 2
                    own = parts[:, lo:hi].sum(axis=1) <= share[block] + _SLACK
                    for before in range(block):
                        c, d = edges[before]
                        own &= parts[:, c:d].sum(axis=1) > share[before] + _SLACK
                    yield p[own], q[own]


def _join(blocks: int, least: float):
    def solve(dim: int, block: int, one: bool, ids: list[int], counts: list[int], sides: list[int], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(sides), kind="stable")
        ids_at, n_at = np.array(ids, np.int64)[order], np.array(counts, np.int64)[order]
        x = _unit(np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)[order])
        split = int((np.array(sides) == 0).sum())
        edges, turn = edges_of(dim, blocks), rotation(dim)
        share = (2 - 2 * least) * np.array([b - a for a, b in edges]) / dim
        links, up = np.zeros(len(x), np.int64), np.arange(len(x))
        for p, q in tile_links(x, x @ turn, edges, block, share, least, one, split):
            links += np.bincount(p, n_at[q], minlength=len(x)).astype(np.int64) + np.bincount(q, n_at[p], minlength=len(x)).astype(np.int64)
            up = _roots(len(x), p, q, up)
        found = np.flatnonzero(links)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(ids_at[found]), pa.array(ids_at[up[found]]), pa.array(links[found])], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for batch in batches:
            for *k, side, i, n, v in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if k != key:
                    if key and len(held[0]) > 1:
                        yield from solve(key[0], key[1], key[2] == key[3], *held)
                    key, held = k, ([], [], [], [])
                for part, value in zip(held, (i, n, side, v), strict=True):
                    part.append(value)
        if key and len(held[0]) > 1:
            yield from solve(key[0], key[1], key[2] == key[3], *held)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`; ids are integers."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = cut(rows.mapInArrow(_checked, "id bigint, dim int, v binary"), "vectors")
    valid = rows.where("dim > 0")
    # A class of equal vectors has a number of its own: ids may be null or repeat.
    classes = valid.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("dim").alias("dim")).withColumn("id", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    placed = cut(classes.select("id", "n", "v").mapInArrow(_firsts(blocks), "id bigint, n bigint, v binary, at array<double>"), "placed")
    marks, dealt_bytes = {}, 0.0
    for dim, count in sorted(sizes.items()):
        tiles = max(1, -(-count // max(LEAST_TILE, min(MOST_TILE, count // 6))))
        dealt_bytes += count * dim * 8.0 * blocks * tiles
        if tiles > 1:
            names = [f"c{i}" for i in range(min(blocks, dim))]
            own = placed.where(F.octet_length("v") == 8 * dim).select(*[F.col("at")[i].alias(c) for i, c in enumerate(names)])
            marks[dim] = own.approxQuantile(names, [i / tiles for i in range(1, tiles)], 0.01)
    dealt = placed.mapInArrow(_deal(marks, blocks, least), "dim int, block int, s int, t int, side int, id bigint, n bigint, v binary")
    keys = ["dim", "block", "s", "t"]
    width = shuffle_width(spark, dealt_bytes)
    found = cut(dealt.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(_join(blocks, least), "a bigint, b bigint, links bigint"), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    named = roots.join(classes.select("id", "low"), "id").groupBy("root").agg(F.min("low").alias("component"))
    of_class = roots.join(named, "root").select("id", "component")
    classes = classes.join(links.withColumnRenamed("a", "id"), "id", "left").join(of_class, "id", "left")
    answers = classes.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "low").alias("component"))
    known = valid.join(answers, "v").select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    alone = rows.where("dim = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return known.union(alone).select(F.col("id").alias(vec_id), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
