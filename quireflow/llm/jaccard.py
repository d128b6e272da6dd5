"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

Two documents link when their sets of distinct word n-grams satisfy 100 * |both| >= percent * |union|.

1. One pass gives every document's set size and 128-bit set digest, and adds its n-grams to a
   counting sketch of fixed size. Documents of equal sets form a class; only classes go on.
2. The columns of the incidence matrix are ordered by sketched frequency, then hash. Any fixed
   order is exact; this one keeps frequent n-grams out of the prefixes. A linking pair shares a
   column within the first n - ceil(percent * n / 100) + 1 columns of either row, and their sizes
   differ by the ratio at most. Rows (column, size, class) are range-sorted, so that a frequent
   column spreads over tasks. Columns of up to `most_rows` rows are multiplied: overlaps are
   accumulated by pair, and a pair goes on if what it may have beyond the prefixes could lift it
   over the bound that the two sizes set. Of a column with more rows, each run of close sizes is
   kept together instead, without pairs. Components of both are blocks: no linking pair is in two.
   In a large table common n-grams may tie very many rows together that way, so a block over
   `block_cells` n-grams is divided: its hash range is cut into parts, linking rows are equal in one
   of the first few by rarity and size, and the components by these are its blocks.
3. Each block's sets are multiplied: overlap counts of a row against the prefixes of the rows not
   reached yet, pairs below the bound are discarded, the rest are counted over whole rows. What is
   reached joins a component and leaves the product, so a group of many near copies costs a few
   rows of products, never all of its pairs. A block over `block_cells` n-grams is cut into windows
   of two neighbouring size bands, and those into parts; each pair of parts is a task.
4. Components of the links found give each class, and so each document, its component.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. n-grams are 64-bit hashes.

Rows are told apart by id and text (`key` is a hash of both), classes by their digests: an id may stand
on several texts, and rows without an id link like any others.

Defined results: a document with fewer words than an n-gram has its whole sequence as one; null and
empty texts have no set and link with nothing; a component of rows without ids has a null id; repeated
rows are returned as often as they occur. A very long text is shingled in one task, in memory of about
ten times its size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._graph import components
from ._spark import cut, forget, shuffle_width, small_batches, tracked

SPACE = K.byte_table((0x09, 0x0D), (0x20, 0x20))
#: Cells of the sketch (a power of two) and the parts that it is summed in.
SKETCH_BITS, SKETCH_PARTS = 23, 16
#: Sketches that one task sums.
SKETCHES_A_TASK = 512
#: Rows up to which a column's pairs are counted.
MOST_ROWS = 64
#: n-grams of a block that are multiplied in one task.
BLOCK_CELLS = 1 << 20


def ngram_sets(bounds: np.ndarray, data: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every row of a slice."""
    low = K.LOWER[data]
    starts, ends, rows = K.runs(bounds, ~SPACE[low])
    tokens = K.range_hashes(K.prefix_hashes(low), starts, ends)
    at = K.window_starts(rows, width)
    grams, owner = K.window_hashes(tokens, at, width), rows[at]
    n = len(bounds) - 1
    cut_at = np.searchsorted(owner, np.arange(n + 1))
    words_at = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        words = words_at[i + 1] - words_at[i]
        if 0 < words < width:
            out.append(K.window_hashes(tokens, words_at[i : i + 1], int(words)))
        else:
            out.append(np.unique(grams[cut_at[i] : cut_at[i + 1]]))
    return out


def _digest(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(grams.tobytes(), seed=len(grams))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(d >> 64), signed(d & (1 << 64) - 1)


def prefix_length(n, percent: int):
    """Columns of a row of n among which a linking row shares one."""
    return n - -(-percent * n // 100) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
        names = ["id", "key", "n", "d1", "d2", "part", "counts"]
        for batch in batches:
            sizes, digests = [], []
            for _, _, bounds, data in K.slices(batch.column(2)):
                sets = ngram_sets(bounds, data, width)
                sizes += [len(s) for s in sets]
                digests += [_digest(s) for s in sets]
                cells = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)
                np.add.at(sketch, cells[sketch[cells] < 1 << 15], 1)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        # Above 255 of one partition the order no longer matters.
        parts = [zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 1) for x in np.split(sketch, SKETCH_PARTS)]
        none = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _sum_sketch(kind: type):
    """Sums of the parts whose counts are of the given kind, as 32-bit counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), kind)
                if part in sums:
                    sums[part] += x
                else:
                    sums[part] = x.astype(np.int64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(np.minimum(sums[k], 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for k in keys], pa.binary())], names=["part", "counts"])

    return run


def _rank_cells(load: float):
    """Counts of each part -> ranks: what a cell has above the common load is what its own frequent
    n-grams have."""
    spread = max(1.0, 3 * load**0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts in batch.column(1).to_pylist():
                above = (np.frombuffer(zlib.decompress(counts), np.uint32) - load) / spread
                out.append(np.clip(4 * np.log2(np.maximum(1.0, above)), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["part", "ranks"])

    return run


def column_ranks(described: DataFrame) -> np.ndarray:
    """A rank of 0 to 255 for each sketch cell by its share of all n-grams: 2**23 bytes whatever the
    input."""
    parts = described.where("part is not null").select("part", "counts")
    salts, kind = -(-parts.where("part = 0").count() // SKETCHES_A_TASK), np.uint8
    if salts > 1:  # many sketches are first summed in groups
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        parts = cut(salted.repartition(SKETCH_PARTS * salts, "part", "salt").select("part", "counts").mapInArrow(_sum_sketch(kind), "part int, counts binary"), "sketches")
        kind = np.uint32
    sums = cut(parts.repartition(SKETCH_PARTS, "part").mapInArrow(_sum_sketch(kind), "part int, counts binary"), "sketch")
    load = (described.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    ranks = dict(sums.mapInArrow(_rank_cells(load), "part int, ranks binary").collect())
    return np.frombuffer(b"".join(bytes(ranks[i]) for i in range(SKETCH_PARTS)), np.uint8) if ranks else np.zeros(1 << SKETCH_BITS, np.uint8)


#: Bits that tell which documents are in blocks: as many for any input, so that they can be broadcast.
#: With very many members they let more documents through to the join, never fewer.
FLAG_BITS = 25


def _flags_of(ids: np.ndarray) -> np.ndarray:
    h = K.mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h >> np.uint64(64 - FLAG_BITS), (h << np.uint64(FLAG_BITS)) >> np.uint64(64 - FLAG_BITS)]).astype(np.int64)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FLAG_BITS >> 3, np.uint8)
    for batch in batches:
        for at in _flags_of(batch.column(0).to_numpy()):
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _join_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FLAG_BITS >> 3, np.uint8)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            bits |= np.frombuffer(zlib.decompress(x), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _flagged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            a, b = _flags_of(keys)
            some = np.flatnonzero((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1)
            new = []  # equal rows of a partition go on once
            for at, key in zip(some.tolist(), keys[some].tolist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(at)
            yield batch.take(pa.array(new, pa.int64()))

    return run


def _prefixes(width: int, percent: int, least: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for _, _, bounds, data in K.slices(batch.column(0)):
                columns, sizes, classes = [], [], []
                for grams in ngram_sets(bounds, data, width):
                    n = len(grams)
                    if n < least:
                        continue
                    p = prefix_length(n, percent)
                    order = (ranks[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
                    columns.append(grams[np.argpartition(order, p - 1)[:p]])
                    sizes.append(np.full(p, n))
                    classes.append(np.full(p, _digest(grams)[0]))
                if columns:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(columns)), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(classes), pa.int64())], names=["g", "n", "c"])

    return run


class Forest:
    """Union-find over hashable ids; the least id is the root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: Index pairs (i < j) of the rows of a short column, by their number.
_PAIRS = [np.triu_indices(k, 1) for k in range(MOST_ROWS + 1)]


def bound(n_a, n_b, percent: int):
    """The least overlap with which rows of n_a and n_b link."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _columns(percent: int, most_rows: int):
    """Rows sorted by (g, n, c) -> products (a, b, na, nb, overlap) of short columns, edges (a, b) of
    the runs of long ones, and rows (a, na, g) of the partition's first and last column, which
    other partitions may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        sums: list[np.ndarray] = []
        held = 0
        names = ["a", "b", "na", "nb", "overlap", "g"]

        def summed() -> pa.RecordBatch:
            rows = np.concatenate(sums) if sums else np.zeros((0, 4), np.int64)
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows = rows[order]
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[: len(rows)]
            counts = np.diff(np.append(np.flatnonzero(new), len(rows)))
            rows = rows[new]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(4)), pa.array(counts, pa.int64()), none], names=names)

        def ends(g: int, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            """All rows of a short column; of a long one, linked here, the first and the last."""
            if len(c) > most_rows:
                column(n, c)
                n, c = n[[0, -1]], c[[0, -1]]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c), none, pa.array(n), none, none, pa.array(np.full(len(n), g), pa.int64())], names=names)

        def column(n: np.ndarray, c: np.ndarray) -> None:
            nonlocal held
            if len(c) > most_rows:
                follows = np.concatenate([[False], 100 * n[:-1] >= percent * n[1:]])
                roots = c[np.maximum.accumulate(np.where(follows, 0, np.arange(len(c))))]
                for x, y in zip(c.tolist(), roots.tolist(), strict=True):
                    forest.join(x, y)
                return
            i, j = _PAIRS[len(c)]
            near = 100 * n[i] >= percent * n[j]
            if near.any():
                i, j = i[near], j[near]
                swap = c[i] > c[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                sums.append(np.stack([c[i], c[j], n[i], n[j]], axis=1))
                held += len(i)

        rest: list[tuple] = []
        first = True
        for batch in batches:
            g, n, c = (batch.column(i).to_numpy() for i in range(3))
            n = n.astype(np.int64)
            if rest:
                g, n, c = (np.concatenate([rest[0][i], x]) for i, x in enumerate((g, n, c)))
            if not len(g):
                continue
            at = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            # Equal sets give equal rows: one each.
            if first and len(at) > 2:
                new = np.unique(np.stack([n[: at[1]], c[: at[1]]]), axis=1)
                yield ends(int(g[0]), *new)
                first, at = False, at[1:]
            wide = np.flatnonzero(np.diff(at[:-1]) > 1)
            for a, b in zip(at[wide].tolist(), at[wide + 1].tolist(), strict=True):
                m, k = n[a:b], c[a:b]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
                if new.sum() > 1:
                    column(m[new], k[new])
                if held > 300_000:
                    yield summed()
                    sums, held = [], 0
            rest = [(g[at[-2] :], n[at[-2] :], c[at[-2] :])]
            if len(rest[0][0]) > 100_000:  # a column that fills many batches: its equal rows go, the rest are few bytes each
                new = np.unique(np.stack([rest[0][1], rest[0][2]]), axis=1)
                rest = [(np.full(new.shape[1], rest[0][0][0]), *new)]
        if rest:
            new = np.unique(np.stack([rest[0][1], rest[0][2]]), axis=1)
            yield ends(int(rest[0][0][0]), *new)
        yield summed()
        rows = list(forest.up)
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([forest.root(x) for x in rows], pa.int64()), none, none, none, none], names=names)

    return run


def size_bands(percent: int, least: int) -> np.ndarray:
    """Lower ends of the bands of set sizes, each a quarter above the one before."""
    ends = [least]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return np.array(ends, np.int64)


def part_tokens(grams: np.ndarray, percent: int, bands: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Tokens such that the sets of a linking pair have one in common, whatever they are made of.

    The hash range is cut into as many parts as the larger set's size band says, and a part's token is the
    hash of the n-grams in it. Linking sets of n_a and n_b differ in d = (n_a + n_b) (100 - percent) /
    (100 + percent) n-grams at most, so in d of the parts: of all parts in any fixed order of tokens, empty
    parts last, they share one of the first d + 1. A set that may link into the next band has tokens there too.
    Parts whose rarest n-gram is rarest come first, of these the largest: a part of one or two frequent n-grams is
    equal in very many sets that have little else in common.
    """
    n = len(grams)
    rank = np.zeros(n, np.uint8) if rank is None else rank
    band = int(np.searchsorted(bands, n, "right")) - 1
    mixed = K.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    while percent * int(bands[band]) <= 100 * n:
        top = int(bands[band + 1]) - 1
        m = 2 * top * (100 - percent) // (100 + percent)
        m += 2 + m // 4
        differ = (n + min(top, 100 * n // percent)) * (100 - percent) // (100 + percent)
        part = (grams >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)  # sorted, as the n-grams are
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        place = np.uint64(band << 40)
        with np.errstate(over="ignore"):
            tokens = K.mix(np.add.reduceat(mixed, at) + K.mix(part[at] + place + np.uint64(1)))
            tokens = tokens[np.lexsort((tokens, -np.diff(at, append=n), np.minimum.reduceat(rank, at)))[: differ + 1]]
            if len(tokens) <= differ:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[at])
                tokens = np.concatenate([tokens, np.sort(K.mix(empty + place + np.uint64(1)))[: differ + 1 - len(tokens)]])
        out.append(tokens)
        band += 1
    return np.concatenate(out)


def _tokens(width: int, percent: int, least: int, shared):
    """Rows (class, digest, text) -> (token, class)."""
    bands = size_bands(percent, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, bounds, data in K.slices(batch.column(2)):
                tokens, classes = [], []
                for i, grams in enumerate(ngram_sets(bounds, data, width), lo):
                    if len(grams) >= least and _digest(grams) == (d1[i], d2[i]):
                        tokens.append(part_tokens(grams, percent, bands, ranks[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                        classes.append(np.full(len(tokens[-1]), d1[i]))
                if tokens:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.concatenate(classes), pa.int64())], names=["s", "c"])

    return run


def _same_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s, c) -> edges (a, b) between classes of one token, and the partition's first and last
    token with a class of each (s, a), as these may go on in other partitions."""
    forest = Forest()
    last = ends = None
    for batch in batches:
        s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(s):
            continue
        if last is None:
            ends = [(int(s[0]), int(c[0]))]
            last = ends[0]
        s, c = np.concatenate([[last[0]], s]), np.concatenate([[last[1]], c])
        at = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(len(s)), 0))
        some = np.flatnonzero(c != c[at])
        for x, y in set(zip(c[some].tolist(), c[at[some]].tolist(), strict=True)):
            forest.join(x, y)
        last = int(s[-1]), int(c[at[-1]])
    if last is not None:
        ends = [ends[0], last]
        rows = [(x, forest.root(x), None) for x in forest.up] + [(c, None, s) for s, c in ends]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "s"])


def linked(x: np.ndarray, n_x: int, cells: np.ndarray, at: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
    """Which of `rows` (of the matrix cells, at) link with the row of cells x, counted in full."""
    lengths = at[rows + 1] - at[rows]
    starts = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    mine = cells[starts + np.arange(len(starts))]
    place = np.minimum(np.searchsorted(x, mine), len(x) - 1)
    overlap = np.add.reduceat((x[place] == mine).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return 100 * overlap >= percent * (n_x + lengths - overlap)


def block_links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the first set of its component among these."""
    n = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(column, minlength=len(grams))
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((np.arange(len(grams)), frequency))] = np.arange(len(grams))
    cells = [np.sort(rank[column[at[i] : at[i + 1]]]) for i in range(len(sets))]
    flat = np.concatenate(cells)
    prefix = prefix_length(n, percent)
    of_cell = np.concatenate([c[:p] for c, p in zip(cells, prefix, strict=True)])
    owner = np.repeat(np.arange(len(sets)), prefix)
    order = np.lexsort((owner, of_cell))
    of_cell, owner = of_cell[order], owner[order]
    waiting = np.ones(len(sets), bool)
    label = [-1] * len(sets)
    left, indexed = len(sets), len(sets)
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        label[seed] = seed
        left -= 1
        front = [seed]
        while front and left:
            i = front.pop()
            if left < indexed // 2:  # leave out what has been reached
                keep = waiting[owner]
                of_cell, owner, indexed = of_cell[keep], owner[keep], left
            mine = cells[i][: prefix[i]]
            lo, hi = np.searchsorted(of_cell, mine, "left"), np.searchsorted(of_cell, mine, "right")
            spans = hi - lo
            if not spans.any():
                continue
            shift = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)
            rows, overlap = np.unique(owner[shift + np.arange(len(shift))], return_counts=True)
            rows_n = n[rows]
            need = bound(n[i], rows_n, percent)
            # Up to the prefix that ends first all is counted; the rest of that row may still overlap.
            most = np.minimum(np.minimum(n[i], rows_n), overlap + np.maximum(n[i] - prefix[i], rows_n - prefix[rows]))
            ok = waiting[rows] & (100 * np.minimum(n[i], rows_n) >= percent * np.maximum(n[i], rows_n)) & (most >= need)
            rows = rows[ok]
            if len(rows):
                new = rows[linked(cells[i], int(n[i]), flat, at, rows, percent)]
                waiting[new] = False
                left -= len(new)
                for j in new.tolist():
                    label[j] = seed
                front += new.tolist()
    return label


def _multiply(percent: int, width: int):
    """Rows sorted by (block, window, i, j): class, digest and text -> (a, b) links of classes that span
    the components found. A text that only shares its key with the class's own is left out."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        known: dict[int, np.ndarray] = {}
        at = 0
        for _, _, bounds, data in K.slices(pa.array([r[3] for r in rows], pa.string())):
            for grams in ngram_sets(bounds, data, width):
                i, d1, d2, _ = rows[at]
                at += 1
                if i not in known and _digest(grams) == (d1, d2):
                    known[i] = grams
        keys = sorted(known)
        if len(keys) < 2:
            return []
        label = block_links([known[k] for k in keys], percent)
        return [(k, keys[x]) for k, x in zip(keys, label, strict=True) if keys[x] != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()
        out: list[tuple[int, int]] = []
        for batch in batches:
            for *k, i, d1, d2, t in zip(*(batch.column(x).to_pylist() for x in range(8)), strict=True):
                if k != key:
                    if len(rows) > 1:
                        out += solve(rows)
                    key, rows, seen = k, [], set()
                if (i, mark := xxhash.xxh3_128_digest(t)) not in seen:  # one text may come from many partitions
                    seen.add((i, mark))
                    rows.append((i, d1, d2, t))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        if len(rows) > 1:
            out += solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _candidates(ordered: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes such that every linking pair is connected."""
    spark = ordered.sparkSession
    found = cut(ordered.mapInArrow(K.lean(_columns(percent, MOST_ROWS)), "a bigint, b bigint, na bigint, nb bigint, overlap bigint, g bigint"), "columns")
    # The first and last columns of all partitions may go on in others: a few rows a partition.
    shared = found.where("g is not null").select("g", F.col("na").alias("n"), F.col("a").alias("c")).distinct()
    w = Window.partitionBy("g").orderBy("n", "c")
    before = shared.select("c", F.lag("c").over(w).alias("p"), F.lag("n").over(w).alias("m"), "n")
    bridges = before.where(100 * F.col("m") >= percent * F.col("n")).select(F.col("c").alias("a"), F.col("p").alias("b"))

    n = F.col("na") + F.col("nb")
    least = F.ceil(n * percent / (100 + percent) - 1e-6)
    beyond = F.greatest(*(F.col(x) - prefix_length_sql(x, percent) for x in ("na", "nb")))
    products = found.where("overlap is not null").groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    near = products.where(F.least("na", "nb", F.col("overlap") + beyond) >= least).select("a", "b")
    return near.union(found.where("overlap is null and b is not null").select("a", "b")).union(bridges)


def prefix_length_sql(n: str, percent: int):
    return F.col(n) - F.ceil(F.col(n) * percent / 100 - 1e-6) + 1


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, kept) for each row of `docs`; ids are integers. Of each
    component, `kept` holds for the rows of one id and text: those of the least id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).select("id", key_of("t", "id").alias("key"), "t")
    described = cut(texts.mapInArrow(K.lean(_describe(width)), "id bigint, key bigint, n bigint, d1 bigint, d2 bigint, part int, counts binary"), "described")
    rows = described.where("part is null").select("id", "key", "n", "d1", "d2")
    # The least id with the least of its keys; rows without an id come last.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = cut(rows.where("n > 0").groupBy("d1", "d2", "n").agg(first).withColumn("c", F.monotonically_increasing_id()), "classes")
    if percent < 100:
        found = components(_links(texts, described, classes, width, percent, block_cells))
    else:  # only equal sets link
        found = spark.createDataFrame([], "id bigint, root bigint")

    of_root = classes.join(found, classes["c"] == found["id"]).groupBy("root").agg(F.min("first").alias("least"))
    linked_classes = found.join(of_root, "root").select(F.col("id").alias("c"), "least")
    of_class = classes.join(linked_classes, "c", "left").select("d1", "d2", F.coalesce("least", "first").alias("least"))
    with_sets = rows.where("n > 0").join(of_class, ["d1", "d2"]).select("id", "n", F.col("least.id").alias("component"), "key", (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))).alias("kept"))
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component"), "key", F.lit(True).alias("kept"))
    return with_sets.union(alone).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "key", "kept")


def key_of(text: str, doc_id: str) -> Column:
    """The key of a row: equal for equal ids and texts."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(doc_id).cast("long"))


def _links(texts: DataFrame, described: DataFrame, classes: DataFrame, width: int, percent: int, block_cells: int) -> DataFrame:
    """(a, b): links between classes that span the components."""
    spark = texts.sparkSession
    # Smaller sets link with equal sets only: one n-gram more is already below the share.
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    with tracked() as passed, tracked() as spent:
        ranks = spark.sparkContext.broadcast(column_ranks(described))
        prefixes = cut(texts.select("t").mapInArrow(K.lean(_prefixes(width, percent, least, ranks)), "g bigint, n int, c bigint"), "prefixes")
        width_of = shuffle_width(spark, 0)
        ordered = prefixes.repartitionByRange(width_of, "g", "n", "c").sortWithinPartitions("g", "n", "c")
        blocks = components(_candidates(ordered, percent))

        found = classes.where(F.col("n") >= least).select("c", F.col("first.key").alias("key"), "n", "d1", "d2").join(blocks.select(F.col("id").alias("d1"), F.col("root").alias("block")), "d1")
        grouped = cut(found, "grouped")
        forget(spark, [x for x in spent if "/grouped-" not in x])
    with tracked() as more:
        grouped = _divided(texts, grouped, width, percent, least, block_cells, ranks)
        # A block that is too large for a task is cut into windows of two neighbouring size bands (sizes
        # of linking rows are at most one band apart), and a window that still is into parts.
        step = math.log(100 / percent) * 1.001
        total = grouped.groupBy("block").agg(F.sum("n").alias("cells"))
        band = F.when(F.col("cells") > block_cells, F.floor(F.log("n") / step)).otherwise(F.lit(0))
        windows = F.when(F.col("cells") > block_cells, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))
        placed = grouped.join(total, "block").withColumn("band", band).withColumn("window", F.explode(windows))
        parts = placed.groupBy("block", "window").agg(F.ceil(F.sum("n") / block_cells).cast("int").alias("parts"), F.count("*").alias("m"))
        one = placed.join(parts.where("m > 1"), ["block", "window"]).select("c", "key", "d1", "d2", "block", F.struct("window", "parts").alias("w"))
        members = cut(one.groupBy("c", "key", "d1", "d2", "block").agg(F.collect_list("w").alias("windows")), "members")
    asked = _asked(texts, members)
    whole = members.join(asked, "key").withColumn("w", F.explode("windows"))
    own = F.pmod(F.xxhash64("c"), F.col("w.parts")).cast("int")
    pairs = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("w.parts") - 1)))
    tasks = pairs.select("block", "w.window", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "d1", "d2", "t")
    keys = ["block", "window", "i", "j"]
    tasks = tasks.repartition(width_of, *keys).sortWithinPartitions(*keys)
    links = cut(tasks.mapInArrow(K.lean(_multiply(percent, width)), "a bigint, b bigint"), "links")
    forget(spark, [*passed, *more])
    return links


def _asked(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts (key, t) whose keys are among those of members, and a few more."""
    bits = members.select("key").mapInArrow(_flag, "bits binary").repartition(1).mapInArrow(_join_flags, "bits binary").collect()[0][0]
    shared = texts.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(bits), np.uint8))
    return texts.select("key", "t").mapInArrow(K.lean(_flagged(shared)), "key bigint, t string")


def _divided(texts: DataFrame, grouped: DataFrame, width: int, percent: int, least: int, block_cells: int, ranks) -> DataFrame:
    """`grouped` with blocks over `block_cells` divided: their classes are joined anew by tokens of parts of
    their sets, which texts that share but a few frequent n-grams do not have in common. Undivided, a block
    would grow to all of a large table as its columns fill, and its texts go to as many tasks as it has parts."""
    spark = texts.sparkSession
    total = grouped.groupBy("block").agg(F.sum("n").alias("cells"))
    large = grouped.join(total.where(F.col("cells") > block_cells), "block")
    members = cut(large.select("c", "key", "n", "d1", "d2"), "large")
    if members.isEmpty():
        return grouped
    rows = members.join(_asked(texts, members), "key").select("d1", "d2", "t")
    tokens = cut(rows.mapInArrow(K.lean(_tokens(width, percent, least, ranks)), "s bigint, c bigint"), "tokens")
    ordered = tokens.repartitionByRange(shuffle_width(spark, 0), "s", "c").sortWithinPartitions("s", "c")
    found = cut(ordered.mapInArrow(K.lean(_same_token), "a bigint, b bigint, s bigint"), "same")
    ends = found.where("s is not null")
    bridges = ends.join(ends.groupBy("s").agg(F.min("a").alias("m")), "s").select("a", F.col("m").alias("b"))
    parts = components(found.where("s is null").select("a", "b").union(bridges))
    divided = members.join(parts.select(F.col("id").alias("d1"), F.col("root").alias("block")), "d1")
    small = grouped.join(total.where(F.col("cells") <= block_cells), "block")
    return cut(small.select("c", "key", "n", "d1", "d2", "block").unionByName(divided.select("c", "key", "n", "d1", "d2", "block")), "divided")

