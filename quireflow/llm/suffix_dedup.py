"""Suffix-array dedup: a distributed merge sort of sampled suffixes that knows common prefixes.

Every unit covered by a string of `length` units that also starts anywhere else is marked; strings never
cross texts. dedup() takes a text as UTF-8 bytes. passages() takes it as words: each word is replaced by
WORD_BYTES bytes of its hash, and the same merge sort runs over these.

1. Sampling. A suffix is kept where the hash of its first `seed` bytes is the least (leftmost of
   ties) of some window of `length` bytes. What a window keeps depends on its bytes alone, so any
   two places of one string of `length` bytes keep suffixes at the same distance: about one suffix
   in length / 2 bytes stands for all of them.
2. Prefix filter. A suffix whose seed occurs once can't lie in a repeat; only (hash, place) rows are
   exchanged to find that, no text. Only texts that still have suffixes go on.
3. Merge sort. Each task sorts the suffixes of its texts, each cut to `length` bytes and followed by
   the reversed bytes before it, drops equal ones (keeping their number), and sends front-coded
   runs (length of the prefix shared with the predecessor, remaining bytes) to key ranges that
   never split a seed. Each range is merged by a loser tree that compares strings from the common
   prefix already known, and never a known prefix again.
4. Neighbours in the order with a common seed form a group. In it, a place with l common bytes to
   the left and r to the right of some other place, l + r >= length, is covered from -l to +r; the
   largest such l and r of every place are found exactly.
   In a large group hashes of the windows propose what is equal, and bytes decide it.
   A seed with more than MOST_SURROUNDINGS distinct surroundings is left out of the sort: every
   window of `length` bytes around its places is counted by its 128-bit digest and joined back instead.
5. The answers, one per distinct suffix, are joined to the places, and the texts are cut.

Defined results: a null text is empty; texts shorter than `length` keep everything; equal rows
count as two places; rows with a null id take part like any other; extra columns are ignored.
Cutting bytes can split a character: `kept` is binary, and what is left of a split character is
dropped where text is returned. A very long text is sampled, cut and hashed in one task, in memory
of about ten times its size; its suffixes are sorted in as many tasks as any others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import cut, forget, small_batches, tracked

SEED = 64
#: Bytes of its hash that stand for a word. Two words that differ agree in them once in 2**32 pairs.
WORD_BYTES = 4
SPACE = K.byte_table((0x09, 0x0D), (0x20, 0x20))
#: Bytes of suffixes that a task sorts at once, and about as many that a range merges.
RUN_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
MOST_RANGES = 50_000
#: Distinct surroundings of one seed that a task resolves; the places of a more crowded seed are
#: compared by their windows, which are dealt by hash.
MOST_SURROUNDINGS = 200_000


#: Members up to which a group is compared by pairs.
FEW = 48


def seed_of(length: int) -> int:
    return max(1, min(SEED, length // 6))


def sampled(bounds: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the slice) of the sampled suffixes, and the 64-bit hashes of their seeds."""
    seed = seed_of(length)
    n = len(data) - seed + 1
    width = length - seed + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    prefix = K.prefix_hashes(data)
    with np.errstate(over="ignore"):
        hashes = K.mix((prefix[seed:] - prefix[:-seed]) * K.powers(n, inverse=True))
    order = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    tiles = np.concatenate([order, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    head = np.minimum.accumulate(tiles, axis=1).ravel()
    tail = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(tail[:count], head[width - 1 : width - 1 + count])
    inside = np.zeros(count + 1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    least = least[np.cumsum(inside[:-1]) > 0]
    if not len(least):
        return none
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    places = np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return places, hashes[places]


def _sample_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, _, bounds, data in K.slices(batch.column(2)):
                places, hashes = sampled(bounds, data, length)
                rows = np.searchsorted(bounds, places, "right") - 1
                order = np.lexsort((places, hashes, rows))  # the places of a text that share a seed: one row
                rows, hashes, places = rows[order], hashes[order], (places - bounds[rows])[order]
                new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])[: len(rows)])
                at = pa.array(rows[new] + lo)
                where = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)), pa.int32()), pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), ids.take(at), keys.take(at), where], names=["h", "id", "key", "pos"])

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int]]]:
    for i, (text, places) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        yield i, text or b"", places


def _seeds(seed: int, one_in: int):
    """Seeds of the suffixes whose place hashes to 0 modulo one_in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, places in _texts(batch):
                key = batch.column(1)[i].as_py()
                out += [text[p : p + seed] for p in places if xxhash.xxh64_intdigest(f"{key}/{p}") % one_in == 0]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["seed"])

    return run


def around(text: bytes, place: int, length: int) -> bytes:
    """The sort string of a place: the suffix cut to `length`, the reversed bytes before it, and the
    length of the first part."""
    right = text[place : place + length]
    left = text[max(0, place - (length - seed_of(length))) : place][::-1]
    return right + left + len(right).to_bytes(4, "big")


def _split(s: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(s[-4:], "big")
    return s[:n], s[n:-4]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the longest common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        x, y = a[at : min(n, at + step)], b[at : min(n, at + step)]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + len(x) - (differ.bit_length() + 7) // 8
        at += step
        step *= 4
    return n


def _digest(s: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(d >> 64), signed(d & (1 << 64) - 1)


def _runs(length: int, splitters: list[bytes], parts: int = 1):
    """Texts with places -> front-coded sorted runs, each entry in its key range. With more parts than
    one, a key range is dealt once more by a hash of the seed, so that ranges stay small however many
    suffixes there are."""
    seed = seed_of(length)
    names = ["range", "run", "seq", "shared", "rest", "n"]

    def coded(found: dict[bytes, int], run_id: int) -> pa.RecordBatch:
        ranges, shared, rest, n = [], [], [], []
        last: dict[int, bytes] = {}
        of_last = -1
        for s in sorted(found):
            r = bisect_right(splitters, s[:seed])
            if r != of_last:
                last.clear()
                of_last = r
            part = r * parts + (xxhash.xxh64_intdigest(s[:seed]) % parts if parts > 1 else 0)
            k = common(last[part], s) if part in last else 0
            ranges.append(part)
            shared.append(k)
            rest.append(s[k:])
            n.append(found[s])
            last[part] = s
        m = len(n)
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array([run_id] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(shared, pa.int32()), pa.array(rest, pa.binary()), pa.array(n, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        # A run's number: of the partition and within it, so the same when a task is repeated.
        held, run_id = 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for _, text, places in _texts(batch):
                for p in places:
                    s = around(text, p, length)
                    if s not in found:
                        held += len(s)
                    found[s] = found.get(s, 0) + 1
                if held > RUN_BYTES:
                    yield coded(found, run_id)
                    found, held, run_id = {}, 0, run_id + 1
        if found:
            yield coded(found, run_id)

    return run


def merged(runs: list[list[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge front-coded runs: (prefix shared with the last string given out, string, number).

    The loser tree keeps for every waiting string its common prefix with the last winner. Of two
    strings, the one that shares more with it is the smaller; only equal lengths need bytes
    compared, and only those after that prefix.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * width
    string: list[bytes | None] = [None] * width
    number = [0] * width
    known = [0] * width

    def advance(i: int) -> None:
        if i < len(runs) and at[i] < len(runs[i]):
            k, rest, number[i] = runs[i][at[i]]
            string[i] = string[i][:k] + rest if k else rest
            known[i] = k
            at[i] += 1
        else:
            string[i] = None

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = string[a], string[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        k = common(x, y, p)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    for i in range(width):
        advance(i)
        known[i] = 0
    loser = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [w for w, _ in pairs]
        for i, (_, x) in enumerate(pairs):
            loser[level + i] = x
    top = winners[0]
    while string[top] is not None:
        yield known[top], string[top], number[top]
        advance(top)
        node = (top + width) >> 1
        while node >= 1 and width > 1:
            top, loser[node] = play(top, loser[node])
            node >>= 1


def _few(parts: list[tuple[bytes, bytes]], shared: list[int], length: int) -> list[tuple[int, int]]:
    """(l, r) of each member of a small group, by pairs; shared: common prefix with the member before."""
    best = [(0, 0)] * len(parts)
    for i in range(len(parts)):
        r = length
        for j in range(i + 1, len(parts)):
            r = min(r, shared[j])
            both = min(r, len(parts[i][0]), len(parts[j][0]))
            left = common(parts[i][1], parts[j][1])
            if left + both >= length:
                for x in (i, j):
                    best[x] = max(best[x][0], left), max(best[x][1], both)
    return best


def _many(parts: list[tuple[bytes, bytes]], shared: list[int], length: int) -> list[tuple[int, int]]:
    """The same for a large group: the hashes of the windows that contain the place are compared
    column by column, in memory that grows with the group only. The windows that decide are compared
    byte by byte in the end; should hashes have lied, bytes take their place."""
    seed = seed_of(length)
    span = length - seed
    grid = np.zeros((len(parts), span + length), np.uint8)
    lefts, rights = np.array([len(p[1]) for p in parts]), np.array([len(p[0]) for p in parts])
    for row, (right, left) in zip(grid, parts, strict=True):
        row[span - len(left) : span] = np.frombuffer(left, np.uint8)[::-1]
        row[span : span + len(right)] = np.frombuffer(right, np.uint8)
    weight = K.powers(span + length)
    bits = K.uniform_bits(256, 20_029)
    most, least = np.full(len(parts), -1), np.full(len(parts), length + 1)
    most_like, least_like = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    with np.errstate(over="ignore"):
        window = np.zeros(len(parts), np.uint64)
        for t in range(length):
            window += bits[grid[:, t]] * weight[t]
        for column in range(span + 1):
            before = span - column  # bytes of the window before the place
            at = np.flatnonzero((lefts >= before) & (rights >= length - before))
            if len(at) > 1:
                order = at[np.argsort(window[at], kind="stable")]
                same = np.flatnonzero(window[order[1:]] == window[order[:-1]])
                again, like = np.concatenate([order[same + 1], order[same]]), np.concatenate([order[same], order[same + 1]])
                first = most[again] < 0  # columns come by falling `before`
                most[again[first]], most_like[again[first]] = before, like[first]
                least[again], least_like[again] = before, like
            if column < span:
                window += bits[grid[:, column + length]] * weight[column + length] - bits[grid[:, column]] * weight[column]
    hit = np.flatnonzero(most >= 0)
    for before, like in ((most[hit], most_like[hit]), (least[hit], least_like[hit])):
        for at in range(0, len(hit), 4096):
            some = slice(at, at + 4096)
            columns = (span - before[some])[:, None] + np.arange(length)
            if (grid[hit[some, None], columns] != grid[like[some, None], columns]).any():
                return _few(parts, shared, length)
    return [(int(a), int(length - b)) if a >= 0 else (0, 0) for a, b in zip(most, least, strict=True)]


def _answers(group: list[tuple[bytes, int]], shared: list[int], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(string, l, r) of the members of one seed's group that lie in a repeat."""
    parts = [_split(s) for s, _ in group]
    if len(group) == 1:
        best = [(0, 0)]
    elif len(group) <= FEW:
        best = _few(parts, shared, length)
    else:
        best = _many(parts, shared, length)
    for (s, n), (right, left), (a, b) in zip(group, parts, best, strict=True):
        if n > 1 and len(left) + len(right) >= length:
            a, b = len(left), len(right)
        if a + b >= length:
            yield s, a, b


def _merge_ranges(length: int):
    seed = seed_of(length)

    def solve(runs: dict[int, list]) -> Iterator[tuple[int, int, int, int]]:
        group: list[tuple[bytes, int]] = []
        shared: list[int] = []

        def done() -> Iterator[tuple[int, int, int, int]]:
            for s, a, b in _answers(group, shared, length):
                yield (*_digest(s), a, b)

        for k, s, n in merged([runs[r] for r in sorted(runs)]):
            if group and k == len(s) == len(group[-1][0]):
                group[-1] = s, group[-1][1] + n
                continue
            if group and k < seed:
                yield from done()
                group.clear()
                shared.clear()
            group.append((s, n))
            shared.append(k)
        if group:
            yield from done()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["c1", "c2", "l", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, out = None, {}, []
        for batch in batches:
            for r, run_id, _, k, rest, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if r != key:
                    out += solve(runs)
                    if len(out) > 50_000:
                        yield packed(out)
                        out = []
                    key, runs = r, {}
                runs.setdefault(run_id, []).append((k, rest, n))
        out += solve(runs)
        yield packed(out)

    return run


def _surroundings(length: int):
    """(h, c1, c2): the seed of each place and a digest of what is around it, once a batch."""
    seed = seed_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int]] = set()
            for _, text, places in _texts(batch):
                at = np.array(places)
                hashes = K.range_hashes(K.prefix_hashes(np.frombuffer(text, np.uint8)), at, at + seed).view(np.int64)
                found |= {(h, *_digest(around(text, p, length))) for h, p in zip(hashes.tolist(), places, strict=True)}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["h", "c1", "c2"])

    return run


def _windows(length: int):
    """Texts with places of crowded seeds -> the digests of all windows that hold one, by start."""
    before = length - seed_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, digests = [], [], []
            for i, text, places in _texts(batch):
                for a in sorted({a for p in places for a in range(max(0, p - before), min(p, len(text) - length) + 1)}):
                    rows.append(i)
                    starts.append(a)
                    digests.append(_digest(text[a : a + length]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64())], names=["c1", "c2", "id", "key", "a"])

    return run


def _places(length: int):
    """(c1, c2, id, key, pos): the places of a text that have equal surroundings, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, where = [], [], []
            for i, text, places in _texts(batch):
                alike: dict[tuple[int, int], list[int]] = {}
                for p in places:
                    alike.setdefault(_digest(around(text, p, length)), []).append(p)
                rows += [i] * len(alike)
                digests += alike
                where += alike.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(where, pa.list_(pa.int64()))], names=["c1", "c2", "id", "key", "pos"])

    return run


def spans_of(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover, in order; spans that touch make one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["a"], s["b"]) for s in spans or ()]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cut_out(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, key, t, spans) -> sizes and what is kept."""
    for batch in batches:
        sizes, removed, spans, shas, kept = [], [], [], [], []
        for _, text, found in _texts(batch):
            gone = spans_of(_pairs(found))
            whole = without(text, gone)
            sizes.append(len(text))
            removed.append(len(text) - len(whole))
            spans.append(len(gone))
            shas.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole.decode("utf-8", "ignore") if as_text else whole)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.string() if as_text else pa.binary())], names=["id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, t) -> the same with WORD_BYTES of hash for every word of t, A-Z lower-cased."""
    for batch in batches:
        for lo, hi, bounds, data in K.slices(batch.column(2)):
            low = K.LOWER[data]
            starts, ends, rows = K.runs(bounds, ~SPACE[low])
            tokens = (K.range_hashes(K.prefix_hashes(low), starts, ends) >> np.uint64(32)).astype(np.uint32)
            at = (WORD_BYTES * np.searchsorted(rows, np.arange(hi - lo + 1))).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(tokens.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), coded], names=["id", "key", "t"])


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, t, spans of word hashes) -> how many words there are and go, and the text that is
    left. A run of words goes with the white space behind it."""
    for batch in batches:
        found = batch.column(3).to_pylist()
        for lo, hi, bounds, data in K.slices(batch.column(2)):
            starts, _, rows = K.runs(bounds, ~SPACE[data])
            words_at = np.searchsorted(rows, np.arange(hi - lo + 1))
            n, removed, spans, kept = [], [], [], []
            for i in range(hi - lo):
                base, text = int(bounds[i]), data[bounds[i] : bounds[i + 1]].tobytes()
                edges = np.append(starts[words_at[i] : words_at[i + 1]] - base, len(text))
                whole = _whole_words(found[lo + i])
                n.append(len(edges) - 1)
                removed.append(sum(b - a for a, b in whole))
                spans.append(len(whole))
                kept.append(without(text, [(int(edges[a]), int(edges[b])) for a, b in whole]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["id", "key", "n_words", "n_removed", "n_spans", "kept"])


def _same(x: DataFrame, y: DataFrame):
    return x["key"].eqNullSafe(y["key"]) & x["id"].eqNullSafe(y["id"])


def _repeats(texts: DataFrame, length: int, size: str, sha: bool, spent: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, key, t): the rows (id, key, size, sha) without a suffix that may lie in a repeat,
    the other rows (id, key, t), and spans (id, key, spans) of all strings of `length` bytes of t that
    start twice. Scratch tables `spent`, of which texts is made, are deleted as soon as they are read."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType.simpleString()
    with tracked() as passed:
        samples = cut(texts.where(F.octet_length("t") >= length).mapInArrow(K.lean(_sample_rows(length)), f"h bigint, id {id_type}, key bigint, pos array<bigint>"), "samples")
        # Written, so that both sides of the join are plain exchanges and a hot seed can be split.
        twice = cut(samples.groupBy("h").agg(F.sum(F.size("pos")).alias("n")).where("n > 1"), "seeds")
    by_text = samples.join(twice.select("h"), "h").groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("places"))
    joined = texts.join(by_text, _same(texts, by_text), "left").select(texts["id"], texts["key"], texts["t"], "places")
    whole = F.col("places").isNull()
    digest = F.when(whole, F.sha2("t", 256)) if sha else F.lit(None).cast("string")
    split = cut(joined.select("id", "key", F.octet_length("t").cast("long").alias(size), digest.alias("sha"), F.when(~whole, F.col("t")).alias("t"), "places"), "texts")
    dirty = split.where("places is not null").select("id", "key", "t", "places")

    by_window = None
    perhaps = twice.where(F.col("n") > MOST_SURROUNDINGS).select("h")
    if perhaps.limit(1).collect():
        seen = dirty.mapInArrow(_surroundings(length), "h bigint, c1 bigint, c2 bigint").join(perhaps, "h").distinct()
        crowded = cut(seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SURROUNDINGS).select("h"), "crowded")
        own = samples.join(crowded, "h").groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("crowd"))
        parted = dirty.join(own, _same(dirty, own), "left").select(dirty["id"], dirty["key"], "t", F.when(F.col("crowd").isNull(), F.col("places")).otherwise(F.array_except("places", "crowd")).alias("places"), "crowd")
        dirty = cut(parted, "parted")
        windows = dirty.where("crowd is not null").select("id", "key", "t", "crowd").mapInArrow(_windows(length), f"c1 bigint, c2 bigint, id {id_type}, key bigint, a bigint")
        again = windows.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
        by_window = cut(windows.join(again, ["c1", "c2"]).select("id", "key", F.array(F.struct("a", (F.col("a") + length).alias("b"))).alias("s")), "windows")
        dirty = dirty.select("id", "key", "t", "places")
    forget(spark, passed)
    forget(spark, spent or [])

    total = dirty.agg(F.sum(F.size("places"))).first()[0] or 0
    seed = seed_of(length)
    wanted = max(1, total * (2 * length - seed) // RANGE_BYTES)
    ranges, parts = min(wanted, MOST_RANGES), -(-wanted // MOST_RANGES)
    sample = sorted(r[0] for r in dirty.mapInArrow(_seeds(seed, max(1, total // max(10_000, 4 * ranges))), "seed binary").collect())
    splitters = sorted({bytes(sample[len(sample) * i // ranges]) for i in range(1, ranges)}) if sample else []
    runs = dirty.mapInArrow(K.lean(_runs(length, splitters, parts)), "range bigint, run bigint, seq int, shared int, rest binary, n bigint")
    if parts > 1:
        dealt = runs.repartition(len(splitters) + 1, "range")
    else:
        dealt = runs.repartitionById(len(splitters) + 1, F.col("range").cast("int"))
    answers = cut(dealt.sortWithinPartitions("range", "run", "seq").mapInArrow(K.lean(_merge_ranges(length)), "c1 bigint, c2 bigint, l bigint, r bigint"), "answers")

    places = dirty.mapInArrow(K.lean(_places(length)), f"c1 bigint, c2 bigint, id {id_type}, key bigint, pos array<bigint>")
    by_place = places.join(answers, ["c1", "c2"]).select("id", "key", F.transform("pos", lambda p: F.struct((p - F.col("l")).alias("a"), (p + F.col("r")).alias("b"))).alias("s"))
    spans = (by_place if by_window is None else by_place.union(by_window)).groupBy("id", "key").agg(F.flatten(F.collect_list("s")).alias("spans"))
    return split.where("places is null").select("id", "key", size, "sha"), dirty.select("id", "key", "t"), spans


def key_of(text: str, doc_id: str) -> Column:
    """The key of a row: equal for equal ids and texts."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(doc_id))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), key_of(text, doc_id).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, as_text: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (null
    where nothing was removed; binary, or with as_text whole characters only), key (of id and text:
    equal rows have equal keys)."""
    small_batches(docs.sparkSession)
    texts = _rows(docs, doc_id, text)
    id_type = texts.schema["id"].dataType.simpleString()
    clean, dirty, spans = _repeats(texts, length, "n_bytes", True)
    done = dirty.join(spans, _same(dirty, spans), "left").select(dirty["id"], dirty["key"], "t", "spans")
    kind = "string" if as_text else "binary"
    cut_texts = done.mapInArrow(K.lean(partial(_cut_out, as_text=as_text)), f"id {id_type}, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept {kind}")
    untouched = clean.select("id", "key", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast(kind).alias("kept"), "n_bytes")
    out = untouched.unionByName(cut_texts.withColumn("kept", F.when(F.col("n_removed") > 0, F.col("kept"))))
    return out.select(F.col("id").alias(doc_id), "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _whole_words(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Runs of words that spans of word hashes cover."""
    runs = [(-(-a // WORD_BYTES), b // WORD_BYTES) for a, b in spans_of(_pairs(spans))]
    return [(a, b) for a, b in runs if a < b]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [sum(b - a for a, b in _whole_words(spans)) for spans in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "key", "n_removed"])


def _shared_passages(texts: DataFrame, words: int) -> DataFrame:
    """(id, key, spans): what strings of `words` words that start twice cover, in bytes of word hashes."""
    id_type = texts.schema["id"].dataType.simpleString()
    with tracked() as own:
        coded = cut(texts.mapInArrow(K.lean(_word_hashes), f"id {id_type}, key bigint, t binary"), "words")
    _, _, spans = _repeats(coded, words * WORD_BYTES, "size", False, own)
    return spans.where(F.size("spans") > 0)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 50) -> DataFrame:
    """The rows of `docs` that share a passage: id, key (as in dedup()), n_words, n_removed (words in
    strings of `words` words that also start anywhere else), n_spans, and kept, the text without them.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased, so a passage is found however
    its lines are broken. Text without spaces has few words: for such text dedup() is the one to use."""
    small_batches(docs.sparkSession)
    texts = _rows(docs, doc_id, text)
    found = _shared_passages(texts, words)
    shared = texts.join(found, _same(texts, found)).select(texts["id"], texts["key"], "t", "spans")
    done = shared.mapInArrow(K.lean(_cut_words), f"id {texts.schema['id'].dataType.simpleString()}, key bigint, n_words bigint, n_removed bigint, n_spans bigint, kept string")
    return done.where("n_removed > 0").withColumnRenamed("id", doc_id)


def passage_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 50) -> DataFrame:
    """id, key and n_removed of passages(), one row for each id and text, without reading texts again."""
    small_batches(docs.sparkSession)
    found = _shared_passages(_rows(docs, doc_id, text), words)
    counted = found.mapInArrow(_count_words, f"id {found.schema['id'].dataType.simpleString()}, key bigint, n_removed bigint")
    return counted.where("n_removed > 0").withColumnRenamed("id", doc_id)
