"""Each operator against brute force, round trips or held-out labels, and its edge cases: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import gzip
import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import _graph, _kernel, chat, decontaminate, jaccard, pieces, quality, queries, suffix_dedup, token_counts, url_filter, vector_dedup, warc
from quireflow.llm._spark import scratch
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(normal(tuple(r))) for r in df.select(*columns).collect())
    assert ours == sorted(repr(normal(r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())


def words(rng, n, vocabulary="abcdefgh"):
    return " ".join("".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_documents(spark, rng, n=40):
    """Texts with copies, near copies, nulls, empty and long ones, repeated rows and clashing columns."""
    base = [words(rng, rng.randint(0, 60)) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:10])]
    rows += [(200 + i, t + " zz") for i, t in enumerate(base[:10])]
    rows += [(300, None), (301, ""), (302, "   "), (303, "a" * 3000), (304, "é ñ " * 700), (305, "one"), (306, "one two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    extra = {c: F.lit(i) for i, c in enumerate(("id", "t", "key", "n", "g", "a", "b", "block", "pos", "places", "h", "v"))}
    return rows, df.withColumns(extra)


# --- graph -------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500)]
    got = {r.id: r.root for r in _graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    u = brute.Union()
    for a, b in edges:
        u.join(a, b)
    assert got == {x: u.root(x) for e in edges if e[0] != e[1] for x in e}
    assert _graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 -----------------------------------------------------------------------------------------


def brute_scan(rows, items, width):
    tok = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", brute.lower(t or ""))
    out = {}
    for i, t in rows:
        w = tok(t)
        hit, found = set(), set()
        for k, it in items:
            iw = tok(it)
            n = min(width, len(iw))
            if not n:
                continue
            needles = {tuple(iw[x : x + n]) for x in range(len(iw) - n + 1)}
            for x in range(len(w) - n + 1):
                if tuple(w[x : x + n]) in needles:
                    hit |= set(range(x, x + n))
                    found.add(str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    rows, docs = odd_documents(spark, rng)
    items = [(1, "ab, CD " + rows[3][1]), (2, rows[5][1]), (10, "one"), (4, ""), (5, None), (6, "..."), (2, rows[5][1]), (7, "é ñ é")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.summary(decontaminate.scan(docs, bench, width=4, block_bytes=block_bytes))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()} == brute_scan(rows, items, 4)
    assert {r.doc_id for r in got.where("contaminated").collect()} == {i for i, (n, h, *_) in brute_scan(rows, items, 4).items() if h and 20 * h >= n}
    assert decontaminate.scan(docs.where("false"), bench).count() == 0 and decontaminate.scan(docs, bench.where("false")).where("size(found) > 0").count() == 0


def test_decontamination_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "z " * 60_000 + "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c")] * 200 + [(2, "q")] * 50, "item_id bigint, text string")
    got = decontaminate.summary(decontaminate.scan(docs, bench, block_bytes=40)).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]


def test_stripping_spans(spark):
    docs = spark.createDataFrame([(1, "Keep it. The Quick, brown fox! And é so on"), (2, None), (3, "quick brown fox")], "doc_id bigint, text string").withColumns({"found": F.lit("x"), "items": F.lit(1), "n_hit": F.lit(2)})
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id bigint, text string")
    assert {r.doc_id: r.text for r in decontaminate.strip_spans(docs, bench).collect()} == {1: "Keep it. The ! And é so on", 2: None, 3: ""}
    assert [(r.doc_id, r.found, r["items"]) for r in decontaminate.drop_contaminated(docs, bench).collect()] == [(2, "x", 1)]
    assert decontaminate.scan(docs, bench).where("size(found) = 1").count() == 2


# --- 2 -----------------------------------------------------------------------------------------


def test_archives(spark):
    big = "x" * 1500
    rows = [(5, "http://a/1", big), (9, None, big), (7, "http://a/\r\nX: y", big), (None, "http://n", big), (1, "u", None), (2, "u", ""), (3, "é", "é" * 400), (4, "v", "é" * 400), (6, "s", "short"), (8, "s", "short"), (9, "twin", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("key", "payload", "digest", "shard")}).repartition(3)
    seen = []
    for _ in range(2):
        path = scratch(spark, "warc")
        warc.write_warc(pages, path, "page_id", "url", F.col("html"), roll_bytes=900, shard_bytes=2000)
        found = warc.read_warc(spark, path).collect()
        types = {(r.key, r.uri): (r.record_type, r.refers_to) for r in found}
        assert len(found) == len(rows) and types[9, None] == ("response", None) and types[9, "twin"] == ("response", None)
        assert types[5, "http://a/1"] == ("revisit", 9) and types[None, "http://n"] == ("revisit", 9) and types[7, "http://a/%0D%0AX: y"] == ("revisit", 9)
        assert types[3, "é"] == ("response", None) and types[6, "s"] == types[8, "s"] == ("response", None)
        for r in found:
            want = next((p or "").encode() for k, u, p in rows if k == r.key and (u or "").replace("\r", "%0D").replace("\n", "%0A") == (r.uri or ""))
            assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha1(want).hexdigest()) and (r.payload is None) == (r.record_type == "revisit")
            assert r.payload is None or bytes(r.payload) == want
        seen.append(sorted(tuple(x) for x in spark.read.json(f"{path}/manifest").select("name", "bytes", "records", "sha1").collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 3
    empty = scratch(spark, "warc")
    warc.write_warc(pages.where("false"), empty, "page_id", "url", F.col("html"))
    assert warc.read_warc(spark, empty).count() == 0


def test_shards_of_wide_hot_and_missing_keys(spark):
    keys = [-(2**63), 2**63 - 1, 10**18, 0, None] + list(range(1, 1500)) + [7] * 700 + [None] * 700
    rows = [(k, f"u{i}", random.Random(i).randbytes(300).hex()) for i, k in enumerate(keys)]
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "key bigint, uri string, body string").repartition(3), path, "key", "uri", F.col("body"), shard_bytes=60_000)
    files = spark.read.json(f"{path}/manifest").groupBy("shard").agg(F.sum("records").alias("n"), F.count("*").alias("files")).collect()
    whole = sum(r.n for r in files) / (sum(len(b) + 600 for *_, b in rows) / 60_000)
    assert len(files) > 30 and max(r.n for r in files) <= 2 * whole and sum(r.n for r in files) == len(rows) and max(r.files for r in files) > 1
    got = warc.read_warc(spark, path).collect()
    assert sorted((str(r.key), r.uri, bytes(r.payload).decode()) for r in got) == sorted((str(k), u, b) for k, u, b in rows)


def test_revisits_across_shards(spark):
    body = "same" * 500
    rows = [(5, f"u{i}", body) for i in range(60)] + [(9, "last", body)]
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "key bigint, uri string, body string"), path, "key", "uri", F.col("body"), shard_bytes=20_000)
    got = warc.read_warc(spark, path).collect()
    assert {(r.record_type, r.refers_to) for r in got if r.key == 5} == {("revisit", 9)} and [r.record_type for r in got if r.key == 9] == ["response"]
    assert spark.read.json(f"{path}/manifest").select("shard").distinct().count() > 1


def test_a_record_is_plain_warc():
    member = warc.record(1, "http://x", b"body", None, False)
    headers, block = warc.parse(gzip.decompress(member))
    assert headers["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nbody") and member == warc.record(1, "http://x", b"body", None, False)
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(member)[:-1])


# --- 3 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary()


def paths_of(unit, v):
    lat = pieces.lattices(pieces.code_points(unit), np.array([len(unit)]), v)

    def go(node, log, ids):
        if lat.last[node]:
            yield tuple(ids), log
        for e in range(lat.edge_at[node], lat.edge_at[node + 1]):
            yield from go(int(lat.target[e]), log + float(lat.log[e]), [*ids, int(lat.piece[e])])

    return dict(go(int(lat.start[0]), 0.0, []))


def test_samples_are_the_top_k_distribution(vocabulary):
    every = {k: float(np.exp(x)) for k, x in paths_of(" hello", vocabulary).items()}
    assert abs(sum(every.values()) - 1) < 1e-9
    n, first, second, weight = 6000, Counter(), Counter(), Counter()
    for found, _ in pieces.sample_texts(["hello"] * n, pieces.row_keys(list(range(n)), 5), vocabulary, 3):
        ids = [tuple(f[0].tolist()) for f in found]
        assert len(set(ids)) == 3 and found[0][2] > found[1][2] > found[2][2]
        first[ids[0]] += 1
        second[ids[:2][0], ids[1]] += 1
        for i, f in zip(ids, found, strict=True):
            assert abs(f[1] - np.log(every[i])) < 1e-6
            weight[i] += 1 / np.exp(f[3])
    top = sorted(every, key=every.get, reverse=True)[:2]
    assert all(abs(first[i] / n - every[i]) < 0.025 for i in every)
    a, b = top
    assert abs(second[a, b] / n - every[a] * every[b] / (1 - every[a])) < 0.025
    assert all(abs(weight[i] / n - 1) < 0.1 for i in top)  # inverse inclusion weights are unbiased


def test_segmentations_decode(spark, vocabulary):
    rng = random.Random(3)
    _, docs = odd_documents(spark, rng)
    odd = spark.createDataFrame([(400, "▁x ▁▁ \u2581"), (401, "日本語😀\n\n a  b\t"), (None, "no id"), (402, "x" * 400)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text", "n", "id").unionByName(odd, allowMissingColumns=True)
    out = pieces.sample(both, vocabulary, k=3)
    rows = out.collect()
    assert all(r.round_trip for r in rows) and len(rows) == both.count()
    empty = next(r for r in rows if r.doc_id == 300)
    assert empty.text is None and [(s.n_pieces, s.log_p, s.log_inclusion) for s in empty.samples] == [(0, 0.0, 0.0)]
    assert all(len({tuple(s.ids) for s in r.samples}) == len(r.samples) for r in rows)
    again = {(r.doc_id, r.text): [s.ids_sha256 for s in r.samples] for r in pieces.sample(both.repartition(7), vocabulary, k=3, with_ids=False).collect()}
    assert again == {(r.doc_id, r.text): [s.ids_sha256 for s in r.samples] for r in rows}
    clash = pieces.sample(docs.select("doc_id", "text").withColumns({c: F.lit(1) for c in ("samples", "n_units", "round_trip")}), vocabulary, k=1)
    assert {f.name for f in clash.schema} == {"doc_id", "text", "samples", "n_units", "round_trip"} and clash.where("round_trip").count() == docs.count()
    assert pieces.sample(docs.where("false"), vocabulary).count() == 0
    flat = out.where("doc_id is not null").select("doc_id", F.col("text").alias("said"), F.get("samples", F.lit(1))["ids"].alias("ids")).where("ids is not null")
    assert flat.count() and pieces.decode(flat, vocabulary).where("not (said <=> text)").count() == 0
    one = [r for r in rows if r.doc_id == 305]
    assert len(one[0].samples) == min(3, len(paths_of(" one", vocabulary)))


# --- 4 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "most"), [(9, 200_000), (40, 200_000), (200, 200_000), (40, 2), (200, 3)])
def test_repeats(spark, monkeypatch, length, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SURROUNDINGS", most)
    rng = random.Random(length)
    rows, docs = odd_documents(spark, rng)
    passage = words(rng, 120)
    rows = rows + [(500 + i, words(rng, i) + " " + passage[i % 7 : len(passage) - i % 5] + words(rng, 3)) for i in range(40)] + [(600, "Der " * 200), (601, "Der " * 90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit(2), "key": F.lit(3), "h": F.lit(4)}).repartition(5)
    got = suffix_dedup.dedup(df, length=length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute.repeats(rows, length)
    assert suffix_dedup.dedup(df.where("false"), length=length).count() == 0


def test_repeated_rows_and_null_ids(spark):
    t = words(random.Random(1), 60)
    got = suffix_dedup.dedup(spark.createDataFrame([(1, t), (1, t), (None, t + "x"), (2, "other"), (1, "different text of one id")], "doc_id bigint, text string"), length=20).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted([(1, len(t), len(t)), (1, len(t), len(t)), (0, len(t) + 1, len(t)), (2, 5, 0), (1, 24, 0)])


def test_passages(spark):
    rng = random.Random(12)
    shared, said = words(rng, 30), words(rng, 9)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in range(30)]
    rows += [(100 + i, words(rng, i % 5) + " " + shared[: len(shared) - 3 * i].replace(" ", "\n " if i % 2 else " ").upper() + "  " + words(rng, i % 4)) for i in range(14)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "ab " * 50), (204, "x"), (205, said), (206, said + " é"), (207, words(rng, 30_000) + " " + shared), (208, "y" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit(2), "key": F.lit(3), "spans": F.lit(4)}).repartition(5)
    got = {r.doc_id: (r.kept, r.n_removed) for r in suffix_dedup.passages(df, words=8).collect()}
    want = {i: x for (i, _), x in zip(rows, brute.passages([t for _, t in rows], 8), strict=True) if x[1]}
    assert got == want and len(want) > 15
    assert {r.doc_id: r.n_removed for r in suffix_dedup.passage_words(df, words=8).collect()} == {i: n for i, (_, n) in want.items()}
    assert suffix_dedup.passages(df.where("false")).count() == 0 and suffix_dedup.passages(df.where("doc_id < 0")).count() == 0
    twice = spark.createDataFrame([(None, said), (None, said)], "doc_id bigint, text string")
    assert [(r.n_words, r.n_removed, r.kept) for r in suffix_dedup.passages(twice, words=8).collect()] == [(9, 9, "")] * 2


def test_op4_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    shared, long = words(rng, 60), words(rng, 300)
    rows = [(i, words(rng, 80)) for i in range(20)] + [(100 + i, f"{words(rng, i)} {shared} {words(rng, 9)}") for i in range(3)] + [(200 + i, words(rng, i + 1) + " " + long) for i in range(3)] + [(300, None), (301, ""), (302, long), (302, long)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect())
    bytes_ = brute.repeats(rows, 400)
    assert got == sorted((i, *bytes_[i], n) for (i, _), (_, n) in zip(rows, brute.passages([t for _, t in rows], 50), strict=True))
    assert sum(r[2] == 0 < r[5] for r in got) >= 3


def test_large_groups_like_pairs(monkeypatch):
    rng = random.Random(5)
    tail = "".join(rng.choice("ab") for _ in range(40))
    texts = sorted({("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + tail[rng.randint(0, 2) :] + "".join(rng.choice("ab") for _ in range(9))).encode() for _ in range(80)})
    for length in (12, 30, 42):
        strings = sorted({suffix_dedup.around(t, p, length) for t in texts for p in range(0, len(t), 7)})
        parts = [suffix_dedup._split(x) for x in strings]
        shared = [suffix_dedup.common(strings[i - 1], strings[i]) if i else 0 for i in range(len(parts))]
        want = suffix_dedup._few(parts, shared, length)
        assert [x if sum(x) >= length else 0 for x in suffix_dedup._many(parts, shared, length)] == [x if sum(x) >= length else 0 for x in want]
    with monkeypatch.context() as m:  # hashes that are all equal: bytes decide
        m.setattr(suffix_dedup.K, "uniform_bits", lambda n, seed: np.zeros(n, np.uint64))
        assert suffix_dedup._many(parts, shared, length) == want


def test_ranges_dealt_by_seed(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 2)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 500)
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(i, words(rng, 20) + passage[i : 90 + i] + words(rng, 20)) for i in range(30)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), length=30).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(rows, 30)


def test_merge_never_loses_order_or_prefixes():
    rng = random.Random(4)
    for _ in range(60):
        sets = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        runs = []
        for s in sets:
            coded, last = [], b""
            for x in s:
                k = suffix_dedup.common(last, x)
                coded.append((k, x[k:], 1))
                last = x
            runs.append(coded)
        out = list(suffix_dedup.merged(runs))
        assert [s for _, s, _ in out] == sorted(itertools.chain(*sets))
        assert all(k == suffix_dedup.common(a[1], b[1]) for a, b, k in zip(out, out[1:], [o[0] for o in out[1:]], strict=False))


# --- 5 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "percent", "cells", "most"), [(3, 90, 1 << 20, 64), (2, 60, 60, 64), (1, 50, 1 << 20, 2), (2, 80, 40, 1)])
def test_jaccard(spark, monkeypatch, width, percent, cells, most):
    monkeypatch.setattr(jaccard, "MOST_ROWS", most)
    monkeypatch.setattr(jaccard, "SKETCHES_A_TASK", most)
    rng = random.Random(percent)
    rows, _ = odd_documents(spark, rng)
    family = words(rng, 50).split()
    for i in range(50):  # near copies, linked in chains
        copy = list(family)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append((700 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "n": F.lit(2), "d1": F.lit(3), "block": F.lit(4)}).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, width=width, percent=percent, block_cells=cells).collect()}
    assert got == brute.jaccard(rows, width, percent)


def test_jaccard_blocks_of_common_grams_are_divided(spark, monkeypatch):
    """Where all n-grams are common, columns tie all texts together: only those that may link go on."""
    monkeypatch.setattr(jaccard, "MOST_ROWS", 2)
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    rng = random.Random(3)
    few = [words(rng, 1) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(few, k=60))) for i in range(300)]
    rows += [(1000 + i, " ".join([*t.split()[:-1], "other"])) for i, t in rows[:40]]
    members, cut = [], jaccard.cut

    def noted(df, name):
        out = cut(df, name)
        if name == "members":
            members.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", noted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, block_cells=500).collect()}
    assert got == brute.jaccard(rows, 5, 80)
    assert 80 <= members[0] < 170


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linking_sets_share_a_token(percent):
    rng = np.random.default_rng(percent)
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    bands = jaccard.size_bands(percent, least)
    tokens = lambda grams: set(jaccard.part_tokens(np.sort(grams), percent, bands).tolist())
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(least, 8 * least + 40))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        gone, new = (int(x) for x in rng.integers(0, n * (100 - percent) // percent + 2, 2))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
        if len(b) >= least and 100 * (n - gone) >= percent * (n + new):
            linked += 1
            assert tokens(a) & tokens(b)
    assert linked > 300


@pytest.mark.parametrize(("percent", "ranked"), [(80, True), (90, True), (90, False)])
def test_few_common_grams_tie_no_blocks(percent, ranked):
    """Sets that have a tenth of common n-grams beside their own share no token; linking sets do, whatever the ranks."""
    rng = np.random.default_rng(percent)
    bands = jaccard.size_bands(percent, 9)
    common = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(common, n // 10, False), rng.integers(0, 1 << 63, n - n // 10, dtype=np.uint64) * np.uint64(2)])) for n in rng.integers(300, 1500, 400)]
    rank = lambda grams: (np.isin(grams, common) * 200 * ranked).astype(np.uint8)
    seen = Counter(t for grams in sets for t in set(jaccard.part_tokens(grams, percent, bands, rank(grams)).tolist()))
    assert max(seen.values()) == 1
    tokens = lambda grams: set(jaccard.part_tokens(grams, percent, bands, (grams >> np.uint64(40)).astype(np.uint8)).tolist())
    for grams in sets:
        most = len(grams) * (100 - percent) // 100
        near = np.delete(grams, rng.choice(len(grams), int(rng.integers(0, most + 1)), False))
        assert tokens(grams) & tokens(near)


def test_jaccard_odd_rows(spark):
    t = words(random.Random(9), 30)
    df = spark.createDataFrame([(4, t), (4, t), (2, t), (None, t), (7, None), (8, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 26, 2), (4, 26, 2), (2, 26, 2), (0, 26, 2), (7, 0, 7), (8, 0, 8)], key=str)
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_jaccard_tells_rows_of_one_id_apart(spark):
    a, b, c = (words(random.Random(i), 40) for i in (1, 2, 3))
    rows = [(3, a), (5, a + " x"), (5, b), (6, b + " y"), (None, c), (None, c + " z"), (None, c + " z"), (9, " ".join(map(str, range(30_000))) + a), (10, " ".join(map(str, range(30_000))) + a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    key = {r[0:2]: r[2] for r in df.select("doc_id", "text", jaccard.key_of("text", "doc_id")).collect()}
    component = {k: {r.component_id for r in got if r.key == x} for k, x in key.items()}
    assert component == {(3, a): {3}, (5, a + " x"): {3}, (5, b): {5}, (6, b + " y"): {5}, (None, c): {None}, (None, c + " z"): {None}, (9, rows[7][1]): {9}, (10, rows[8][1]): {9}}
    kept = {r.key for r in got if r.kept}
    assert {k for k, x in key.items() if x in kept and k[0] is not None} == {(3, a), (5, b), (9, rows[7][1])} and sum(key[None, t] in kept for t in (c, c + " z")) == 1
    exact = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df.where("doc_id < 6"), percent=100).collect()}
    assert exact == {3: 3, 5: 5}


# --- 6 -----------------------------------------------------------------------------------------


def test_counts_after_edits():
    enc = token_counts.encoding(token_counts.load_ranks())
    rng = random.Random(6)
    letters = " ab\n\t'.1é中 s  \u00a0\u3000😀"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        tree = token_counts.Tree.of(text, enc, rng.choice([1, 3, 8, 64]))
        assert tree.n_tokens == len(enc.encode_ordinary(text))
        edits, free, want = [], 0, text
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, len(text) + 3)
            edits.append((a, a + rng.choice([0, 0, 1, 5, 40]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 10])))))
        tree.apply(edits, enc)
        clean = []
        for a, b, x in sorted(edits, key=lambda e: e[:2]):
            a = max(a, free)
            b = free = max(a, b)
            clean.append((a, b, x))
        for a, b, x in reversed(clean):
            want = want[:a] + x + want[b:]
        assert (tree.text(), tree.n_tokens, tree.n_chars) == (want, len(enc.encode_ordinary(want)), len(want))


def test_only_touched_leaves_are_encoded(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, [(12_000, 12_004, "new")]), (2, None), (3, [(0, 5, "abc")])], f"doc_id bigint, edits {token_counts.EDITS}")
    built = token_counts.build(df)
    out = {r.doc_id: r for r in token_counts.recount(built.join(e, "doc_id")).collect()}
    enc = token_counts.encoding(token_counts.load_ranks())
    assert all(out[i].n_tokens == len(enc.encode_ordinary(out[i].text or "")) for i in out)
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (4, "long word " * 30_000)], "doc_id bigint, text string")
    clash = rows.withColumns({c: F.lit(1) for c in ("n_tokens", "leaf_chars", "leaf_tokens", "n_encoded_chars")})
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.build(clash).collect()) == [(i or 0, len(enc.encode_ordinary(t))) for i, t in sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda x: x[0] or 0)]
    assert token_counts.build(rows.where("false")).count() == 0
    assert 0 < out[1].n_encoded_chars < 2500 and out[2].n_tokens == 0 and out[3].text == "abc"


# --- 7 -----------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "a\\\\[INST", "<<SYS>>x<</SYS>>", "<", "[ROLE] [:] [/ROLE]", "", None, "\n\n", "é😀 " * 50, "x [/INST] <s>\\</s>"]
    roles = ["user", "assistant", "system", "tool [:] x", None, ""]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(roles), rng.choice(hard)) for c in range(30) for t in range(rng.randint(1, 7))] + [(99, 5, "user", "same"), (99, 5, "user", "same"), (None, None, "user", "x"), (98, 600, "assistant", "later"), (98, 2, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"_c": F.lit(1), "block": F.lit(2)}).repartition(5)
    chats = chat.format_chats(df, block=3)
    got = {r.conv_id: r for r in chats.select("conv_id", "valid", "segments", "formatted", chat.read_chats(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in got[c].turns] == want and all(t.loss == (t.role == "assistant") for t in got[c].turns)
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert got[98].valid and not got[99].valid
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


# --- 8 -----------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.example.ORG/es/x", "https://example.org/en/15?q#f", "x://org", "http://org/", "http://notorg/", "http://sub.com/fr/", "http://com/de/1", None, "no scheme", "http://u.example.org?/es/", "http://h://org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([("http://bad.net/1", 0)] * 30 + [("http://good.net/1", 1)] * 30 + [("http://good.net/2", None)], "url string, good int")
    judged = url_filter.judge(pages.unionByName(spark.createDataFrame([(100, "http://bad.net/9"), (101, "http://good.net/9"), (102, "http://new.net/9")], pages.schema)), labels, queries.URL_RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got[0][2:] == ("example.org/es/", "block") and got[1] == ("example.org", "/en/15", "example.org/en/1", "block")
    assert got[2][:3] == ("org", "", None) and got[3][2:] == ("org/", "allow") and got[4][2] is None and got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][:2] == got[8][:2] == ("", "") and got[9][:3] == ("u.example.org", "", None) and got[10][0] == "h:"
    assert got[100][3] == "block" and got[101][3] == "allow"
    clash = pages.withColumns({c: F.lit(i) for i, c in enumerate(("host", "path", "rule", "verdict", "bound"))}).unionAll(pages.withColumns({c: F.lit(i) for i, c in enumerate(("host", "path", "rule", "verdict", "bound"))}))
    again = url_filter.judge(clash, labels, queries.URL_RULES).collect()
    assert len(again) == 2 * len(urls) and {(r.page_id, r.host, r.path, r.rule) for r in again} == {(i, *got[i][:3]) for i in range(len(urls))}
    names = spark.createDataFrame([("u:p@a.co.uk:80",), ("b.a.co.uk.",), ("10.0.0.1:8080",), ("[::1]:80",), ("localhost",), ("",), ("a" * 5000 + ".x.org",)], "h string")
    assert [tuple(r) for r in names.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()] == [("a.co.uk", "co.uk"), ("a.co.uk", "co.uk"), ("10.0.0.1", ""), ("[::1]", ""), ("localhost", "localhost"), ("", ""), ("x.org", "org")]
    none = url_filter.judge(pages, labels.where("false"), [("block", "org/")])
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"} and url_filter.judge(pages.where("false"), labels, queries.URL_RULES).count() == 0


# --- 9 -----------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    scored = queries.op9_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.98


def test_quality_against_plain_ftrl(spark):
    rng = random.Random(13)
    vocabulary = ["ab", "Cd", "é1", "ef", "%%", "->", "x"]
    texts = [" ".join(rng.choice(vocabulary[: 5 + i % 3]) for _ in range(rng.randint(0, 25))) for i in range(60)] + [None, "", "ab ab ab Cd ab", "é" * 3000]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id bigint, text string, label int")
    order = [r.doc_id for r in df.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).select("doc_id").collect()]
    for most in (1000, 20):
        weights = quality.train(df.repartition(3), bits=10, epochs=2, most_rows=most)
        model = brute.Ftrl()
        for _ in range(2):
            for i in order[:most]:
                model.learn(brute.Ftrl.row(texts[i], 10), i % 2)
        got = {r.doc_id: r.score for r in quality.score(df, weights).collect()}
        assert all(abs(got[i] - model.score(brute.Ftrl.row(t, 10))) < 1e-9 for i, t in enumerate(texts))


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words")], "doc_id bigint, text string").withColumns({"t": F.lit(1), "y": F.lit(2), "h": F.lit(3)})
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (1, None)], "doc_id bigint, quality int")
    w = quality.train(quality.sample(df, labels))
    s = quality.score(df, w).collect()
    assert len(s) == 4 and s[0].score == s[1].score and all(0 <= r.score <= 1 for r in s)
    none = quality.train(quality.sample(df, labels.where("false")))
    assert not none.any() and {r.score for r in quality.score(df, none).collect()} == {0.5} and quality.score(df.where("false"), none).count() == 0
    assert quality.sample(spark.range(50).selectExpr("id as doc_id", "'x' as text"), spark.range(50).selectExpr("id as doc_id", "1 as quality"), most_rows=7).count() == 7


# --- 10 ----------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LEAST_TILE", 20)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    rows = [*base, *(base[:30] + 0.25 * rng.standard_normal((30, 16))), *base[:5], *(base[5:10] * 1e-200), *(base[10:15] * 1e200)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0, None] + [0.0] * 14), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] + [0.0] * 15)]
    short = [(950 + i, [1.0, 0.1 * i]) for i in range(3)] + [(960, [1.0]), (961, [7.0]), (962, [-1.0])]
    df = spark.createDataFrame(data + odd + short + [(3, data[3][1])], "vec_id bigint, embedding array<double>").withColumns({"v": F.lit(1), "n": F.lit(2), "at": F.lit(3), "id": F.lit(4)}).repartition(3)
    got = vector_dedup.near_duplicates(df).collect()
    every = [*data, (3, data[3][1])]
    x = np.array([v for _, v in every])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    u = brute.Union()
    for i, j in zip(*np.nonzero(link), strict=True):
        u.join(every[i][0], every[j][0])
    want = sorted([(i, int(n), u.root(i), u.root(i) == i) for (i, _), n in zip(every, link.sum(axis=1), strict=True)] + [(i, 0, i, True) for i, _ in odd if i != 904] + [(904, 0, 904, True), (950, 2, 950, True), (951, 2, 950, False), (952, 2, 950, False), (960, 1, 960, True), (961, 1, 960, False), (962, 0, 962, True)])
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0 and vector_dedup.near_duplicates(df.where("vec_id in (900, 901)")).count() == 2


# --- kernel ------------------------------------------------------------------------------------


def test_range_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abcXabcYYabc", np.uint8)
    p = _kernel.prefix_hashes(data)
    h = _kernel.range_hashes(p, np.array([0, 4, 9, 1]), np.array([3, 7, 12, 4]))
    assert h[0] == h[1] == h[2] != h[3]
