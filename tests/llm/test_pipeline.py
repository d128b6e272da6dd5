"""The pipeline against a brute-force version of its stages on a small fixture."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import quality
from tests.llm import brute
from tests.llm.test_operators import brute_scan


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    syllables = ["an", "the", "ou", "ré", "ing", "ble", "st", "ha"]
    sentence = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage, item = sentence(120), sentence(20)
    texts = [sentence(rng.randint(20, 150)) for _ in range(60)]
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i]) for i in range(5)] + [(110 + i, texts[i] + " end") for i in range(5)]
    rows += [(200 + i, sentence(5 + i) + " " + passage + " " + sentence(9)) for i in range(4)] + [(210, item), (211, sentence(400) + " " + item)]
    junk = [(300 + i, " ".join(w + "%%%" for w in sentence(40).split())) for i in range(40)]
    every = rows + junk + [(400, None), (401, "")]
    for name, data, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in every], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", [(i, 0 if i >= 300 else 1, 0) for i, _ in rows + junk], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id bigint, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    d, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = quality.train(quality.sample(docs, spark.read.parquet(f"{d}/labels.parquet")))
    good = {r.doc_id for r in quality.score(docs, weights).where("score >= 0.5").collect()}
    assert not good & set(range(300, 340)) and set(range(60)) <= good
    left = [(i, t) for i, t in every if i in good]
    groups = brute.jaccard(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    short = brute.passages([t for _, t in left], corpus_pipeline.PASSAGE)
    assert sum(n > 0 for _, n in short) >= 3
    cut = {i: t for (i, _), (t, _) in zip(left, short, strict=True)}
    contaminated = {i for i, (n, h, *_) in brute_scan(list(cut.items()), [(1, item)], 13).items() if h and 20 * h >= n}
    assert 210 in contaminated and 211 not in contaminated
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in cut.items() if i not in contaminated}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == want and all(r.round_trip for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece_sampling"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_stages_on_odd_tables(spark, tmp_path):
    """Clashing columns, null ids, repeated rows, ids on several texts, long texts and no rows at all."""
    rng = random.Random(6)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    a, b, passage = sentence(60), sentence(60), sentence(55)
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b + " x"), (None, sentence(20)), (7, None), (7, None), (8, ""), (9, sentence(9000) + " " + passage), (10, passage + " " + sentence(30))]
    names = ("_rows", "_score", "score", "key", "kept", "found", "samples", "rows", "c0", "id", "t")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int").withColumns({n: F.lit(1) for n in names})
    spark.createDataFrame([(3, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of it")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert (out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]) and stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        if name in ("quality_classifier", "benchmark_decontamination", "sentencepiece_sampling"):
            assert out.count() == len(rows)
    left = [(r.doc_id, r.text) for r in stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=repr) == sorted([(3, a), (5, b), (None, rows[5][1]), (7, None), (8, ""), rows[9], rows[10]], key=repr)
    cut = [(r.doc_id, r.text, r.n_chars) for r in stages["suffix_array_dedup"](spark, docs, str(tmp_path)).collect()]
    want = brute.passages([t for _, t in rows], corpus_pipeline.PASSAGE)
    assert sorted(cut, key=repr) == sorted([(i, t, len(t or "")) for (i, _), (t, _) in zip(rows, want, strict=True)], key=repr)
