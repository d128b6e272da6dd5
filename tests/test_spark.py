import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quireflow import queries
from quireflow.functions import cfi, text, uri, values
from quireflow.kernels.markup import MAX_DEPTH
from quireflow.operators import conformance, positions, publication, reader, search, titles
from quireflow.operators import text as extraction
from quireflow.operators.running import last_before, numbered, running_sum
from quireflow.sources import epub_zip
from quireflow.sources.library import Library, report
from quireflow.streaming import events
from tests import books

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in books.BOOKS.items()], "book string, content binary")
    return Library.of(rows)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_library_tables(library):
    assert rows(library.errors, "book", "kind") == [("broken_spine", "package"), ("cycle", "package"), ("duplicate_id", "package"), ("entity_attack", "security"), ("not_linear", "package"), ("wrong_mimetype", "package")]
    assert rows(library.reading_order.where("book = 'simple'"), "idx", "href") == [(0, "OEBPS/ch%201.xhtml"), (1, "OEBPS/two.xhtml")]
    assert rows(library.metadata().where("book = 'rich'"), "title", "subtitle") == [("Main Title", "Sub")]
    assert json.loads(library.metadata_json().where("book = 'simple'").first().json)["languages"] == ["en"]
    assert ("clamped", "url-leaks-container") in rows(library.warnings, "book", "code")


def test_members_and_fonts(spark, library):
    wanted = spark.createDataFrame([(b, "OEBPS/f.otf") for b in ("idpf", "adobe", "unsupported")] + [("simple", "OEBPS/two.xhtml#x"), ("simple", "nowhere")], "book string, href string")
    got = {(r.book, r.href): r for r in library.resources(wanted).collect()}
    assert bytes(got["idpf", "OEBPS/f.otf"].content) == books.FONT == bytes(got["adobe", "OEBPS/f.otf"].content)
    assert got["unsupported", "OEBPS/f.otf"].error.kind == "resource" and got["simple", "nowhere"].error is not None
    part = library.resources(wanted.where("book = 'idpf'"), 1030, 1050).first()
    assert bytes(part.content) == books.FONT[1030:1050]


def test_data_source(spark, tmp_path):
    for name, data in books.BOOKS.items():
        (tmp_path / f"{name}.epub").write_bytes(data)
    (tmp_path / "broken.epub").write_bytes(b"PK no")
    epub_zip.register(spark)
    df = spark.read.format("epub_zip").option("content", "true").option("members", "two[.]xhtml$").load(str(tmp_path))
    found = {r.book.rpartition("/")[2]: r for r in df.collect()}
    assert bytes(found["simple.epub"].content).startswith(b"<html") and found["broken.epub"].error.kind == "archive"
    assert spark.read.format("epub_zip").load(str(tmp_path)).where("path = 'mimetype'").count() == len(books.BOOKS)
    lib = Library.read(spark, str(tmp_path))
    assert lib.books.count() == len(books.BOOKS) + 1


def test_conformance(spark, library):
    want = spark.createDataFrame([("simple", "spine", "3"), ("simple", "toc", "3"), ("rich", "direction", "ltr")], "book string, check string, want string")
    out = {r.book: r for r in conformance.run(library, want).collect()}
    assert out["simple"].outcome == "passed" and out["simple"].positions == 2 and out["rich"].outcome == "failed" and out["rich"].detail == "direction"
    assert out["entity_attack"].outcome == "refused:security" and out["bad_chapter"].outcome == "unreadable"
    assert json.loads(report(conformance.run(library)))["total"] == len(books.BOOKS)


def test_library_search_and_titles(spark, library):
    b = extraction.blocks(extraction.extract(library.documents().drop("error"), keep=["book", "idx"]), ["book", "idx"])
    asked = spark.createDataFrame([(1, "WHALE")], "query_id bigint, query string")
    found = search.hits(b.where("book = 'simple'"), asked, ["book", "idx", "block"])
    assert rows(found, "idx", "block", "start") == [(0, 1, 4), (0, 2, 9)]
    order = library.reading_order.where("book = 'simple'")
    toc = titles.entries(library.nav, publication.targets(library.nav.select("book", "href").distinct(), order, order.where("false")))
    ids = extraction.extract(library.documents().drop("error"), keep=["book", "idx"]).select("book", "idx", F.explode("ids").alias("id", "offset"))
    points = spark.createDataFrame([("simple", 0, 0), ("simple", 0, 40), ("simple", 1, 3)], "book string, idx bigint, offset bigint")
    named = titles.title_at(points, titles.placed(toc, ids))
    assert rows(named, "idx", "offset", "title") == [(0, 0, "One"), (0, 40, "Deep"), (1, 3, "Two")]
    assert "<ol><li><a href=" in titles.outline(library.nav.where("book = 'simple'")).first().html


def test_locators(spark, library):
    docs = library.documents().where("book = 'simple' and idx = 0").drop("error")
    stored = [{"fragments": None, "progression": 0.9, "position": None, "offset_of_position": None, "partial_cfi": "/4/4/1:4", "before": None, "highlight": "whale", "after": None}]
    schema = "array<struct<fragments:array<string>,progression:double,position:int,offset_of_position:int,partial_cfi:string,before:string,highlight:string,after:string>>"
    asked = docs.crossJoin(spark.createDataFrame([(stored,)], f"stored {schema}")).select("book", "idx", "path", "media_type", "content", "stored")
    r = extraction.resolve_locators(asked, "stored", keep=["book", "idx"]).first()
    assert (r.match, r.highlight, r.partial_cfi) == ("cfi", "whale", "/4/4/1:4")
    spans = docs.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"))))
    assert extraction.locators_for(spans, "spans", keep=["book"]).first().highlight == "Call"
    told = docs.withColumn("cfis", F.array(F.lit("/4/4,/1:4,/1:9"), F.lit("/4/4/1:5[zz]"), F.lit("/x")))
    assert [(r.cfi, r.highlight, r.partial_cfi) for r in extraction.locators_for_cfis(told, "cfis", keep=["book"]).collect()] == [("/4/4,/1:4,/1:9", "whale", "/4/4/1:4")]
    points = docs.withColumn("offsets", F.array(F.lit(0), F.lit(8)))
    assert rows(extraction.cfis_at(points, "offsets", keep=["book"]), "offset", "cfi") == [(0, "/4/2/1:0"), (8, "/4/4/1:0")]
    back = extraction.resolve_cfis(docs.withColumn("cfis", F.array(F.lit("/4/4/1:0"), F.lit("/x"))), "cfis", keep=["book"])
    assert {(r.cfi, r.start) for r in back.collect()} == {("/4/4/1:0", 8), ("/x", None)}


def test_units_in_columns(spark):
    df = spark.createDataFrame([("a😀bé", 1), ("plain", 3)], "t string, u int")
    out = df.select(text.len16(F.col("t")).alias("n"), text.to_code_points(F.col("t"), F.lit(3)).alias("c"), text.substring16(F.col("t"), F.lit(3), F.lit(5)).alias("s"), text.to_units16(F.col("t"), F.lit(2)).alias("u")).collect()
    assert [tuple(r) for r in out] == [(5, 2, "bé", 3), (5, 3, "in", 2)]


def test_fold_columns_agree_with_the_kernel(spark):
    from quireflow.kernels import folding

    samples = ["Ünïcode  CAFÉ x", "éa­b", "ΣΑΣ ς", "Łódź", "İstanbul", "ﬁ ß が"]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert all(r.f == folding.fold(r.t).text for r in got if r.t != "İstanbul")


def test_value_functions(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "c binary")
    assert bytes(df.select(values.slice_bytes(F.col("c"), F.lit(1), F.lit(3)).alias("x")).first().x) == b"el"
    with pytest.raises(Exception, match="outside"):
        df.select(values.slice_bytes(F.col("c"), F.lit(1), F.lit(9))).collect()
    s = spark.createDataFrame([('"{\\"a\\":1}"',), ('{"a":1}',)], "t string").select(values.script_result(F.col("t")).alias("x")).collect()
    assert [r.x for r in s] == ['{"a":1}', '{"a":1}']
    assert spark.range(1).select(uri.fragment(F.lit("a#b%20c+d")).alias("f")).first().f == "b c+d"


def test_cfi_columns(spark):
    cfi.register(spark)
    r = spark.sql("SELECT cfi_parse('epubcfi(/6/4!/4/2/1:3)') AS a, cfi_parse('/04') AS b, cfi_between('/4/2/1:1', '/4/2/1:5') AS c, cfi_split('/6/4!/4/2').content AS d").first()
    assert r.a.canonical == "epubcfi(/6/4!/4/2/1:3)" and r.b.error and r.c == "epubcfi(/4/2/1,:1,:5)" and r.d == "/4/2"
    one = spark.createDataFrame([("/4,/2,/6", "/4/4/1:2", "/4/8")], "a string, b string, c string").select(*[cfi.cfi_parse(x).alias(x) for x in "abc"])
    assert one.select(cfi.contains(F.col("a"), F.col("b")).alias("x"), cfi.contains(F.col("a"), F.col("c")).alias("y")).first() == (True, False)


def test_running_values_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 7, 5), (None, 1, 1)], "k string, o bigint, v bigint")
    for block in (1, 7, 1000):
        got = running_sum(df, "k", "o", F.col("v"), "s", block, total="t").where("k = 'a'").orderBy("o").collect()
        assert [r.s for r in got] == [sum(j % 3 for j in range(i)) for i in range(50)] and got[0].t == 49
        assert [r.n for r in numbered(df, "k", "o", "n", block).where("k = 'a'").orderBy("o").collect()] == list(range(50))
    named = df.withColumn("x", F.when(F.col("o") % 10 == 0, F.col("o").cast("string"))).withColumn("g", F.floor(F.col("o") / 4))
    assert {r.o: r.y for r in last_before(named, "k", ["o"], "g", "x", "y").where("k = 'a'").collect()} == {i: str(i // 10 * 10) for i in range(50)}


def test_positions_edge_cases(spark):
    r = spark.createDataFrame([("b", 0, "x", None, True), ("b", 1, "y", 0, False), ("b", 2, "z", 2049, False)], "book string, idx bigint, href string, length bigint, unreadable boolean")
    t = positions.resources(r)
    assert rows(t, "idx", "start", "count") == [(0, 1, 1), (1, 2, 1), (2, 3, 3)]
    assert rows(positions.totals(t), "positions", "unreadable") == [(5, ["x"])]
    last = positions.positions(t).orderBy("position").collect()[-1]
    assert (last.progression, last.total_progression) == (2048 / 2049, 4 / 5)
    ends = t.select(positions.total_at_progression(F.lit(1.0)).alias("x")).collect()
    assert ends[-1].x == 1.0 and positions.resources(r.where("false")).count() == 0


def test_metadata_columns(spark):
    from quireflow.operators import metadata as M

    m = spark.createDataFrame([("x: http://x/ dcterms: http://own/",), (None,)], "p string").select(M.prefix_map(F.col("p")).alias("m"))
    got = m.select(M.expand(F.lit("x:a"), F.col("m")).alias("a"), M.expand(F.lit("dcterms:b"), F.col("m")).alias("b"), M.canonical(M.expand(F.lit("plain"), F.col("m"))).alias("c")).collect()
    assert [tuple(r) for r in got] == [("http://x/a", "http://own/b", "plain"), ("x:a", "http://purl.org/dc/terms/b", "plain")]
    assert spark.range(1).select(publication.merged_properties(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))).alias("m")).first().m == {"a": "3", "b": "2"}
    steps = spark.createDataFrame([("b", 4, None), ("b", 4, "zz"), ("b", 9, "i2")], "book string, step int, id string")
    spine = spark.createDataFrame([("b", 0, 2, "r1", "i1"), ("b", 1, 4, "zy", "i2"), ("b", 2, 6, "zz", "i3")], "book string, pos int, step int, ref_id string, idref string")
    assert sorted(r.pos for r in publication.spine_item_of(steps, spine).collect()) == [1, 1, 2]


def test_fallback_chains_of_any_length(spark):
    n = 300
    items = [("long", f"i{k}", f"i{k + 1}" if k < n else None) for k in range(n + 1)] + [("ring", "a", "b"), ("ring", "b", "a"), ("ring", "c", "gone"), ("ring", "d", "d"), (None, "x", "y"), (None, "y", None)]
    m = spark.createDataFrame(items, "book string, item_id string, fallback string").repartition(3)
    chains = publication.fallback_chains(m)
    assert chains.where("book = 'long' and item_id = 'i0'").count() == n and chains.where("item_id = 'i0' and step = 300").first().target == "i300"
    assert rows(chains.where("book = 'ring'"), "item_id", "step", "target", "cyclic") == [("a", 1, "b", False), ("a", 2, "a", True), ("b", 1, "a", False), ("b", 2, "b", True), ("d", 1, "d", True)]
    assert rows(chains.where("book is null"), "item_id", "target") == [("x", "y")] and publication.fallback_chains(m.where("false")).count() == 0
    errors = {(r.book, r.item_id): r.message for r in publication.fallback_errors(m).collect()}
    assert set(errors) == {("ring", "a"), ("ring", "b"), ("ring", "d")} | {("long", f"i{k}") for k in range(n - 128)} and "circle" in errors["ring", "a"] and "long" in errors["long", "i0"]
    plan = chains._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_containers_are_never_shuffled(spark, library, tmp_path):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    wanted = spark.createDataFrame([("simple", "OEBPS/two.xhtml")], "book string, href string")
    assert exchanges(library.documents()) == 0 and exchanges(library.entries()) == 0
    plan = library.resources(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    kept = library.kept(f"file://{tmp_path}/books")
    assert rows(kept.reading_order, "book", "href") == rows(library.reading_order, "book", "href") and "MapInArrow" not in kept.manifest._jdf.queryExecution().executedPlan().toString()
    assert kept.entries(content=True).where("book = 'simple' and path = 'mimetype'").first().content == b"application/epub+zip"


def test_folding_runs_once(spark):
    lines = spark.createDataFrame([("The  caf\u00e9 the",), ("PLAIN the\tthe",), (None,), ("",), ("\u00adthe\u200b other",)], "text string")
    found = search.counts(lines, "the").where("n > 0")
    assert sorted(r.n for r in found.collect()) == [2, 2, 2] and sorted(r.n for r in search.word_counts(lines, "thé").where("n > 0").collect()) == [1, 2, 2]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 4


def test_reader_relations(spark):
    boxes = spark.createDataFrame([("a", 1, 0, 0, 300, 300), ("b", 2, 200, 200, 900, 400)], "id string, order int, left int, top int, right int, bottom int")
    taps = spark.createDataFrame([(1, 250, 250), (2, 10, 10), (3, 950, 10)], "tap int, x int, y int")
    assert rows(reader.hit_test(taps, boxes), "tap", "id") == [(1, "b"), (2, "a")]
    assert rows(reader.bounds(boxes, 500, 300), "id", "right", "bottom") == [("a", 300, 300), ("b", 500, 300)]
    urls = spark.createDataFrame([("http://127.0.0.1/t/a.html",), ("http://127.0.0.1/t/b.html",), ("https://x",), ("file:///x",)], "u string")
    assert [r.d for r in urls.select(reader.decide(F.col("u"), F.lit("http://127.0.0.1/t/"), F.lit("a.html")).alias("d")).collect()] == ["load", "navigate", "external", "block"]


def stream(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_debounce_as_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("reader"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    batch = events.debounced(e, "30 minutes", "type")
    live = events.debounced(stream(spark, e.repartition(1), tmp_path / "in"), "30 minutes", "type", late="1 day")
    q = live.writeStream.outputMode("append").format("memory").queryName("bursts").start()
    drain(q)
    got = {(r.reader, r.ts, r.n) for r in spark.table("bursts").collect()}
    want = {(r.reader, r.ts, r.n) for r in batch.collect()}
    assert got and got <= want


def test_stale_locations_are_dropped(spark, tmp_path):
    rows_ = [(1, 2, "2024-01-01 00:00:01", "b", 0.1), (1, 1, "2024-01-01 00:00:09", "a", 0.9), (1, 2, "2024-01-01 00:00:05", "b", 0.5), (2, 1, "2024-01-01 00:00:01", "a", 0.2)]
    df = spark.createDataFrame(rows_, "reader bigint, epoch bigint, t string, href string, progression double").select("reader", "epoch", F.to_timestamp("t").alias("ts"), "href", "progression").coalesce(1)
    q = events.location_state(stream(spark, df, tmp_path / "in")).writeStream.outputMode("update").format("memory").queryName("places").start()
    drain(q)
    assert sorted((r.reader, r.epoch, r.href, r.progression) for r in spark.table("places").collect()) == [(1, 2, "b", 0.5), (2, 1, "a", 0.2)]


def test_decoration_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", 1, '[{"id":"a"}]'), (1, "g", 3, "[]"), (1, "g", 2, '[{"id":"b"}]'), (1, "h", 4, '[{"id":"c"}]')], "reader bigint, group string, revision bigint, items string").coalesce(1)
    q = events.decoration_state(stream(spark, df, tmp_path / "in")).writeStream.outputMode("update").format("memory").queryName("marks").start()
    drain(q)
    assert sorted((r.group, r.revision, r["items"]) for r in spark.table("marks").collect()) == [("g", 3, "[]"), ("h", 4, '[{"id":"c"}]')]


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(normal(tuple(r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert ours == sorted(repr(normal(r)) for r in theirs)


def test_queries_without_sql(spark):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_locator_json(spark):
    from quireflow.functions import locator as L

    good = '{"href":"a.html","type":"text/html","x":1,"locations":{"progression":0.5,"position":3.0,"partialCfi":"/4","cssSelector":7,"fragments":["f"]},"text":{"highlight":"h"}}'
    bad = ['{"href":"a#b","type":"text/html"}', '{"href":"a","type":"nope"}', '{"href":"a","type":"text/html","locations":{"position":1.5}}', '{"href":"a","type":"text/html","locations":{"progression":2}}', '{"href":"a","type":"text/html","text":{"after":1}}', "[]", "x", '{"href":"a","type":"text/html","title":4}']
    df = spark.createDataFrame([(good,)] + [(b,) for b in bad], "j string").select("j", L.from_json(F.col("j")).alias("l"))
    rows_ = df.select("l.*", L.partial_cfi(F.col("l.locations")).alias("c"), L.css_selector(F.col("l.locations")).alias("s")).drop("locations").collect()
    assert (rows_[0].href, rows_[0].position, rows_[0].fragments, rows_[0].highlight, rows_[0].c, rows_[0].s, rows_[0].error) == ("a.html", 3, ["f"], "h", "/4", None, None)
    assert [r.error for r in rows_[1:]] == ["href or type", "href or type", "position", "progression", "text", "json", "json", "title"]
    back = df.limit(1).select(L.to_json(F.col("l").dropFields("locations").withField("partial_cfi", F.lit("/4"))).alias("j")).first().j
    assert json.loads(back) == {"href": "a.html", "type": "text/html", "locations": {"fragments": ["f"], "progression": 0.5, "position": 3, "partialCfi": "/4"}, "text": {"highlight": "h"}}
    link = spark.range(1).select(L.from_link(F.lit("a%20b.html#x%20y"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("T")).alias("l")).first().l
    assert (link.href, link.type, link.title, link.fragments, link.progression) == ("a%20b.html", "application/octet-stream", "T", ["x y"], None)
    assert spark.range(1).select(L.offset_at_progression(F.lit(0.5), F.lit(9))).first()[0] == 5
    assert df.limit(1).select(L.is_empty(F.col("l")).alias("e"), L.copy_with(F.col("l"), title=F.lit("n"), position=F.lit(None).cast("int"))["title"].alias("t")).first() == (False, "n")


def found_by_brute_force(folder=SF.replace("sf0.001", "sf0.01")):
    """(item_id, doc_id, start, end) of benchmark items in document texts, white space as the item has it or not."""
    con = duckdb.connect()
    docs, items = (con.sql(f"SELECT * FROM (SELECT {k}, text FROM read_parquet('{folder}/{t}.parquet'))").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    wanted = [(i, re.compile(r"\s+".join(map(re.escape, t.split())))) for i, t in items]
    return sorted((i, k, *m.span()) for k, t in docs for i, r in wanted for m in r.finditer(t))


def test_all_items_are_found_in_whole_texts(spark):
    want = found_by_brute_force()
    assert len(want) == 26 and rows(queries.QUERIES["search_items"](spark, SF.replace("sf0.001", "sf0.01")), "query_id", "doc_id", "start", "end") == want


def test_every_item_in_its_documents_goes_down_the_ladder(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    raw = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{folder}/documents.parquet')").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM read_parquet('{folder}/benchmark.parquet')").fetchall())
    want = []
    for item, doc in {x[:2] for x in found_by_brute_force()}:
        lines = [x for line in raw[doc].split("\n") if (x := " ".join(line.split()))]
        read = "\n".join(lines)
        begins = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
        for m in re.finditer(r"\s+".join(map(re.escape, items[item].split())), read):
            a, b = m.span()
            want += [(item, doc, a, "cfi", "cfi", a, b, m[0]), (item, doc, a, "text", "text", a, b, m[0]), (item, doc, a, "stale", "cfi", a, a, None)]
            want += [(item, doc, a, "fragment", "fragment", at := max(x for x in begins if x <= a), at, None), (item, doc, a, "progression", "progression", a, a, None)]
            want += [(item, doc, a, "position", "position", a // 1024 * 1024, a // 1024 * 1024, None), (item, doc, a, "start", "start", 0, 0, None)]
    got = queries.QUERIES["resolve_locations"](spark, folder).select("item_id", "doc_id", "hit_start", "stored", "match", "start", "end", "highlight").collect()
    assert len(want) == 26 * 7 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_cfi_roundtrip_counts_what_leads_nowhere(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "http://x/a", "<p>plain text</p>"), (2, "http://x/b", None), (3, "http://x/c", "<p>deep"), (4, "http://x/d", "<div>" * (MAX_DEPTH + 9))], "page_id bigint, url string, html string")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    count = lambda: queries.QUERIES["cfi_roundtrip"](spark, f"file://{tmp_path}").first().wrong
    assert count() == 2
    lost = spark.createDataFrame([(1, 0, 0, None, None, None, None), (1, 0, 0, "exact", 0, 0, 1), (1, 7, 7, "exact", 8, 7, 8)], "page_id bigint, offset int, canonical int, match string, back int, range_start int, range_end int")
    monkeypatch.setattr(extraction, "cfi_samples", lambda *a, **b: lost)
    assert count() == 2


def test_prepared_pages_answer_for_every_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/a", "<p>a</p>"), (2, "http://x/b", None), (3, "http://x/c", "<p>" + "c" * (8 << 20)), (4, "http://x/d", "")], "page_id bigint, url string, html string")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.path: r for r in queries.QUERIES["prepared_pages"](spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == ["1", "2", "3", "4"] and got["1"].error is None and got["1"].chars > 0 and got["4"].error is None
    assert (got["2"].chars, got["2"].error, got["3"].chars, got["3"].error) == (None, "content: the document is missing", None, "content: the document is too large")


def pages_with_cut_references(spark, folder):
    html = "<!DOCTYPE html><title>{0}</title><body><h1>{0}</h1><p>x"
    titles = ["a &amp;&amp", "b&lt; &lt &quot;", "c &am &ampx; &amp;lt;", "&copy", "d &#38;"]
    spark.createDataFrame([(i, f"http://h/{i}", html.format(t)) for i, t in enumerate(titles)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return ["a &&amp", 'b< &lt "', "c &am &ampx; &lt;", "&copy", "d &"]


def test_h1_with_cut_references(spark, tmp_path):
    wanted = pages_with_cut_references(spark, tmp_path)
    assert rows(queries.QUERIES["page_h1"](spark, str(tmp_path)), "page_id", "h1") == list(enumerate(wanted))
    sql = duckdb.sql(queries.SQL["page_h1"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert sorted(sql)[:4] == list(enumerate(wanted))[:4]  # the SQL knows no numbers


def test_title_with_cut_references(spark, tmp_path):
    wanted = pages_with_cut_references(spark, tmp_path)
    assert rows(queries.QUERIES["page_title"](spark, str(tmp_path)), "page_id", "title") == list(enumerate(wanted))
