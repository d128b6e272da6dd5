"""Queries over containers, chapters, CFIs and locators that are made from the driver's rows, and what
DuckDB says to them from the same rows."""

from __future__ import annotations

from collections.abc import Iterator
import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cfi, locator, media, text, uri, values
from .operators import conformance, metadata, positions, publication, reader, titles
from .operators import text as extraction
from .plans import books as B
from .plans import scratch
from .plans import tables as T
from .plans.tables import table
from .sources.library import Library
from .streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _library(spark: SparkSession, d: str) -> Library:
    return Library.of(B.containers(spark, d))


_LEN = "(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_ESC = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_CH = """ch AS (SELECT source || '-' || (n // 16) AS book, n % 16 AS idx, doc_id, lang, text FROM (SELECT source, doc_id, coalesce(lang, '') AS lang, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b-\\x1f\\x{fffe}\\x{ffff}]', '', 'g') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)),
bk AS (SELECT book, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, arg_min(lang, idx) AS lang, regexp_replace(book, '-[0-9]+$', '') AS source, regexp_extract(book, '-([0-9]+)$', 1) AS number FROM ch GROUP BY book)"""
_XHTML = f"""xh AS (SELECT book, idx, doc_id, '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="' || lang || '"><head><title>Doc ' || doc_id || '</title></head><body><h1>Doc ' || doc_id || '</h1>' ||
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '<p id="l' || (i - 1) || '">' || {_ESC.format(x='x')} || '</p>'), '') || '</body></html>' AS content FROM ch)"""
#: Blocks of a chapter: the heading, then each line that holds anything. line is -1 for the heading.
_BLOCKS = f"""raw AS (SELECT book, idx, doc_id, unnest(list_zip(range(-1, len(l) - 1), l)) AS z FROM (SELECT book, idx, doc_id, list_prepend('Doc ' || doc_id, string_split(text, chr(10))) AS l FROM ch)),
lines AS (SELECT book, idx, doc_id, z[1] AS line, z[2] AS raw, trim(regexp_replace(z[2], '[ \\t\\r\\f]+', ' ', 'g')) AS text FROM raw),
blocks AS (SELECT *, row_number() OVER w - 1 AS block, CAST(coalesce(sum({_LEN.format(x='text')} + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST({_LEN.format(x='text')} AS INTEGER) AS len,
  {_LEN.format(x='raw')} - {_LEN.format(x="ltrim(raw, ' ' || chr(9) || chr(13) || chr(12))")} AS lead FROM lines WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
whole AS (SELECT book, idx, doc_id, string_agg(text, chr(10) ORDER BY block) AS text, CAST(max(start + len) AS INTEGER) AS len FROM blocks GROUP BY ALL)"""
_STEP = "CASE WHEN line < 0 THEN '/4/2' ELSE '/4/' || (2 * (line + 2)) || '[l' || line || ']' END"


# --- containers ----------------------------------------------------------------------------------


@query(f"""WITH {_CH}, {_XHTML}
SELECT book, 'mimetype' AS path, 20::BIGINT AS size, 0 AS method, false AS is_dir FROM bk UNION ALL SELECT book, 'pub/face.otf', 1400, 0, false FROM bk
UNION ALL SELECT book, 'pub/a.jpg', 2 + octet_length(encode(book)), 0, false FROM bk UNION ALL SELECT book, 'pub/text/' || doc_id || '.xhtml', octet_length(encode(content)), 8, false FROM xh""")
def container_entries(spark: SparkSession, d: str) -> DataFrame:
    """What the directories of the containers list."""
    own = _library(spark, d).entries().where("path = 'mimetype' or path like 'pub/text/%' or path in ('pub/face.otf', 'pub/a.jpg')")
    return own.select("book", "path", "size", "method", "is_dir")


@query(f"WITH {_CH}, {_XHTML} SELECT book, 'pub/text/' || doc_id || '.xhtml' AS path, sha256(content) AS sha, true AS utf8 FROM xh UNION ALL SELECT book, 'mimetype', sha256('application/epub+zip'), true FROM bk")
def container_members(spark: SparkSession, d: str) -> DataFrame:
    """Members inflated and verified, as text."""
    own = _library(spark, d).entries(content=True).where("path = 'mimetype' or path like 'pub/text/%'")
    return own.select("book", "path", F.sha2(text.decode_utf8(F.col("content")), 256).alias("sha"), text.decode_utf8(F.col("content")).isNotNull().alias("utf8"))


#: Damage by page_id: none, a cut tail, bytes behind, a checksum, a local header, an encrypted entry, two of
#: one name, a path that climbs out, a second disk, a size that lies.
_DAMAGES = 10


def _damaged(page_id: int, html: str) -> bytes:
    kind, out = page_id % _DAMAGES, io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = {6: ("a", "a"), 7: ("a", "../b")}.get(kind, ("a", "b"))
        for name in names:
            info = zipfile.ZipInfo("x")
            info.filename = name
            z.filelist, z.NameToInfo = z.filelist, {}
            z.writestr(info, (html or "") + "!", zipfile.ZIP_DEFLATED)
    raw = bytearray(out.getvalue())
    at = raw.find(b"PK\x01\x02")
    if kind == 1:
        return bytes(raw[:-9])
    if kind == 2:
        return bytes(raw) + b"behind"
    if kind == 3:
        raw[at + 16] ^= 1
    if kind == 4:
        raw[30] ^= 1
    if kind == 5:
        raw[at + 8] |= 1
    if kind == 8:
        raw[-18] = 1
    if kind == 9:
        raw[at + 24 : at + 28] = struct.pack("<L", 1 + struct.unpack_from("<L", raw, at + 24)[0])
    return bytes(raw)


@query("SELECT page_id, page_id % 10 AS damage, CASE WHEN page_id % 10 = 0 THEN 2 ELSE 0 END AS whole, CASE WHEN page_id % 10 > 0 THEN 'archive' END AS error FROM pages")
def container_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Damaged containers are refused, when they are opened or when the member is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_damaged(*row) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["book", "content"])

    damaged = table(spark, d, "pages").select("page_id", "html").mapInArrow(run, "book bigint, content binary")
    read = Library.of(damaged).entries(content=True)
    by = read.groupBy("book").agg(F.count_if(F.col("content").isNotNull()).alias("n"), F.min("error.kind").alias("error"))
    return by.select(F.col("book").alias("page_id"), (F.col("book") % _DAMAGES).alias("damage"), F.when(F.col("error").isNull(), F.col("n")).otherwise(0).cast("int").alias("whole"), "error")


@query(f"WITH {_CH} SELECT book, type, n FROM (SELECT book, 'application/xhtml+xml' AS type, n + 1 AS n FROM bk UNION ALL SELECT book, 'image/jpeg', 1 FROM bk UNION ALL SELECT book, 'application/xml', 2 FROM bk UNION ALL SELECT book, 'application/oebps-package+xml', 1 FROM bk UNION ALL SELECT book, NULL, 2 FROM bk)")
def entry_types(spark: SparkSession, d: str) -> DataFrame:
    """Entries by what their names say that they are."""
    return _library(spark, d).entries().groupBy("book", media.by_extension(F.col("path")).alias("type")).agg(F.count("*").alias("n"))


@query("SELECT page_id, substr(url, 4, 6) AS part, false AS beyond FROM pages")
def asset_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of assets in memory by half-open ranges; one that leaves the asset is told beforehand."""
    p = table(spark, d, "pages").select("page_id", F.col("url").cast("binary").alias("c"))
    n = F.octet_length("c")
    return p.select("page_id", values.slice_bytes(F.col("c"), F.lit(3), F.lit(9)).cast("string").alias("part"), (values.checked_range(n, n - 3, n + 1) | ~values.checked_range(n, F.lit(0), n)).alias("beyond"))


@query(f"""WITH {_CH}, {_XHTML}
SELECT book, 'pub/text/' || doc_id || '.xhtml?q#l0' AS href, 'application/xhtml+xml' AS media_type, sha256(content) AS sha, NULL AS error FROM xh
UNION ALL SELECT book, 'pub/face.otf', 'font/otf', sha256(substr(repeat(sha256(book), 22), 1, 1400)), NULL FROM bk UNION ALL SELECT book, 'pub/gone.css', 'text/css', NULL, 'archive' FROM bk UNION ALL SELECT book, 'nowhere', NULL, NULL, 'resource' FROM bk""")
def library_resources(spark: SparkSession, d: str) -> DataFrame:
    """Members by manifest href: query and fragment don't count, a font comes in clear, errors are rows."""
    lib = _library(spark, d)
    rows = B.chapters(spark, d)
    asked = rows.select("book", F.concat(F.lit("pub/text/"), F.col("doc_id").cast("string"), F.lit(".xhtml?q#l0")).alias("href"))
    more = rows.select("book", F.explode(F.array(*map(F.lit, ("pub/face.otf", "pub/gone.css", "nowhere")))).alias("href")).distinct()
    return lib.resources(asked.union(more)).select("book", "href", "media_type", F.sha2("content", 256).alias("sha"), F.col("error.kind").alias("error"))


@query(f"WITH {_CH}, {_XHTML} SELECT book, doc_id, substr(content, 7, 20) AS part FROM xh")
def library_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of deflated members."""
    asked = B.chapters(spark, d).select("book", F.concat(F.lit("pub/text/"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("href"))
    found = _library(spark, d).resources(asked, 6, 26)
    return found.select("book", F.regexp_extract("href", "([0-9]+)[.]", 1).cast("bigint").alias("doc_id"), F.col("content").cast("string").alias("part"))


@query(f"WITH {_CH} SELECT book, substr(repeat(sha256(book), 22), 1031, 20) AS part FROM bk")
def font_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range across the end of a font's obfuscated part."""
    asked = B.chapters(spark, d).select("book", F.lit("pub/face.otf").alias("href")).distinct()
    return _library(spark, d).resources(asked, 1030, 1050).select("book", F.col("content").cast("string").alias("part"))


# --- packages ------------------------------------------------------------------------------------


@query(f"""WITH {_CH} SELECT book, 'Book ' || book AS title, 'Part ' || number AS subtitle, lang AS language, CAST(100 + n AS BIGINT) AS pages, CAST((n * 60 + 30) * 1000000 AS BIGINT) AS duration_us,
make_timestamp(2000 + n, 5, 1, 0, 0, 0) AS published, make_timestamp(2020, 1, n, 0, 0, 0) AS modified, CASE WHEN CAST(number AS BIGINT) % 2 = 1 THEN 'rtl' ELSE 'ltr' END AS direction, 'reflowable' AS layout, true AS keyed FROM bk""")
def package_metadata(spark: SparkSession, d: str) -> DataFrame:
    keyed = (F.col("identifier") == F.col("metadata_identifier")) & F.startswith("identifier", F.lit("urn:uuid:"))
    m = _library(spark, d).books.select("book", "identifier", F.col("metadata.identifier").alias("metadata_identifier"), F.col("metadata").alias("m"))
    return m.select("book", "m.title", "m.subtitle", F.element_at("m.languages", 1).alias("language"), "m.pages", "m.duration_us", "m.published", "m.modified", F.col("m.reading_progression").alias("direction"), "m.layout", keyed.alias("keyed"))


@query(f"WITH {_CH} SELECT book, 'Ann ' || source AS authors, 'Ed ' || source || '|Tr ' || source AS others, 'edt|trl' AS roles, 'House ' || source AS publisher, lang AS subject FROM bk")
def package_people(spark: SparkSession, d: str) -> DataFrame:
    m = _library(spark, d).metadata()
    return m.select("book", F.array_join("authors.name", "|").alias("authors"), F.array_join("contributors.name", "|").alias("others"), F.array_join(F.flatten("contributors.roles"), "|").alias("roles"), F.element_at("publishers.name", 1).alias("publisher"), F.element_at("subjects.name", 1).alias("subject"))


@query(f"WITH {_CH} SELECT book, 'Ann ' || source AS name, 'aut' AS role FROM bk UNION ALL SELECT book, 'Ed ' || source, 'edt' FROM bk UNION ALL SELECT book, 'Tr ' || source, 'trl' FROM bk")
def package_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles again from the raw records: people by what refines them, and the views by role."""
    raw = _library(spark, d).metadata().select("book", F.posexplode("raw").alias("ord", "r")).select("book", "ord", "r.name", "r.value", "r.id", "r.refines", "r.property")
    people = raw.where("name in ('creator', 'contributor')").select("book", "id", "ord", F.col("value").alias("name"), F.when(F.col("name") == "creator", "aut").otherwise("ctb").alias("default_role"))
    roles = metadata.with_roles(people, raw, metadata.META + "role")
    views = [metadata.by_role(roles, r).select("book", "name", F.lit(r).alias("role")) for r in ("aut", "edt", "trl")]
    return views[0].union(views[1]).union(views[2])


@query(f"WITH {_CH} SELECT book, source AS name, 'series' AS type, CAST(number AS DOUBLE) AS position FROM bk")
def package_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of the parsed package, and the same from its records."""
    lib = _library(spark, d)
    told = lib.metadata().select("book", F.explode("belongs_to").alias("b")).select("book", "b.name", "b.type", "b.position")
    raw = lib.metadata().select("book", F.posexplode("raw").alias("ord", "r")).select("book", "ord", "r.value", "r.id", "r.refines", "r.property")
    again = metadata.series(raw, spark.createDataFrame([], "book string, name string, position string"))
    return told.intersect(again.select("book", "name", "type", "position"))


@query(f"""WITH {_CH} SELECT book, 'http://own.example/note' AS property, 'note ' || number AS value FROM bk UNION ALL SELECT book, 'schema:accessMode', 'textual' FROM bk
UNION ALL SELECT book, 'schema:numberOfPages', CAST(100 + n AS VARCHAR) FROM bk UNION ALL SELECT book, 'accessMode', 'textual|visual' FROM bk""")
def package_properties(spark: SparkSession, d: str) -> DataFrame:
    """First values under canonical names, declared prefixes written out, and all values of accessibility."""
    m = _library(spark, d).metadata()
    first = m.select("book", F.explode("properties").alias("property", "value")).where("property in ('http://own.example/note', 'schema:accessMode', 'schema:numberOfPages')")
    return first.union(m.select("book", F.explode("accessibility").alias("property", "v")).select("book", "property", F.array_join("v", "|")))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'http://own.example/k' || event_id WHEN 1 THEN 'http://idpf.org/epub/vocab/package/meta/#k' || event_id WHEN 2 THEN 'http://purl.org/dc/terms/k' || event_id WHEN 3 THEN 'http://schema.org/k' || event_id ELSE 'none:k' || event_id END AS full_name,
CASE event_id % 5 WHEN 0 THEN 'http://own.example/k' || event_id WHEN 1 THEN 'k' || event_id WHEN 2 THEN 'dcterms:k' || event_id WHEN 3 THEN 'schema:k' || event_id ELSE 'none:k' || event_id END AS canonical FROM events""")
def property_names(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes: declared, none, reserved and unknown; written out, and as short as they go."""
    k = F.concat(F.lit("k"), F.col("event_id").cast("string"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("own:", "", "dcterms:", "schema:", "none:"))), (F.col("event_id") % 5 + 1).cast("int")), k)
    e = table(spark, d, "events").select("event_id", metadata.expand(name, metadata.prefix_map(F.lit("own: http://own.example/ x: y"))).alias("full_name"))
    return e.select("event_id", "full_name", metadata.canonical(F.col("full_name")).alias("canonical"))


@query(f"""WITH {_CH} SELECT book, 'c' || doc_id AS item_id, 'pub/text/' || doc_id || '.xhtml' AS path, 'application/xhtml+xml' AS media_type, NULL AS fallback, false AS external, CAST(idx + 1 AS INTEGER) AS ord, '' AS rels FROM ch
UNION ALL SELECT book, 'nav', 'pub/nav.xhtml', 'application/xhtml+xml', NULL, false, 0, 'contents' FROM bk UNION ALL SELECT book, 'art', 'pub/art.psd', 'image/x-psd', 'c' || first, false, CAST(n + 1 AS INTEGER), '' FROM bk
UNION ALL SELECT book, 'css', 'pub/gone.css', 'text/css', NULL, false, CAST(n + 2 AS INTEGER), '' FROM bk UNION ALL SELECT book, 'face', 'pub/face.otf', 'font/otf', NULL, false, CAST(n + 3 AS INTEGER), '' FROM bk
UNION ALL SELECT book, 'far', 'https://far.example/v.mp4', 'video/mp4', NULL, true, CAST(n + 4 AS INTEGER), '' FROM bk UNION ALL SELECT book, 'jpg', 'pub/a.jpg', 'image/jpeg', NULL, false, CAST(n + 5 AS INTEGER), '' FROM bk""")
def package_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).manifest.select("book", "item_id", "path", "media_type", "fallback", "external", "ord", F.array_join("rels", " ").alias("rels"))


@query(f"WITH {_CH} SELECT ch.book, CAST(idx AS INTEGER) AS pos, 'c' || doc_id AS idref, NOT (idx > 0 AND idx = n - 1) AS linear, '/6/' || (2 * (idx + 1)) || '[r' || doc_id || ']' AS cfi_path, CASE WHEN idx = 0 THEN 'left' END AS page, CASE WHEN idx > 0 AND idx = n - 1 THEN 'no' ELSE 'yes' END AS told FROM ch JOIN bk USING (book)")
def package_spine(spark: SparkSession, d: str) -> DataFrame:
    s = _library(spark, d).spine
    return s.select("book", "pos", "idref", "linear", "cfi_path", F.try_element_at("properties", F.lit("page")).alias("page"), F.try_element_at("properties", F.lit("linear")).alias("told"))


@query(f"""WITH {_CH} SELECT book, 'toc' AS kind, CAST(2 * idx AS INTEGER) AS ord, 1 AS depth, 'pub/text/' || doc_id || '.xhtml' AS href, 'Doc ' || doc_id AS title, NULL::INTEGER AS parent FROM ch
UNION ALL SELECT book, 'toc', CAST(2 * idx + 1 AS INTEGER), 2, 'pub/text/' || doc_id || '.xhtml#l0', 'Line 0 of ' || doc_id, CAST(2 * idx AS INTEGER) FROM ch
UNION ALL SELECT book, 'page-list', CAST(idx AS INTEGER), 1, 'pub/text/' || doc_id || '.xhtml', CAST(idx + 1 AS VARCHAR), NULL FROM ch UNION ALL SELECT book, 'landmarks', 0, 1, 'pub/text/' || first || '.xhtml', 'Start', NULL FROM bk""")
def package_nav(spark: SparkSession, d: str) -> DataFrame:
    """Contents with their nesting, the page list, and landmarks out of the guide."""
    return _library(spark, d).nav.select("book", "kind", "ord", "depth", "href", "title", "parent")


@query(f"WITH {_CH} SELECT book, 'preview' AS role, '0' AS path, 'pub/text/' || first || '.xhtml' AS href FROM bk UNION ALL SELECT book, 'record', '', 'pub/meta.xml' FROM bk UNION ALL SELECT book, 'self', '', 'pub/book.opf' FROM bk")
def package_links(spark: SparkSession, d: str) -> DataFrame:
    """Collections, metadata links and the package itself."""
    lib = _library(spark, d)
    c = lib.collections.select("book", "role", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), F.explode("links").alias("l")).select("book", "role", "path", "l.href")
    return c.union(lib.books.select("book", F.explode("links").alias("l")).select("book", F.element_at("l.rels", 1), F.lit(""), "l.href"))


@query(f"WITH {_CH} SELECT book, 'resource-missing' AS code, 2::BIGINT AS n FROM bk UNION ALL SELECT book, 'media-type-normalized', 1 FROM bk")
def package_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).warnings.groupBy("book", "code").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS book, CASE o_orderkey % 4 WHEN 0 THEN 'metadata-missing-title' WHEN 1 THEN 'metadata-missing-identifier' WHEN 2 THEN 'metadata-missing-language' END AS code FROM orders WHERE o_orderkey % 4 < 3")
def missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Orders as books, of which one in four lacks a title, an identifier or a language."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("book"), F.when(k % 4 != 0, F.lit("t")).alias("title"), F.when(k % 4 != 1, F.lit("i")).alias("identifier"), F.when(k % 4 != 2, F.array(F.lit("en"))).alias("languages"))
    return metadata.missing_warnings(o)


@query(f"WITH {_CH} SELECT book, 'Book ' || book AS title, lang AS language, 'Ann ' || source AS author, '2020-01-' || lpad(CAST(n AS VARCHAR), 2, '0') AS modified, false AS empty FROM bk")
def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of every book's metadata, read back."""
    j = _library(spark, d).metadata_json()
    part = lambda path: F.get_json_object("json", path)
    return j.select("book", part("$.title").alias("title"), part("$.languages[0]").alias("language"), part("$.authors[0].name").alias("author"), F.substring(part("$.modified"), 1, 10).alias("modified"), F.contains("json", F.lit("null")).alias("empty"))


_OPF = '<package xmlns="http://www.idpf.org/2007/opf" version="{version}" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">k{i}</dc:identifier><dc:title>T{i}</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine toc="x">{spine}</spine>{guide}</package>'
_PAGE = '<item id="p" href="p.xhtml" media-type="application/xhtml+xml"/>'
_REFERENCE = '<itemref idref="p"/>'


def _small(i: int, kind: int) -> bytes:
    """A book of one page; what `kind` names is wrong with it, or, in kind 0, nothing: it has an NCX."""
    ncx = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> Way  {i} </text></navLabel><content src="p.xhtml#a"/><navPoint><navLabel><text>In</text></navLabel><content src="p.xhtml"/></navPoint></navPoint></navMap></ncx>'
    items = {2: _PAGE + _PAGE, 3: _PAGE + '<item id="q" href="p.xhtml" media-type="x/y"/>', 5: _PAGE + '<item id="a" href="a" media-type="x/y" fallback="b"/><item id="b" href="b" media-type="x/y" fallback="a"/>', 6: _PAGE + '<item id="a" href="a" media-type="x/y" fallback="zz"/>', 7: '<item id="p" href="file:///p" media-type="x/y"/>', 9: _PAGE + '<item id="q" href="a%2Fb" media-type="x/y"/>'}.get(kind, _PAGE)
    spine = {1: '<itemref idref="zz"/>', 4: '<itemref idref="p" linear="no"/>'}.get(kind, _REFERENCE)
    whole = _OPF.format(i=i, version="2.0", items=items + '<item id="x" href="t.ncx" media-type="application/x-dtbncx+xml"/>', spine=spine, guide="")
    if kind == 8:
        whole = '<!DOCTYPE package [<!ENTITY a "b">]>' + whole
    if kind == 10:
        whole = whole[:-10]
    files = {"META-INF/container.xml": B._CONTAINER, "pub/book.opf": whole, "pub/p.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><body><p id="a">x</p></body></html>', "pub/t.ncx": ncx}
    if kind == 11:
        del files["META-INF/container.xml"]
    return B.pack({k: v.encode() for k, v in files.items()})


def _small_books(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_small(i, i % 12) for i in batch.column(0).to_pylist()], pa.binary())], names=["book", "content"])

    return table(spark, d, "pages").select("page_id").mapInArrow(run, "book bigint, content binary")


@query("SELECT page_id AS book, CASE page_id % 12 WHEN 0 THEN NULL WHEN 7 THEN 'security' WHEN 8 THEN 'security' WHEN 9 THEN 'security' WHEN 10 THEN 'package' WHEN 11 THEN 'package' ELSE 'package' END AS error FROM pages")
def package_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Books with one thing wrong: a missing or repeated item, fallbacks that circle or lead nowhere, no
    linear order, unsafe references, entities, broken XML, no container file."""
    return Library.of(_small_books(spark, d)).books.select("book", F.col("error.kind").alias("error"))


@query("SELECT page_id AS book, 0 AS ord, 1 AS depth, 'Way ' || page_id AS title, 'pub/p.xhtml#a' AS href FROM pages WHERE page_id % 12 = 0 UNION ALL SELECT page_id, 1, 2, 'In', 'pub/p.xhtml' FROM pages WHERE page_id % 12 = 0")
def ncx_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents of books of version 2."""
    return Library.of(_small_books(spark, d)).nav.where("kind = 'toc'").select("book", "ord", "depth", "title", "href")


@query("""SELECT CASE page_id % 12 WHEN 0 THEN CASE WHEN page_id % 24 = 0 THEN 'failed' ELSE 'passed' END WHEN 7 THEN 'refused:security' WHEN 8 THEN 'refused:security' WHEN 9 THEN 'refused:security' ELSE 'refused:package' END AS outcome,
count(*) AS n, CAST(count(*) FILTER (WHERE page_id % 12 = 0) AS BIGINT) AS positions FROM pages GROUP BY outcome""")
def conformance_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A bulk run over books, half of the sound ones with an expectation that they don't meet."""
    p = table(spark, d, "pages").where("page_id % 12 = 0").select(F.col("page_id").alias("book"))
    want = p.select("book", F.lit("title").alias("check"), F.when(F.col("book") % 24 == 0, F.lit("other")).otherwise(F.concat(F.lit("T"), F.col("book").cast("string"))).alias("want"))
    out = conformance.run(Library.of(_small_books(spark, d)), want.union(p.select("book", F.lit("toc"), F.lit("2"))))
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("positions"), F.lit(0)).cast("bigint").alias("positions"))


@query(f"""WITH {_CH}, o AS (SELECT book, string_agg('pub/text/' || doc_id || '.xhtml', ' ' ORDER BY idx) FILTER (WHERE NOT (idx > 0 AND idx = n - 1)) AS ord, string_agg('Doc ' || doc_id || '|Line 0 of ' || doc_id, '|' ORDER BY idx) AS toc FROM ch JOIN bk USING (book) GROUP BY book),
facts AS (SELECT book, unnest([('title', 'Book ' || book), ('language', lang), ('layout', 'reflowable'), ('direction', CASE WHEN CAST(number AS BIGINT) % 2 = 1 THEN 'rtl' ELSE 'ltr' END), ('spine', CAST(n AS VARCHAR)),
('linear', CAST(CASE WHEN n > 1 THEN n - 1 ELSE 1 END AS VARCHAR)), ('manifest', CAST(n + 6 AS VARCHAR)), ('toc', CAST(2 * n AS VARCHAR)), ('landmarks', '1'), ('pages', CAST(n AS VARCHAR)), ('missing', '2'), ('encrypted', '1'), ('warnings', 'media-type-normalized,resource-missing'), ('authors', 'Ann ' || source),
('package', 'pub/book.opf'), ('subtitle', 'Part ' || number), ('languages', lang), ('order', ord), ('first', 'pub/text/' || first || '.xhtml'), ('repeated', '0'), ('contributors', 'Ed ' || source || ', Tr ' || source), ('author_directions', 'none'), ('toc_titles', toc), ('published', CAST(2000 + n AS VARCHAR) || '-05-01'),
('modified', '2020-01-' || lpad(CAST(n AS VARCHAR), 2, '0')), ('duration', CAST(n * 60 + 30 AS VARCHAR)), ('cover', NULL), ('collections', 'preview'), ('links', 'self, record'), ('external', '1'), ('fonts', 'pub/face.otf'), ('fallbacks', '1')]) AS f FROM bk JOIN o USING (book))
SELECT book, f[1] AS "check", f[2] AS value FROM facts""")
def conformance_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every keyed fact but the identifier, which is a hash."""
    return conformance.checks(_library(spark, d)).where("check <> 'identifier'")


@query(f"""WITH {_CH}, t AS (SELECT ch.* FROM ch JOIN bk USING (book) WHERE NOT (idx > 0 AND idx = n - 1)), f AS (SELECT book, idx, unnest([('active', 'false'), ('file_urls', '0'), ('columns', 'true'), ('images', '0'), ('error', NULL)]) AS f FROM t)
SELECT book, CAST(idx AS BIGINT) AS idx, f[1] AS "check", f[2] AS value FROM f""")
def shown_documents(spark: SparkSession, d: str) -> DataFrame:
    """What a reader shows of every document of the reading order."""
    return conformance.document_checks(_library(spark, d))


@query("""WITH c AS (SELECT *, event_id % 6 AS k, 'd' || (event_id % 3) || '/e/x' || event_id || '.html' AS document FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'd' || (event_id % 3) || '/y.css' WHEN 1 THEN 'y.css' WHEN 2 THEN 'y.css' WHEN 3 THEN 'd' || (event_id % 3) || '/e/base/y%20z.css#f' WHEN 4 THEN 'http://h.example/y' END AS href,
CASE k WHEN 1 THEN 'url-path-absolute' WHEN 2 THEN 'url-leaks-container' END AS warning, CASE k WHEN 5 THEN 'security' END AS error FROM c""")
def references_in_container(spark: SparkSession, d: str) -> DataFrame:
    """References of documents at the container's root: up a folder, absolute, out of it, below a base,
    remote, and unsafe."""
    e, k = table(spark, d, "events"), (F.col("event_id") % 6 + 1).cast("int")
    reference = F.element_at(F.array(*map(F.lit, ("../y.css", "/y.css", "../../../y.css", "y z.css#f", "http://h.example/y", "javascript:x"))), k)
    document = F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"), F.lit("/e/x"), F.col("event_id").cast("string"), F.lit(".html"))
    bases = F.when(k == 4, F.array(F.lit("base/"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", uri.in_container(reference, document, bases).alias("r")).select("event_id", "r.href", "r.warning", "r.error")


# --- reading text --------------------------------------------------------------------------------


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return B.chapters(spark, d).withColumn("path", F.col("doc_id").cast("string")).withColumn("media_type", F.lit("application/xhtml+xml")).drop("text")


@query(f"WITH {_CH}, {_BLOCKS} SELECT whole.doc_id, sha256(whole.text) AS sha, len AS len16, 'Doc ' || whole.doc_id AS title, nullif(lang, '') AS language FROM whole JOIN ch USING (doc_id)")
def chapter_texts(spark: SparkSession, d: str) -> DataFrame:
    """Reading text of every chapter, out of its container."""
    linear = extraction.extract(_library(spark, d).documents().drop("error"), keep=["book", "idx", "href"])
    rest = _library(spark, d).entries(content=True).where("path like 'pub/text/%'").select("book", F.col("path").alias("href"), "content", F.lit("application/xhtml+xml").alias("media_type"), "path")
    rest = extraction.extract(rest.join(linear.select("book", "href"), ["book", "href"], "left_anti"), keep=["book", "href"])
    both = linear.drop("idx").unionByName(rest)
    return both.select(F.regexp_extract("href", "([0-9]+)[.]xhtml$", 1).cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("sha"), "len16", "title", F.nullif("language", F.lit("")).alias("language"))


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, CAST(block AS INTEGER) AS block, start, CAST(start + len AS INTEGER) AS \"end\", CASE WHEN line < 0 THEN 'heading' ELSE 'paragraph' END AS kind, sha256(text) AS sha FROM blocks")
def chapter_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = extraction.blocks(extraction.extract(_chapters(spark, d), keep=["doc_id"]), ["doc_id"])
    return b.select("doc_id", "block", "start", "end", "kind", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_CH}, {_BLOCKS}, m AS (SELECT doc_id, len // 2 AS middle FROM whole) SELECT doc_id, CAST(middle AS INTEGER) AS \"offset\", CAST(min(block) FILTER (WHERE middle < start + len OR (middle = start + len AND middle = (SELECT max(len) FROM whole w WHERE w.doc_id = m.doc_id))) AS INTEGER) AS block FROM m JOIN blocks USING (doc_id) GROUP BY ALL")
def chapter_block_at(spark: SparkSession, d: str) -> DataFrame:
    """The block in the middle of every chapter."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"])
    points = x.select("doc_id", F.floor(F.col("len16") / 2).cast("int").alias("offset"))
    return extraction.block_at(points, extraction.blocks(x, ["doc_id"]), ["doc_id"])


@query(f"WITH {_CH}, {_BLOCKS}, every AS (SELECT l.doc_id, l.line, (SELECT min(b.start) FROM blocks b WHERE b.doc_id = l.doc_id AND b.line >= l.line) AS start FROM lines l WHERE l.line >= 0) SELECT doc_id, count(*) AS n, CAST(count(*) FILTER (WHERE start IS NOT NULL) AS BIGINT) AS followed, CAST(sum(start) AS BIGINT) AS sum FROM every GROUP BY doc_id")
def chapter_ids(spark: SparkSession, d: str) -> DataFrame:
    """Where the ids of the paragraphs are: at their text, or where the next text starts."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", "len16", F.explode("ids").alias("id", "offset"))
    b = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", F.transform("blocks", lambda b: b["start"]).alias("starts"))
    x = x.join(b, "doc_id").withColumn("at", F.array_contains("starts", F.col("offset")))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("at").alias("followed"), F.sum(F.when(F.col("at"), F.col("offset"))).alias("sum"))


@query("SELECT doc_id, nullif(substr(text, 11, 10), '') AS before, nullif(substr(text, 21, 5), '') AS highlight, nullif(substr(text, 26, 10), '') AS after, '…' || replace(substr(text, 11, 10) || substr(text, 21, 5) || substr(text, 26, 10), chr(10), ' ') || '…' AS snippet FROM documents")
def text_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Text around a place, and in one line."""
    a = table(spark, d, "documents").select("doc_id", text.around(F.col("text"), F.lit(20), F.lit(25), 10).alias("a")).select("doc_id", "a.*")
    return a.withColumn("snippet", text.snippet(F.col("before"), F.col("highlight"), F.col("after")))


def _markup(spark: SparkSession, d: str, content: Column, media_type: str = "application/xhtml+xml") -> DataFrame:
    return T.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", content.alias("content"), F.lit(media_type).alias("media_type"), F.col("doc_id").cast("string").alias("path"))


_ID = "CAST(doc_id AS VARCHAR)"


@query(f"""SELECT doc_id, 'H' || {_ID} || chr(10) || 'deep' || chr(10) || 'item' || chr(10) || '漢 ' || {_ID} || chr(10) || 'a' || chr(10) || '  b' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'end' AS text,
'heading ' || (doc_id % 6 + 1) || ' 0 0,paragraph 0 ' || (1 + doc_id % 2) || ',listItem ' || (1 + doc_id % 3) || ' 0,paragraph 0 0,preformatted 0 0,paragraph 0 0,heading 3 0 0' AS kinds FROM documents""")
def element_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Headings, quotes, lists, ruby, kept white space, breaks, and what is never read."""
    n, i = F.col("doc_id").cast("string"), F.col("doc_id")
    h = (i % 6 + 1).cast("string")
    quotes, lists = (i % 2 + 1).cast("int"), (i % 3 + 1).cast("int")
    content = F.concat(
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>no</title><style>no</style></head><body><h'), h, F.lit(">H"), n, F.lit("</h"), h, F.lit('><p hidden="">no</p><script>no()</script>'),
        F.repeat(F.lit("<blockquote>"), quotes), F.lit("<p>deep</p>"), F.repeat(F.lit("</blockquote>"), quotes), F.repeat(F.lit("<ul><li>"), lists), F.lit("item"), F.repeat(F.lit("</li></ul>"), lists),
        F.lit("<p><ruby>漢<rt>no</rt></ruby> \n "), n, F.lit("</p><pre>a\n  b</pre><p>one<br/>two</p><div role=\"heading\" aria-level=\"3\">end</div></body></html>"),
    )
    x = extraction.extract(_markup(spark, d, content), keep=["doc_id"])
    kind = lambda b: F.concat_ws(" ", b["kind"], b["heading_level"].cast("string"), b["list_depth"].cast("string"), b["quote_depth"].cast("string"))
    return x.select("doc_id", "text", F.array_join(F.transform("blocks", kind), ",").alias("kinds"))


_LINE = "trim(regexp_replace(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[\\x00-\\x08\\x0b-\\x1f\\x{fffe}\\x{ffff}]', '', 'g'), '[ \\t]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL ELSE trim({_LINE} || chr(10) || 'x y', chr(10)) END AS text, CASE doc_id % 5 WHEN 4 THEN 'content' END AS error FROM documents")
def decoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document in UTF-8, with a mark, in UTF-16 of either order, and in bytes that
    are no UTF-8; line ends of all kinds."""
    line = F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), B.UNSPEAKABLE, "")
    plain = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><body><p>'), text.escape_html(line), F.lit("</p><p>x\r\ny</p></body></html>"))
    k = F.col("doc_id") % 5
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode(plain, "UTF-16LE"))
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode(plain, "UTF-16BE"))
    content = F.when(k == 0, F.encode(plain, "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(plain, "UTF-8"))).when(k == 2, little).when(k == 3, big).otherwise(F.concat(F.encode(plain, "UTF-8"), F.unhex(F.lit("FF"))))
    return extraction.extract(_markup(spark, d, content), keep=["doc_id"]).select("doc_id", "text", F.col("error.kind").alias("error"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'content' WHEN 2 THEN 'content' WHEN 3 THEN 'content' WHEN 4 THEN 'content' ELSE NULL END AS error, doc_id % 6 IN (0, 5) AS readable FROM documents")
def refused_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with entities, too deep, not well-formed or cut short; HTML takes what XML refuses."""
    k = F.col("doc_id") % 6
    content = F.when(k == 0, "<html xmlns='http://www.w3.org/1999/xhtml'><body>x</body></html>").when(k == 1, '<!DOCTYPE html [<!ENTITY a "b">]><html><body>&a;</body></html>').when(k == 2, F.concat(F.repeat(F.lit("<a>"), 400), F.repeat(F.lit("</a>"), 400))).when(k == 3, "<html><p>a<b></p></html>").when(k == 4, "<html><p>a").otherwise("<p>a<b></p>")
    rows = _markup(spark, d, content).withColumn("media_type", F.when(k == 5, "text/html").otherwise("application/xhtml+xml"))
    return extraction.extract(rows, keep=["doc_id"]).select("doc_id", F.col("error.kind").alias("error"), F.col("text").isNotNull().alias("readable"))


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, sha256(text) AS sha, len AS len16 FROM whole")
def html_documents(spark: SparkSession, d: str) -> DataFrame:
    """The chapters as HTML whose paragraphs are never closed, with void elements and character references."""
    rows = B.chapters(spark, d)
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), text.escape_html(x)))
    content = F.concat(F.lit("<!DOCTYPE html><title>t</title><h1>Doc&#32;"), F.col("doc_id").cast("string"), F.lit("</h1><hr>"), F.array_join(lines, ""))
    x = extraction.extract(rows.select("doc_id", content.alias("content"), F.lit("text/html").alias("media_type"), F.lit("a.html").alias("path")), keep=["doc_id"])
    return x.select("doc_id", F.sha2("text", 256).alias("sha"), "len16")


# --- CFIs ----------------------------------------------------------------------------------------


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, start AS \"offset\", {_STEP} || '/1:' || lead AS cfi FROM blocks")
def cfi_points(spark: SparkSession, d: str) -> DataFrame:
    """The CFI of the first character of every block."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", F.transform("blocks", lambda b: b["start"]).alias("offsets"))
    return extraction.cfis_at(_chapters(spark, d).join(x, "doc_id"), "offsets", keep=["doc_id"])


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, start, CAST(start + 1 AS INTEGER) AS \"end\", {_STEP} || '/1,:' || lead || ',:' || (lead + 1) AS cfi FROM blocks WHERE len > 1")
def cfi_spans(spark: SparkSession, d: str) -> DataFrame:
    """The CFI of the first unit of every block as a range."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", F.transform(F.filter("blocks", lambda b: b["end"] - b["start"] > 1), lambda b: F.struct(b["start"].alias("start"), (b["start"] + 1).alias("end"))).alias("spans"))
    return extraction.cfis_for(_chapters(spark, d).join(x, "doc_id"), "spans", keep=["doc_id"])


@query(f"""WITH {_CH}, {_BLOCKS}, b AS (SELECT * FROM blocks WHERE line >= 0 AND len >= 3)
SELECT doc_id, block, 'plain' AS kind, start, 'exact' AS match FROM b UNION ALL SELECT doc_id, block, 'moved', start, 'corrected' FROM b UNION ALL SELECT doc_id, block, 'far', CAST(start + len AS INTEGER), 'approximate' FROM b
UNION ALL SELECT doc_id, block, 'gone', NULL, NULL FROM b UNION ALL SELECT doc_id, block, 'range', start, 'exact' FROM b""")
def cfi_resolution(spark: SparkSession, d: str) -> DataFrame:
    """CFIs of paragraphs: as they are, with steps that have moved but ids that hold, past the text's end,
    to an element that is not there, and as a range."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", F.posexplode("blocks").alias("block", "b"), "ids")
    raw = B.chapters(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    name = F.concat(F.lit("l"), F.col("line").cast("string"))
    lead = text.len16(F.col("raw")) - text.len16(F.regexp_replace("raw", "^[ \t\r\f]+", ""))
    lines = raw.where(F.trim(F.regexp_replace("raw", "[ \t\r\f]+", " ")) != "").select("doc_id", name.alias("name"), "line", lead.alias("lead"))
    b = x.select("doc_id", "block", "b.start", "b.end", F.explode("ids").alias("name", "at")).where("at = start").join(lines, ["doc_id", "name"]).where("end - start >= 3")
    step, tail = F.concat(F.lit("/4/"), (2 * (F.col("line") + 2)).cast("string"), F.lit("["), "name", F.lit("]/1")), F.concat(F.lit(":"), F.col("lead").cast("string"))
    forms = {"plain": F.concat(step, tail), "moved": F.concat(F.lit("/4/2["), "name", F.lit("]/1"), tail), "far": F.concat(step, F.lit(":99999999")), "gone": F.concat(F.lit("/4/99999990/1"), tail), "range": F.concat(step, F.lit(","), tail, F.lit(",:"), (F.col("lead") + 2).cast("string"))}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("cfi")) for k, c in forms.items()])
    asked = b.select("doc_id", "block", F.explode(kinds).alias("k")).select("doc_id", "block", "k.kind", "k.cfi")
    grouped = asked.select("doc_id", "cfi").distinct().groupBy("doc_id").agg(F.collect_list("cfi").alias("cfis"))
    found = extraction.resolve_cfis(_chapters(spark, d).join(grouped, "doc_id"), "cfis", keep=["doc_id"])
    return asked.join(found, ["doc_id", "cfi"]).select("doc_id", F.col("block").cast("bigint").alias("block"), "kind", "start", "match")


@query("SELECT doc_id, k, CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 10 + 5 * (doc_id % 7) END AS INTEGER) AS start, CASE k WHEN 0 THEN 'corrected' WHEN 1 THEN 'corrected' ELSE NULL END AS match FROM documents, (VALUES (0), (1), (2)) t(k)")
def cfi_nearest_text(spark: SparkSession, d: str) -> DataFrame:
    """Text assertions that hold elsewhere: at the nearest of several places, the earlier of ties; nowhere."""
    n = (F.col("doc_id") % 7).cast("int")
    content = F.concat(F.lit("<html xmlns='http://www.w3.org/1999/xhtml'><body><p>.....abcde"), F.repeat(F.lit("abcde"), n), F.lit("..........</p></body></html>"))
    rows = _markup(spark, d, content).withColumn("cfis", F.array(F.lit("/2/2/1:0[bcde]"), F.concat(F.lit("/2/2/1:"), (20 + 5 * n).cast("string"), F.lit("[e]")), F.lit("/2/2/1:1[zz]")))
    found = extraction.resolve_cfis(rows, "cfis", keep=["doc_id"])
    k = F.when(F.contains("cfi", F.lit("bcde")), 0).when(F.contains("cfi", F.lit("zz")), 2).otherwise(1)
    return found.select("doc_id", k.alias("k"), "start", "match")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'epubcfi(/6/' || (2 * event_id) || '[a^]b^,]!/4/2/1:' || event_id || ')' WHEN 1 THEN 'epubcfi(/4/2~' || event_id || '.5@5.75:97.6)' WHEN 2 THEN 'epubcfi(/4/2/1:' || event_id || '[x,y;s=b])' WHEN 3 THEN 'epubcfi(/4,/2/1:1,/4/1:' || event_id || ')' END AS canonical,
event_id % 8 > 3 AS refused, CASE event_id % 8 WHEN 0 THEN '6,' || (2 * event_id) || ',4,2,1' WHEN 1 THEN '4,2' WHEN 2 THEN '4,2,1' WHEN 3 THEN '4,2,1' END AS steps FROM events""")
def cfi_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Steps, escapes, times and places, text with a side, ranges; and what the grammar refuses: leading
    zeros, steps behind an offset, three texts, open brackets."""
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 8
    source = (
        F.when(k == 0, F.concat(F.lit("epubcfi(/6/"), (2 * F.col("event_id")).cast("string"), F.lit("[a^]b^,]!/4/2/1:"), n, F.lit(")"))).when(k == 1, F.concat(F.lit("/4/2~"), n, F.lit(".5@5.75:97.6"))).when(k == 2, F.concat(F.lit("epubcfi(/4/2/1:"), n, F.lit("[x,y;s=b])")))
        .when(k == 3, F.concat(F.lit("/4,/2/1:1,/4/1:"), n)).when(k == 4, F.concat(F.lit("/4/0"), n)).when(k == 5, F.concat(F.lit("/4/1:"), n, F.lit("/2"))).when(k == 6, F.concat(F.lit("/4/1:2[a,b,"), n, F.lit("]"))).otherwise(F.concat(F.lit("epubcfi(/4[x"), n))
    )
    p = table(spark, d, "events").select("event_id", cfi.cfi_parse(source).alias("p"))
    return p.select("event_id", "p.canonical", F.col("p.error").isNotNull().alias("refused"), F.array_join(F.transform("p.steps", lambda s: s.cast("string")), ",").alias("steps"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY 2 * (event_id % 9), event_id % 4, event_id) AS rank FROM events")
def cfi_table_order(spark: SparkSession, d: str) -> DataFrame:
    """Points in the order of the text, numerically: step 10 comes after step 8."""
    from pyspark.sql import Window

    e = F.col("event_id")
    point = F.concat(F.lit("/4/"), (2 * (e % 9) + 2).cast("string"), F.lit("/1:"), (e % 4).cast("string"))
    p = table(spark, d, "events").select("event_id", "user_id", cfi.cfi_parse(point).alias("p"))
    return p.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*cfi.order(F.col("p")), "event_id")).cast("bigint").alias("rank"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = event_id % 7 THEN 'epubcfi(/4/' || (2 * (event_id % 5) + 2) || '/1,:1,:' || (2 + event_id % 3) || ')' ELSE 'epubcfi(/4,/' || (2 * (event_id % 5) + 2) || '/1:1,/' || (2 * (event_id % 7) + 2) || '/1:' || (2 + event_id % 3) || ')' END AS range,
event_id % 5 <= 3 AND event_id % 7 > 3 AS holds, '/6/' || (2 * event_id + 2) || '[r]' AS package, '/4/2/1:' || event_id AS content, 'epubcfi(/6/' || (2 * event_id + 2) || '[r]!/4/2/1:' || event_id || ')' AS whole, event_id % 2 = 0 AS same, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS bias FROM events WHERE event_id % 5 <= event_id % 7""")
def cfi_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Ranges between points, whether they hold another point, publication CFIs split and joined, equality
    whatever the writing, and the side of a point."""
    e = F.col("event_id")
    point = lambda step, at: F.concat(F.lit("/4/"), (2 * step + 2).cast("string"), F.lit("/1:"), at.cast("string"))
    package = F.concat(F.lit("/6/"), (2 * e + 2).cast("string"), F.lit("[r]"))
    content = F.concat(F.lit("/4/2/1:"), e.cast("string"))
    x = table(spark, d, "events").where("event_id % 5 <= event_id % 7").select("event_id", cfi.cfi_between(point(e % 5, F.lit(1)), point(e % 7, 2 + e % 3)).alias("range"), cfi.join_publication(package, content).alias("whole"))
    x = x.select("*", cfi.cfi_parse("range").alias("r"), cfi.cfi_parse(F.lit("/4/8/1:9")).alias("p"), cfi.cfi_split("whole").alias("s"), cfi.cfi_parse("whole").alias("a"), cfi.cfi_parse(F.when(e % 2 == 0, F.substring(F.col("whole"), F.lit(9), F.length("whole") - 9)).otherwise("/4/2")).alias("b"))
    x = x.select("*", cfi.cfi_assertions(F.when(e % 2 == 0, "/4/2/1:3[;s=b]").otherwise("/4/2/1:3[x;s=a]"))["bias"].alias("side"))
    return x.select("event_id", "range", cfi.contains(F.col("r"), F.col("p")).alias("holds"), "s.package", "s.content", "whole", (F.col("a.start_key") == F.col("b.start_key")).alias("same"), F.when(F.col("side").isin("b", "before"), "before").otherwise("after").alias("bias"))


# --- locators ------------------------------------------------------------------------------------


def _locators(spark: SparkSession, d: str) -> DataFrame:
    """JSON of a locator an event; what it leaves out, or has wrong, goes by the event's number."""
    e, k = F.col("event_id"), F.col("event_id") % 9
    wrong = {1: '"title":7,', 2: '"locations":[1],'}
    title = F.when(k == 1, F.lit('"title":7,')).otherwise(F.concat(F.lit('"title":"T'), e.cast("string"), F.lit('",')))
    locations = (
        F.when(k == 2, F.lit('"locations":[1]')).when(k == 3, F.lit('"locations":{"progression":1.5}')).when(k == 4, F.lit('"locations":{"position":0}')).when(k == 5, F.lit('"locations":{"fragments":[1]}'))
        .otherwise(F.concat(F.lit('"locations":{"fragments":["f'), e.cast("string"), F.lit('"],"progression":0.5,"position":'), (e + 1).cast("string"), F.lit(',"totalProgression":0.25,"partialCfi":"/4/'), (2 * e + 2).cast("string"), F.lit('","cssSelector":3,"other":{"a":[1]}}')))
    )
    head = F.when(k == 6, F.lit('"href":"a#b","type":"text/html",')).when(k == 7, F.lit('"type":"text/html",')).otherwise(F.concat(F.lit('"href":"x'), e.cast("string"), F.lit('.html","type":"text/html",')))
    words = F.when(k == 8, F.lit(',"text":{"highlight":1}')).otherwise(F.lit(',"text":{"before":"b","highlight":"h"}'))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("{"), head, title, locations, words, F.lit(',"unknown":1}')).alias("json"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'title' WHEN 2 THEN 'locations' WHEN 3 THEN 'progression' WHEN 4 THEN 'position' WHEN 5 THEN 'fragments' WHEN 8 THEN 'text' ELSE 'href or type' END AS error,
CASE WHEN event_id % 9 = 0 THEN 'x' || event_id || '.html' END AS href, CASE WHEN event_id % 9 = 0 THEN CAST(event_id + 1 AS INTEGER) END AS position, CASE WHEN event_id % 9 = 0 THEN '/4/' || (2 * event_id + 2) END AS partial_cfi, CAST(NULL AS VARCHAR) AS css_selector,
CASE WHEN event_id % 9 = 0 THEN 'f' || event_id END AS fragment, CASE WHEN event_id % 9 = 0 THEN 'h' END AS highlight FROM events""")
def locators_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Strict reading: the first wrong field refuses the whole; a number is not taken for a string."""
    l = _locators(spark, d).select("event_id", locator.from_json(F.col("json")).alias("l"))
    return l.select("event_id", "l.error", "l.href", "l.position", locator.partial_cfi(F.col("l.locations")).alias("partial_cfi"), locator.css_selector(F.col("l.locations")).alias("css_selector"), F.try_element_at("l.fragments", F.lit(1)).alias("fragment"), "l.highlight")


@query("""SELECT event_id, '{"href":"x' || event_id || '.html","type":"text/html","title":"' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'T' || event_id END || '","locations":{"fragments":["f' || event_id || '"],"progression":0.5,"position":' || (event_id + 1) || ',"totalProgression":0.25,"partialCfi":"/4/' || (2 * event_id + 2) || '"},"text":{"before":"b","highlight":"h"}}' AS json,
'{"href":"x","type":"text/html"}' AS bare, true AS nothing, false AS something FROM events WHERE event_id % 9 = 0""")
def locators_to_json(spark: SparkSession, d: str) -> DataFrame:
    """Written again after a change of the title; what is absent is left out, and told to be empty."""
    rows = _locators(spark, d).where("event_id % 9 = 0").select("event_id", locator.from_json(F.col("json")).alias("l"))
    rows = rows.withColumn("l", F.col("l").withField("partial_cfi", locator.partial_cfi(F.col("l.locations"))))
    changed = locator.copy_with(F.col("l"), title=F.when(F.col("event_id") % 2 == 0, F.lit("new")))
    none = {k: F.lit(None).cast(t) for k, t in (("title", "string"), ("fragments", "array<string>"), ("progression", "double"), ("position", "int"), ("total_progression", "double"), ("partial_cfi", "string"), ("before", "string"), ("highlight", "string"), ("after", "string"))}
    bare = F.struct(F.lit("x").alias("href"), F.lit("text/html").alias("type"), *[v.alias(k) for k, v in none.items()])
    return rows.select("event_id", locator.to_json(changed).alias("json"), locator.to_json(bare).alias("bare"), locator.is_empty(bare).alias("nothing"), locator.is_empty(F.col("l")).alias("something"))


@query("""SELECT event_id, 'a' || event_id || '.html' AS href, CASE WHEN event_id % 3 = 0 THEN 'application/octet-stream' ELSE 'text/html' END AS type, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'given' END AS title,
CASE WHEN event_id % 4 > 0 THEN 'p' || (event_id % 4) || ' é' END AS fragment, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE END AS progression, CAST(floor(event_id % 11 / 10.0 * 1001 + 0.5) AS INTEGER) AS "offset" FROM events""")
def locators_from_links(spark: SparkSession, d: str) -> DataFrame:
    """Locators of links without reading anything, and offsets of progressions."""
    e = F.col("event_id")
    href = F.concat(F.lit("a"), e.cast("string"), F.lit(".html"), F.when(e % 4 > 0, F.concat(F.lit("#p"), (e % 4).cast("string"), F.lit("%20%C3%A9"))).otherwise(""))
    l = locator.from_link(href, F.when(e % 3 != 0, F.lit("text/html")), F.when(e % 2 != 0, F.lit("given")), F.lit("own"))
    rows = table(spark, d, "events").select("event_id", l.alias("l"), locator.offset_at_progression((e % 11) / 10.0, F.lit(1001)).alias("offset"))
    return rows.select("event_id", "l.href", "l.type", "l.title", F.try_element_at("l.fragments", F.lit(1)).alias("fragment"), "l.progression", "offset")


# --- navigation ----------------------------------------------------------------------------------


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    rows = B.chapters(spark, d)
    part = lambda tail: F.concat(F.lit("pub/text/"), F.col("doc_id").cast("string"), F.lit(tail))
    return rows.select("book", "doc_id", F.explode(F.array(part(".xhtml#l%30"), part(".xhtml?x"), part(".gone"), F.lit("pub/art.psd"))).alias("href")).distinct()


@query(f"""WITH {_CH}, t AS (SELECT ch.*, NOT (idx > 0 AND idx = n - 1) AS linear FROM ch JOIN bk USING (book))
SELECT book, doc_id, 'pub/text/' || doc_id || '.xhtml#l%30' AS href, 'pub/text/' || doc_id || '.xhtml' AS path, 'l0' AS fragment, CASE WHEN linear THEN CAST(idx AS BIGINT) END AS idx FROM t
UNION ALL SELECT book, doc_id, 'pub/text/' || doc_id || '.xhtml?x', 'pub/text/' || doc_id || '.xhtml', NULL, CASE WHEN linear THEN CAST(idx AS BIGINT) END FROM t UNION ALL SELECT book, doc_id, 'pub/art.psd', 'pub/art.psd', NULL, NULL FROM t""")
def href_targets(spark: SparkSession, d: str) -> DataFrame:
    """Hrefs to resources: the reading order first, then what else the package holds; nothing for the rest."""
    lib = _library(spark, d)
    order = lib.reading_order.select("book", "idx", "href")
    found = publication.targets(_hrefs(spark, d), order, lib.manifest.where("not external").select("book", "href"))
    return found.select("book", "doc_id", "href", "path", "fragment", "idx")


@query(f"WITH {_CH} SELECT book, doc_id, k, CAST(CASE k WHEN 1 THEN CASE WHEN idx + 1 < n THEN idx + 1 END ELSE idx END AS INTEGER) AS pos FROM ch JOIN bk USING (book), (VALUES (0), (1), (2), (3)) t(k)")
def spine_steps(spark: SparkSession, d: str) -> DataFrame:
    """Spine items by CFI step: where the id agrees, the next step without one, by itemref and by item
    where the step disagrees."""
    spine = _library(spark, d).spine.select("book", "pos", (2 * (F.col("pos") + 1)).alias("step"), F.regexp_extract("cfi_path", r"\[(.*)\]", 1).alias("ref_id"), "idref")
    i = F.col("doc_id").cast("string")
    kinds = {0: (2 * (F.col("idx") + 1), F.concat(F.lit("r"), i)), 1: (2 * (F.col("idx") + 2), F.lit(None).cast("string")), 2: (F.lit(998).cast("bigint"), F.concat(F.lit("r"), i)), 3: (F.lit(998).cast("bigint"), F.concat(F.lit("c"), i))}
    asked = B.chapters(spark, d).select("book", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), s.cast("int").alias("step"), n.alias("id")) for k, (s, n) in kinds.items()])).alias("x")).select("book", "doc_id", "x.*")
    return publication.spine_item_of(asked, spine).select("book", "doc_id", "k", "pos")


@query(f"WITH {_CH}, {_BLOCKS}, t AS (SELECT ch.* FROM ch JOIN bk USING (book) WHERE NOT (idx > 0 AND idx = n - 1)) SELECT t.book, CAST(t.idx AS BIGINT) AS idx, whole.len AS \"offset\", 'Line 0 of ' || t.doc_id AS title FROM t JOIN whole USING (doc_id)")
def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """The contents entry in force at the end of every chapter, out of the container's own contents."""
    lib = _library(spark, d)
    order = lib.reading_order.select("book", "idx", "href")
    reach = publication.targets(lib.nav.select("book", "href").distinct(), order, order.where("false"))
    x = extraction.extract(lib.documents().drop("error"), keep=["book", "idx"])
    toc = titles.placed(titles.entries(lib.nav, reach), x.select("book", "idx", F.explode("ids").alias("id", "offset")))
    return titles.title_at(x.select("book", "idx", F.col("len16").alias("offset")), toc).select("book", "idx", "offset", "title")


@query(f"WITH {_CH} SELECT book, '<ol>' || string_agg('<li><a href=\"pub/text/' || doc_id || '.xhtml\">Doc ' || doc_id || '</a><ol><li><a href=\"pub/text/' || doc_id || '.xhtml#l0\">Line 0 of ' || doc_id || '</a></li></ol></li>', '' ORDER BY idx) || '</ol>' AS html FROM ch GROUP BY book")
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    return titles.outline(_library(spark, d).nav)


@query("SELECT page_id, k % 3 = 0 OR (k % 3 = 2 AND k % 2 = 0) AS fixed, k % 4 < 2 AS is_text, k % 4 < 3 AS shown, k % 4 <> 1 AS core FROM (SELECT page_id, page_id % 12 AS k FROM pages)")
def layout_and_types(spark: SparkSession, d: str) -> DataFrame:
    """Fixed layout by the item or else by the book; text, displayable and core media types."""
    k = F.col("page_id") % 12
    own = F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "reflowable")
    kind = F.element_at(F.array(*map(F.lit, ("application/xhtml+xml", "text/html", "image/png", "text/css"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", publication.is_fixed(own, F.when(k % 2 == 0, "fixed").otherwise("reflowable")).alias("fixed"), media.is_text(kind).alias("is_text"), media.is_displayable(kind).alias("shown"), media.is_core(kind).alias("core"))


# --- locations -----------------------------------------------------------------------------------


@query(f"""WITH {_CH}, {_BLOCKS}, b AS (SELECT blocks.*, whole.text AS whole, whole.len AS n FROM blocks JOIN whole USING (doc_id) WHERE blocks.len >= 4 AND blocks.text = regexp_replace(blocks.text, '[^\\x00-\\x{{FFFF}}]', '', 'g') AND whole.text = regexp_replace(whole.text, '[^\\x00-\\x{{FFFF}}]', '', 'g'))
SELECT doc_id, start, CAST(start + 4 AS INTEGER) AS \"end\", {_STEP} || '/1:' || lead AS partial_cfi, start / n AS progression, nullif(substr(whole, greatest(start - 40, 0) + 1, least(40, start)), '') AS before, substr(whole, start + 1, 4) AS highlight, nullif(substr(whole, start + 5, 40), '') AS after FROM b""")
def built_locators(spark: SparkSession, d: str) -> DataFrame:
    """Locators of the first four units of every block, in texts without astral characters."""
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).where(F.col("len16") == F.length("text")).select("doc_id", F.transform(F.filter("blocks", lambda b: b["end"] - b["start"] >= 4), lambda b: F.struct(b["start"].alias("start"), (b["start"] + 4).alias("end"))).alias("spans"))
    found = extraction.locators_for(_chapters(spark, d).join(x, "doc_id"), "spans", keep=["doc_id"])
    return found.select("doc_id", "start", "end", "partial_cfi", "progression", "before", "highlight", "after")


_MARKED = "coalesce(nullif(substr(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 1, 30), ''), 'none')"


@query(f"""WITH w AS (SELECT doc_id, {_MARKED} AS word, doc_id % 5 + 1 AS n FROM documents), x AS (SELECT *, length(word) + 2 AS step, 4 + n * (length(word) + 3) + 3 AS len FROM w)
SELECT doc_id, k, CASE k WHEN 0 THEN 'cfi' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'cfi' WHEN 4 THEN 'fragment' WHEN 5 THEN 'progression' WHEN 6 THEN 'position' ELSE 'start' END AS match,
CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 5 + (n - 1) * (length(word) + 3) WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 4 + n * (length(word) + 3) WHEN 5 THEN floor((4 + n * (length(word) + 3) + 3) * 0.5 + 0.5) WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS start FROM x, (SELECT unnest(range(8)) AS k)""")
def location_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Every rung of the ladder, in documents that say one word several times: a CFI that agrees, text
    near a progression, text near a stale CFI, a CFI whose text is gone, a fragment, a progression, a
    position, and nothing."""
    letters = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), 1, 30)
    word, n = F.coalesce(F.nullif(letters, F.lit("")), F.lit("none")), (F.col("doc_id") % 5 + 1).cast("int")
    rows = table(spark, d, "documents").select("doc_id", word.alias("word"), n.alias("n"))
    body = F.concat(F.lit("<html xmlns='http://www.w3.org/1999/xhtml'><body><p>top</p>"), F.repeat(F.concat(F.lit("<p>["), "word", F.lit("]</p>")), F.col("n")), F.lit("<p id='f'>end</p></body></html>"))
    cfi_ = F.lit("/2/4/1:1")
    none = {"fragments": "array<string>", "progression": "double", "position": "int", "offset_of_position": "int", "partial_cfi": "string", "before": "string", "highlight": "string", "after": "string"}

    def stored(**fields) -> Column:
        return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])

    ladder = [
        stored(partial_cfi=cfi_, highlight=F.col("word")), stored(progression=F.lit(1.0), highlight=F.col("word"), before=F.lit("[")), stored(partial_cfi=F.lit("/2/4/1:0"), highlight=F.col("word"), progression=F.lit(1.0)),
        stored(partial_cfi=cfi_, highlight=F.lit("###"), progression=F.lit(1.0)), stored(fragments=F.array(F.lit("zz"), F.lit("f")), progression=F.lit(0.5)), stored(progression=F.lit(0.5), offset_of_position=F.lit(1)), stored(offset_of_position=F.lit(1)), stored(),
    ]
    asked = rows.select("doc_id", body.alias("content"), F.lit("application/xhtml+xml").alias("media_type"), F.lit("a").alias("path"), F.array(*ladder).alias("stored"))
    out = extraction.resolve_locators(asked, "stored", keep=["doc_id"])
    return out.select("doc_id", F.col("n").cast("bigint").alias("k"), "match", "start")


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, start, {_STEP} || ',/1:' || lead || ',/1:' || (lead + 2) AS cfi, {_STEP} || '/1:' || lead AS partial_cfi, 'epubcfi(/6/2!' || {_STEP} || '/1:' || lead || ')' AS whole FROM blocks WHERE len >= 3 AND text = regexp_replace(text, '[^\\x00-\\x{{FFFF}}]', '', 'g')")
def locators_of_cfis(spark: SparkSession, d: str) -> DataFrame:
    """Locators for ranges, with the CFI of their start, inside a document and inside a publication."""
    spans = cfi_spans(spark, d)
    x = extraction.extract(_chapters(spark, d), keep=["doc_id"]).select("doc_id", F.explode("blocks").alias("b")).where("b.end - b.start >= 3").where(F.length("b.text") == text.len16(F.col("b.text"))).select("doc_id", F.col("b.start").alias("start"))
    known = spans.join(x, ["doc_id", "start"])
    lead = F.regexp_extract("cfi", ",:([0-9]+),", 1)
    parent = F.regexp_replace("cfi", "/1,:[0-9]+,:[0-9]+$", "")
    asked = known.select("doc_id", F.concat(parent, F.lit(",/1:"), lead, F.lit(",/1:"), (lead.cast("int") + 2).cast("string")).alias("cfi")).groupBy("doc_id").agg(F.collect_list("cfi").alias("cfis"))
    found = extraction.locators_for_cfis(_chapters(spark, d).join(asked, "doc_id"), "cfis", keep=["doc_id"])
    return found.select("doc_id", "start", "cfi", "partial_cfi", cfi.join_publication(F.lit("/6/2"), F.col("partial_cfi")).alias("whole"))


# --- positions that are not plain ----------------------------------------------------------------


@query("SELECT source AS book, CAST(count(*) AS BIGINT) AS positions, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) FILTER (WHERE doc_id % 3 = 0), '|') AS unreadable FROM documents GROUP BY source")
def unreadable_totals(spark: SparkSession, d: str) -> DataFrame:
    """Books where nothing has a length, a third because it can't be read: one position each."""
    r = T.document_resources(spark, d).withColumn("length", F.lit(None).cast("long")).withColumn("unreadable", F.col("doc_id") % 3 == 0)
    t = positions.totals(positions.resources(r))
    return t.select("book", "positions", F.nullif(F.array_join("unreadable", "|"), F.lit("")).alias("unreadable"))


@query("SELECT DISTINCT source AS book, source IN ('src0', 'src1', 'src2') AS valid FROM documents WHERE source <> 'src9'")
def cache_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Caches with a wrong count, another version, no width or an unreadable resource with a length are
    told to be invalid; what is no JSON gives nothing. Those of src0 to src2 are sound."""
    cached = positions.cache(positions.resources(T.document_resources(spark, d)))
    n = F.regexp_extract("book", "([0-9]+)$", 1).cast("int")
    j = F.col("json")
    spoilt = (
        F.when(n < 3, j).when(n == 9, F.lit("no JSON")).when(n % 4 == 0, F.regexp_replace(j, '"version":[0-9]+', '"version":99')).when(n % 4 == 1, F.regexp_replace(j, '"charactersPerPosition":[0-9]+', '"charactersPerPosition":0'))
        .when(n % 4 == 2, F.regexp_replace(j, '"count":[0-9]+', '"count":77777')).otherwise(F.regexp_replace(j, '("length":[0-9]+)', '$1,"unreadable":true'))
    )
    return positions.from_cache(cached.select("book", spoilt.alias("json"))).select("book", "valid").distinct()


# --- the reader's side ---------------------------------------------------------------------------


@query(f"WITH {_CH}, {_BLOCKS} SELECT doc_id, sha256(text) AS sha, false AS active, true AS styled, '../gone.css' AS sheet, CAST(NULL AS VARCHAR) AS error FROM whole")
def prepared_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with scripts, frames, handlers and references that climb out, made safe: nothing active is
    left, the text is what it was, a clamped reference stays inside."""
    evil = "<script>bad()</script><iframe src='x'></iframe><link rel='stylesheet' href='../../../gone.css'/><a onclick='bad()' href='javascript:bad()'></a>"
    docs = B.chapters(spark, d).select(F.col("book"), F.concat(F.lit("pub/"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("path"), F.lit("application/xhtml+xml").alias("media_type"), F.lit(False).alias("fixed"), F.replace("content", F.lit("</body>"), F.lit(evil + "</body>")).alias("content"))
    shown = reader.prepared(docs).withColumn("doc_id", F.regexp_extract("path", "([0-9]+)[.]", 1).cast("bigint"))
    x = extraction.extract(shown.select("doc_id", F.col("html").alias("content"), "media_type", "path"), keep=["doc_id"]).select("doc_id", F.sha2("text", 256).alias("sha"))
    active = F.col("html").rlike("bad\\(\\)|<iframe|javascript:|onclick")
    return shown.join(x, "doc_id").select("doc_id", "sha", active.alias("active"), F.contains("html", F.lit("column-width")).alias("styled"), F.regexp_extract("html", 'href="([^"]*gone[.]css)"', 1).alias("sheet"), "error")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'load' WHEN 1 THEN 'navigate' WHEN 2 THEN 'external' ELSE 'block' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'http://s/t/' || event_id || '.xhtml' ELSE 'http://s/t/' || event_id || '.psd#a' END AS url, CAST(greatest(1, round((event_id % 13) * 100 / 300.0)) AS INTEGER) AS pages, CASE WHEN event_id % 2 = 0 THEN '{"a":' || event_id || '}' ELSE '[' || event_id || ']' END AS result FROM events""")
def reader_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What links may do, where resources are shown, pages of a scroller, and results of scripts."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    url = F.when(e % 5 == 0, F.concat(F.lit("http://s/t/"), n, F.lit(".html#x"))).when(e % 5 == 1, "http://s/t/other.html").when(e % 5 == 2, "https://h.example/").when(e % 5 == 3, "file:///x").otherwise("javascript:x")
    own, other = F.concat(n, F.lit(".psd#a")), F.when(e % 2 == 0, F.concat(n, F.lit(".xhtml")))
    geometry = reader.pages(F.lit(0), F.lit(300), (e % 13) * 100)
    said = F.when(e % 2 == 0, F.concat(F.lit('"{\\"a\\":'), n, F.lit('}"'))).otherwise(F.concat(F.lit("["), n, F.lit("]")))
    return table(spark, d, "events").select("event_id", reader.decide(url, F.lit("http://s/t/"), F.concat(n, F.lit(".html"))).alias("decision"), reader.url_for(F.lit("http://s/t/"), own, other).alias("url"), geometry["pages"].alias("pages"), values.script_result(said).alias("result"))


@query(f"WITH {_CH} SELECT book, doc_id, 'pub/text/' || doc_id || '.xhtml' AS href FROM ch")
def shown_resources(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a session is asked for, as the resources that they are."""
    lib = _library(spark, d)
    asked = B.chapters(spark, d).select("book", "doc_id", F.explode(F.array(F.concat(F.lit("pub/text/"), F.col("doc_id").cast("string"), F.lit(".xhtml")), F.lit("pub/none"))).alias("path"))
    found = reader.resource_for(asked, lib.reading_order.select("book", "href"), lib.manifest.where("not external").select("book", "href"))
    return found.select("book", "doc_id", "href")


@query("""SELECT event_id AS tap, max(b) AS id FROM events, (SELECT unnest(range(12)) AS b) WHERE event_id % 1000 BETWEEN b * 70 AND b * 70 + 100 AND event_id % 37 * 10 BETWEEN b * 5 AND b * 5 + 200 GROUP BY event_id""")
def decoration_hits(spark: SparkSession, d: str) -> DataFrame:
    """Taps against overlapping boxes: the topmost one."""
    b = spark.range(12).select("id", F.col("id").alias("order"), (F.col("id") * 70).alias("left"), (F.col("id") * 5).alias("top"), (F.col("id") * 70 + 100).alias("right"), (F.col("id") * 5 + 200).alias("bottom"))
    taps = table(spark, d, "events").select(F.col("event_id").alias("tap"), (F.col("event_id") % 1000).alias("x"), (F.col("event_id") % 37 * 10).alias("y"))
    return reader.hit_test(taps, b)


@query("""SELECT event_id, event_id % 4 < 2 AND event_id % 3 > 0 AS drawn, event_id % 6 = 0 AS twice, event_id % 5 >= 2 AS fresh FROM events""")
def decoration_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which decorations are drawn, which lists are refused as they name an id twice, and which results are
    of the document that is shown."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("cfi", "text", "fragment", "start"))), (e % 4 + 1).cast("int")).alias("match"), F.lit(5).alias("start"), (5 + e % 3).alias("end"))
    drawn = reader.drawable(rows).select("event_id", F.lit(True).alias("drawn"))
    item = lambda i: F.struct(i.cast("string").alias("id"))
    twice = reader.decoration_errors(table(spark, d, "events").select(e.alias("reader"), F.lit("g").alias("group"), F.lit(1).alias("revision"), F.array(item(e % 6), item(e * 0)).alias("items"))).select(F.col("reader").alias("event_id"), F.lit(True).alias("twice"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.join(drawn, "event_id", "left").join(twice, "event_id", "left").select("event_id", no("drawn"), no("twice"), streams.not_stale(e % 5, F.lit(2)).alias("fresh"))


@query("SELECT event_id, user_id AS reader, event_type AS \"group\", event_id AS item FROM events WHERE event_id % 3 = 0")
def decoration_activations(spark: SparkSession, d: str) -> DataFrame:
    """Taps that name a decoration, with that decoration; others, and those of other readers, fall away."""
    e = T.reader_events(spark, d)
    i = F.col("event_id").cast("string")
    held = e.select("reader", F.col("type").alias("group"), F.array(F.struct(i.alias("id"), F.col("event_id").alias("n"))).alias("items"))
    taps = e.select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("reader") + 1_000_000).otherwise(F.col("reader")).alias("reader"), F.col("type").alias("group"), F.when(F.col("event_id") % 3 == 2, F.lit("none")).otherwise(i).alias("id"))
    return streams.activations(taps, held).select("event_id", "reader", "group", F.col("item.n").alias("item"))


# --- streams -------------------------------------------------------------------------------------

_STORE = "spark.sql.streaming.stateStore.providerClass"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of its file."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """A stream in update mode, run over all that is there, its rows as a table."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = scratch.folder(spark, name)
    try:
        sink = stream.writeStream.outputMode("update").option("checkpointLocation", scratch.folder(spark, "offsets")).trigger(availableNow=True)
        sink.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT user_id AS reader, max(event_id % 7) AS epoch, 'p' || arg_max(event_id, (event_id % 7) * 100000000 + event_id) AS href, arg_max(event_id % 100, (event_id % 7) * 100000000 + event_id) / 100 AS progression FROM events GROUP BY user_id")
def streamed_locations(spark: SparkSession, d: str) -> DataFrame:
    """Every reader's place out of a stream of relocations: results of older documents are dropped."""
    e = F.col("event_id")
    moves = _stream(spark, d).select(F.col("user_id").cast("bigint").alias("reader"), (e % 7).cast("bigint").alias("epoch"), F.timestamp_seconds(e).alias("ts"), F.concat(F.lit("p"), e.cast("string")).alias("href"), ((e % 100) / 100.0).alias("progression"))
    states = _run(spark, streams.location_state(moves), "places")
    return states.groupBy("reader").agg(F.max_by(F.struct("epoch", "href", "progression"), F.struct("epoch", "ts")).alias("x")).select("reader", "x.*")


@query("SELECT user_id AS reader, event_type AS \"group\", max(event_id) AS revision, CASE WHEN arg_max(value, event_id) > 20 THEN '[' || max(event_id) || ']' END AS items FROM events GROUP BY ALL")
def streamed_decorations(spark: SparkSession, d: str) -> DataFrame:
    """Every group's list out of a stream of changes: the last revision counts, an empty list deletes."""
    e = F.col("event_id")
    changes = _stream(spark, d).select(F.col("user_id").cast("bigint").alias("reader"), F.col("event_type").alias("group"), e.alias("revision"), F.when(F.col("value") > 20, F.concat(F.lit("["), e.cast("string"), F.lit("]"))).otherwise("[]").alias("items"))
    states = _run(spark, streams.decoration_state(changes), "decorations")
    last = states.groupBy("reader", "group").agg(F.max_by(F.struct("revision", "items"), "revision").alias("x"))
    return last.select("reader", "group", "x.revision", F.when(F.col("x.items") != "[]", F.col("x.items")).alias("items"))


@query(f"""WITH res AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, {_LEN.format(x="coalesce(text, '')")} AS len FROM documents), c AS (SELECT *, CASE WHEN len = 0 THEN 1 ELSE CAST(ceil(len / 1024.0) AS BIGINT) END AS cnt FROM res),
placed AS (SELECT *, 1 + CAST(coalesce(sum(cnt) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c)
SELECT event_id, 'src' || (event_id % 20) AS book, CASE WHEN len = 0 THEN start WHEN len > 0 THEN start + least(cnt - 1, CAST(floor(round(0.5 * len) / 1024) AS BIGINT)) END AS position FROM events LEFT JOIN placed ON book = 'src' || (event_id % 20) AND idx = event_id % 4""")
def placed_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places in the middle of resources that events tell, with their numbers in the position table."""
    e = F.col("event_id")
    places = table(spark, d, "events").select("event_id", F.concat(F.lit("src"), (e % 20).cast("string")).alias("book"), (e % 4).alias("idx"), F.lit(0.5).alias("progression"))
    return streams.with_positions(places, positions.resources(T.document_resources(spark, d))).select("event_id", "book", F.col("position").cast("bigint").alias("position"))
