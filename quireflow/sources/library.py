"""A library of books as a family of DataFrames.

Library.read() takes containers as rows (book, content) of bytes, from Spark's binaryFile reader, so any store
that Spark reaches will do. Books are parsed and members read where the bytes are: containers never go through
a shuffle. Each relation that is asked of `books` parses them again, unless kept() has written that table.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import fonts, package
from ..kernels.archive import Archive, Limits, checked_range
from ..kernels.errors import BookError
from ..kernels.paths import resource_path
from ..kernels.reading import TEXT_TYPES

_MAP = pa.map_(pa.string(), pa.string())


def _struct(*fields: tuple[str, pa.DataType]) -> pa.DataType:
    return pa.struct(list(fields))


_S, _L = pa.string(), pa.list_(pa.string())
_PERSON = _struct(("name", _S), ("roles", _L), ("file_as", _S), ("identifier", _S), ("language", _S), ("direction", _S))
_METADATA = _struct(
    ("title", _S), ("subtitle", _S), ("identifier", _S), ("titles", pa.list_(_struct(("value", _S), ("language", _S), ("direction", _S), ("id", _S)))), ("identifiers", _L), ("languages", _L),
    ("authors", pa.list_(_PERSON)), ("contributors", pa.list_(_PERSON)), ("publishers", pa.list_(_PERSON)), ("subjects", pa.list_(_struct(("name", _S), ("code", _S), ("scheme", _S)))),
    ("belongs_to", pa.list_(_struct(("name", _S), ("type", _S), ("position", pa.float64())))), ("description", _S), ("rights", _S), ("published", pa.timestamp("us")), ("modified", pa.timestamp("us")),
    ("duration_us", pa.int64()), ("pages", pa.int64()), ("reading_progression", _S), ("layout", _S), ("orientation", _S), ("spread", _S), ("cover", _S), ("accessibility", pa.map_(_S, _L)), ("properties", _MAP),
    ("raw", pa.list_(_struct(("name", _S), ("namespace", _S), ("value", _S), ("id", _S), ("refines", _S), ("scheme", _S), ("language", _S), ("property", _S), ("attributes", _MAP)))),
)
_ITEM = _struct(
    ("ord", pa.int32()), ("item_id", _S), ("href", _S), ("path", _S), ("media_type", _S), ("declared_type", _S), ("tokens", _L), ("fallback", _S), ("media_overlay", _S), ("fallback_style", _S),
    ("external", pa.bool_()), ("duration_us", pa.int64()), ("rels", _L), ("properties", _MAP),
)
_SPINE = _struct(("pos", pa.int32()), ("idref", _S), ("href", _S), ("path", _S), ("media_type", _S), ("linear", pa.bool_()), ("cfi_path", _S), ("properties", _MAP))
_NAV = _struct(("kind", _S), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("href", _S), ("title", _S), ("rels", _L), ("properties", _MAP))
_LINK = _struct(("href", _S), ("type", _S), ("title", _S), ("rels", _L), ("properties", _MAP))
_COLLECTION = _struct(("role", _S), ("path", pa.list_(pa.int32())), ("links", pa.list_(_LINK)))
_WARNING = _struct(("code", _S), ("message", _S), ("path", _S))
_FIELDS = [
    ("package_path", _S), ("identifier", _S), ("metadata", _METADATA), ("manifest", pa.list_(_ITEM)), ("spine", pa.list_(_SPINE)), ("nav", pa.list_(_NAV)), ("links", pa.list_(_LINK)),
    ("collections", pa.list_(_COLLECTION)), ("encryption", _MAP), ("warnings", pa.list_(_WARNING)), ("missing", _L), ("error", _struct(("kind", _S), ("message", _S), ("path", _S))),
]


def _pairs(row: dict, *names: str) -> dict:
    return row | {n: list((row.get(n) or {}).items()) for n in names}


def _book_row(content: bytes, limits: Limits, options: package.Options) -> dict:
    try:
        b = package.parse(Archive.of_bytes(content, limits), options)
    except BookError as error:
        return dict.fromkeys(n for n, _ in _FIELDS) | {"error": error.as_row()}
    meta = _pairs(b.metadata, "accessibility", "properties")
    meta["raw"] = [_pairs(r, "attributes") for r in meta["raw"]]
    link = lambda x: _pairs({"title": None, "type": None} | {k: v for k, v in x.items() if k in ("href", "type", "title", "rels", "properties")}, "properties")
    return {
        "package_path": b.package_path, "identifier": b.identifier, "metadata": meta, "manifest": [_pairs(i, "properties") for i in b.manifest], "spine": [_pairs(s, "properties") for s in b.spine],
        "nav": [_pairs(n, "properties") for n in b.nav], "links": [link(x) for x in b.links], "collections": [{"role": c["role"], "path": c["path"], "links": [link(x) for x in c["links"]]} for c in b.collections],
        "encryption": list(b.encryption.items()), "warnings": [dict(zip(("code", "message", "path"), w, strict=True)) for w in b.warnings], "missing": b.missing, "error": None,
    }


def _spark_type(t: pa.DataType) -> str:
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_spark_type(f.type)}" for f in t) + ">"
    if pa.types.is_map(t):
        return f"map<{_spark_type(t.key_type)},{_spark_type(t.item_type)}>"
    if pa.types.is_list(t):
        return f"array<{_spark_type(t.value_type)}>"
    return {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.timestamp("us"): "timestamp_ntz"}[t]


class Library:
    """Books, and the tables that their packages hold. `books` has a row for every container, with an
    error for those that can't be opened."""

    def __init__(self, containers: DataFrame, books: DataFrame, limits: Limits = Limits(), options: package.Options = package.Options()):
        self.containers, self.books, self.limits, self.options = containers, books, limits, options

    @classmethod
    def read(cls, spark: SparkSession, path: str, pattern: str = "*.epub", **options) -> Library:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        return cls.of(files.select(F.col("path").alias("book"), "content"), **options)

    @classmethod
    def of(cls, containers: DataFrame, limits: Limits = Limits(), options: package.Options = package.Options(), failfast: bool = False) -> Library:
        """containers: (book, content)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_book_row(c or b"", limits, options) for c in batch.column(1).to_pylist()]
                for r in rows:
                    if failfast and r["error"]:
                        raise BookError(**r["error"])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in _FIELDS)], names=["book", *(n for n, _ in _FIELDS)])

        source = containers.select("book", F.col("content").cast("binary").alias("content"))
        schema = f"book {source.schema['book'].dataType.simpleString()}, " + ", ".join(f"{n} {_spark_type(t)}" for n, t in _FIELDS)
        return cls(source, source.mapInArrow(run, schema), limits, options)

    def kept(self, folder: str) -> Library:
        """The same library with its table of books written to `folder` and read from there, so that what
        the packages hold is parsed once for all relations."""
        self.books.write.mode("overwrite").parquet(folder)
        return Library(self.containers, self.books.sparkSession.read.schema(self.books.schema).parquet(folder), self.limits, self.options)

    def _exploded(self, name: str) -> DataFrame:
        return self.books.select("book", F.explode(name).alias("x")).select("book", "x.*")

    @property
    def manifest(self) -> DataFrame:
        return self._exploded("manifest")

    @property
    def spine(self) -> DataFrame:
        return self._exploded("spine")

    @property
    def reading_order(self) -> DataFrame:
        """Linear spine items with idx, from 0."""
        return self.books.select("book", F.posexplode(F.filter("spine", lambda s: s["linear"])).alias("idx", "x")).select("book", F.col("idx").cast("long").alias("idx"), "x.*")

    @property
    def nav(self) -> DataFrame:
        return self._exploded("nav")

    @property
    def collections(self) -> DataFrame:
        return self._exploded("collections")

    @property
    def warnings(self) -> DataFrame:
        return self._exploded("warnings")

    @property
    def errors(self) -> DataFrame:
        return self.books.where("error is not null").select("book", "error.*")

    def metadata(self) -> DataFrame:
        return self.books.where("error is null").select("book", "metadata.*")

    def metadata_json(self) -> DataFrame:
        """One JSON document a book; what is absent is left out."""
        return self.books.where("error is null").select("book", F.to_json(F.col("metadata").dropFields("raw")).alias("json"))

    def _read(self, source: DataFrame, wanted, columns: pa.Schema) -> DataFrame:
        """Rows that wanted(archive, parsed book, further columns) gives for every container that opens,
        beside its book. source: (book, content, ...)."""
        limits, options = self.limits, self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rest = [batch.column(k)[i].as_py() for k in range(2, batch.num_columns)]
                    try:
                        archive = Archive.of_bytes(batch.column(1)[i].as_py() or b"", limits)
                        rows = wanted(archive, *rest)
                    except BookError as error:
                        rows = wanted(error, *rest)
                    rows = list(rows)
                    book = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([book, *(pa.array([r[f.name] for r in rows], f.type) for f in columns)], names=["book", *columns.names])

        kinds = {**{f.name: f.type for f in columns}}
        schema = ", ".join(f"{n} {'binary' if t == pa.binary() else _spark_type(t)}" for n, t in kinds.items())
        return source.mapInArrow(run, f"book {source.schema['book'].dataType.simpleString()}, {schema}")

    def entries(self, content: bool = False) -> DataFrame:
        """(book, path, size, is_dir, method, crc32, compressed_size, content, error): every entry of every
        container, with `content` its bytes as well; an archive that can't be read gives one row with its error."""

        def every(archive: Archive | BookError) -> Iterator[dict]:
            none = dict.fromkeys(_ENTRY.names)
            if isinstance(archive, BookError):
                yield none | {"error": archive.as_row()}
                return
            for e in archive.entries.values():
                row = none | {"path": e.path, "size": e.size, "is_dir": e.is_dir, "method": e.method, "crc32": e.crc32, "compressed_size": e.compressed_size}
                if content and not e.is_dir:
                    try:
                        row["content"] = archive.read(e.path)
                    except BookError as error:
                        row["error"] = error.as_row()
                yield row

        return self._read(self.containers.select("book", "content"), every, _ENTRY)

    def resources(self, wanted: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        """wanted (book, href) with media_type, content and error: members by manifest href (query and
        fragment don't count), obfuscated fonts in clear, byte ranges half-open. Every book is opened once
        for all that is asked of it. What is asked goes to the containers as a broadcast up to WANTED_BYTES,
        which is checked first; more meets them in a join."""
        asked = wanted.groupBy("book").agg(F.collect_list("href").alias("hrefs"))
        size = asked.agg(F.sum(F.octet_length(F.array_join("hrefs", " ")) + 64)).first()[0] or 0
        source = self.containers.join(F.broadcast(asked) if size <= WANTED_BYTES else asked, "book").select("book", "content", "hrefs")
        options = self.options

        def some(archive: Archive | BookError, hrefs: list[str]) -> Iterator[dict]:
            opened = None
            for href in hrefs:
                try:
                    if isinstance(archive, BookError):
                        raise archive
                    if opened is None:
                        opened = package.parse(archive, options)
                        known = {i["href"]: i for i in opened.manifest}
                    yield _member(archive, opened, known, href, start, end)
                except BookError as error:
                    yield {"href": href, "media_type": None, "content": None, "error": error.as_row()}

        return self._read(source, some, _RESOURCE)

    def documents(self) -> DataFrame:
        """(book, idx, href, path, media_type, content, error) of the reading order's text documents, read in
        one pass over the containers. Books that don't open have none; errors tells why."""
        options = self.options

        def texts(archive: Archive | BookError) -> Iterator[dict]:
            if isinstance(archive, BookError):
                return
            try:
                opened = package.parse(archive, options)
            except BookError:
                return
            known = {i["href"]: i for i in opened.manifest}
            for idx, item in enumerate(s for s in opened.spine if s["linear"]):
                if item["media_type"] in TEXT_TYPES:
                    yield {"idx": idx, "path": item["href"]} | _member(archive, opened, known, item["href"])

        return self._read(self.containers.select("book", "content"), texts, _DOCUMENT)


#: Bytes of hrefs that are broadcast.
WANTED_BYTES = 8 << 20
_ERROR = _struct(("kind", _S), ("message", _S), ("path", _S))
_ENTRY = pa.schema([("path", _S), ("size", pa.int64()), ("is_dir", pa.bool_()), ("method", pa.int32()), ("crc32", pa.int64()), ("compressed_size", pa.int64()), ("content", pa.binary()), ("error", _ERROR)])
_RESOURCE = pa.schema([("href", _S), ("media_type", _S), ("content", pa.binary()), ("error", _ERROR)])
_DOCUMENT = pa.schema([("idx", pa.int64()), ("href", _S), ("path", _S), ("media_type", _S), ("content", pa.binary()), ("error", _ERROR)])


def _member(archive: Archive, book: package.Book, known: dict[str, dict], href: str, start: int | None = None, end: int | None = None) -> dict:
    """One resource by its manifest href: what it is declared as, and its bytes or why there are none."""
    row = {"href": href, "media_type": None, "content": None, "error": None}
    bare = href.split("#")[0].split("?")[0]
    try:
        if bare not in known:
            raise BookError("resource", "not in the manifest", href)
        row["media_type"] = known[bare]["media_type"]
        path = resource_path(bare)
        size = archive.entries[path].size if path in archive.entries else 0
        a, b = checked_range(size, start, None if end is None else min(end, size), "resource", path)
        data = archive.read(path, a, b)
        row["content"] = fonts.reveal(data, book.encryption[path], book.identifier, a, path) if path in book.encryption else data
    except BookError as error:
        row["error"] = error.as_row()
    return row


def json_default(x):
    """For json.dumps over rows of a library."""
    return x.isoformat() if isinstance(x, (dt.datetime, dt.date)) else repr(x)


def report(outcomes: DataFrame) -> str:
    """A conformance report: how many books had each outcome."""
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    return json.dumps({"total": sum(counts.values()), "outcomes": dict(sorted(counts.items()))}, indent=2)
