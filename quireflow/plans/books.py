"""Plain tables as containers: the documents of a source, sixteen a book, packed by their rows.

A book holds every kind of thing that packages say, so that queries over containers can be held against
the rows that they were made from. Chapters keep their document's lines as paragraphs with ids.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..operators.running import numbered
from .tables import table

CHAPTERS = 16
#: What XML 1.0 can't hold, and carriage returns, which it reads as line feeds.
UNSPEAKABLE = "[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]"
_XHTML = 'xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'
_CONTAINER = '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="pub/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_ENCRYPTION = '<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><enc:CipherData><enc:CipherReference URI="pub/face.otf"/></enc:CipherData></enc:EncryptedData></encryption>'


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(book, idx, doc_id, lang, text, content): documents as chapters, with their XHTML."""
    rows = table(spark, folder, "documents").select("source", "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.regexp_replace(F.coalesce("text", F.lit("")), UNSPEAKABLE, "").alias("text"))
    rows = numbered(rows, "source", "doc_id", "n")
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    paragraphs = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit('<p id="l'), i.cast("string"), F.lit('">'), escape_html(line), F.lit("</p>")))
    content = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), "lang", F.lit('"><head><title>'), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1>"), F.array_join(paragraphs, ""), F.lit("</body></html>"))
    book = F.concat("source", F.lit("-"), F.floor(F.col("n") / CHAPTERS).cast("string"))
    return rows.select(book.alias("book"), (F.col("n") % CHAPTERS).alias("idx"), "doc_id", "lang", "text", content.alias("content"))


def identifier(book: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, book).urn


def font(book: str) -> bytes:
    return (hashlib.sha256(book.encode()).hexdigest() * 22)[:1400].encode()


def _package(book: str, ids: list[int], lang: str) -> str:
    source, _, number = book.rpartition("-")
    items = "".join(f'<item id="c{i}" href="text/{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
    spine = "".join(f'<itemref idref="c{i}" id="r{i}"' + (' linear="no"' if k and k == len(ids) - 1 else "") + (' properties="page-spread-left"' if k == 0 else "") + "/>" for k, i in enumerate(ids))
    return (
        f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid" xml:lang="{lang}" prefix="own: http://own.example/"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'
        f'<dc:identifier id="uid">{identifier(book)}</dc:identifier><dc:title id="t2">Part {number}</dc:title><dc:title id="t1">  Book   {book} </dc:title><dc:language>{lang}</dc:language>'
        f'<dc:creator id="a">Ann {source}</dc:creator><dc:creator id="e">Ed {source}</dc:creator><dc:contributor id="t">Tr {source}</dc:contributor><dc:publisher>House {source}</dc:publisher><dc:subject>{lang}</dc:subject>'
        f'<dc:date>20{len(ids):02d}-05</dc:date><meta property="dcterms:modified">2020-01-{len(ids):02d}T00:00:00Z</meta><meta refines="#t1" property="title-type">main</meta><meta refines="#t2" property="title-type">subtitle</meta>'
        f'<meta refines="#a" property="role">http://id.loc.gov/vocabulary/relators/aut</meta><meta refines="#e" property="role">http://id.loc.gov/vocabulary/relators/edt</meta><meta refines="#t" property="role">trl</meta>'
        f'<meta property="schema:accessMode">textual</meta><meta property="schema:accessMode">visual</meta><meta property="media:duration">0:{len(ids)}:30</meta><meta property="own:note">note {number}</meta><meta property="schema:numberOfPages">{100 + len(ids)}</meta>'
        f'<meta id="s" property="belongs-to-collection">{source}</meta><meta refines="#s" property="group-position">{number}</meta><meta refines="#s" property="collection-type">series</meta><link rel="record" href="meta.xml" media-type="application/xml"/></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}<item id="art" href="art.psd" media-type="image/x-psd" fallback="c{ids[0]}"/><item id="css" href="gone.css" media-type="text/css"/>'
        f'<item id="face" href="face.otf" media-type="font/otf"/><item id="far" href="https://far.example/v.mp4" media-type="video/mp4" properties="remote-resources"/><item id="jpg" href="a.jpg" media-type="image/jpg"/></manifest>'
        f'<spine page-progression-direction="{"rtl" if int(number) % 2 else "ltr"}">{spine}</spine><guide><reference type="text" title="Start" href="text/{ids[0]}.xhtml"/></guide>'
        f'<collection role="preview"><link href="text/{ids[0]}.xhtml"/></collection></package>'
    )


def _nav(ids: list[int]) -> str:
    entries = "".join(f'<li><a href="text/{i}.xhtml"> Doc  {i}</a><ol><li><a href="text/{i}.xhtml#l0">Line 0 of {i}</a></li></ol></li>' for i in ids)
    pages = "".join(f'<li><a href="text/{i}.xhtml">{k + 1}</a></li>' for k, i in enumerate(ids))
    return f'<html {_XHTML}><head><title>n</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav><nav epub:type="page-list"><ol>{pages}</ol></nav></body></html>'


def pack(files: dict[str, bytes]) -> bytes:
    """A container with these entries after its mimetype; equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name.endswith((".otf", ".jpg")) else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def files_of(book: str, rows: list[dict]) -> dict[str, bytes]:
    """The entries of a book. rows: (idx, doc_id, lang, content)."""
    rows = sorted(rows, key=lambda r: r["idx"])
    ids = [r["doc_id"] for r in rows]
    key = hashlib.sha1(identifier(book).encode()).digest()
    hidden = bytes(b ^ key[i % 20] if i < 1040 else b for i, b in enumerate(font(book)))
    named = {"META-INF/container.xml": _CONTAINER, "META-INF/encryption.xml": _ENCRYPTION, "pub/book.opf": _package(book, ids, rows[0]["lang"]), "pub/nav.xhtml": _nav(ids)}
    return {k: v.encode() for k, v in named.items()} | {"pub/face.otf": hidden, "pub/a.jpg": b"\xff\xd8" + book.encode()} | {f"pub/text/{r['doc_id']}.xhtml": r["content"].encode() for r in rows}


def containers(spark: SparkSession, folder: str) -> DataFrame:
    """(book, content): the documents table as books."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([pack(files_of(book, rows))], pa.binary())], names=["book", "content"])

    grouped = chapters(spark, folder).groupBy("book").agg(F.collect_list(F.struct("idx", "doc_id", "lang", "content")).alias("rows"))
    return grouped.mapInArrow(run, "book string, content binary")
