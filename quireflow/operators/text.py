"""Text extraction: content documents to reading text, blocks and the CFI map, one Arrow batch at a time.

A document that can't be read gives a row with an error instead of failing the job; failfast=True raises.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import cfi as C
from ..kernels import folding, locating, reading
from ..kernels.errors import ERROR, BookError
from ..kernels.folding import Sensitivity
from ..kernels.units import from_units

BLOCK = "struct<start:int,end:int,kind:string,heading_level:int,list_depth:int,quote_depth:int,language:string,text:string>"
TEXT = f"title string, language string, text string, len16 int, blocks array<{BLOCK}>, ids map<string,int>, n_runs int, error {ERROR}"
_BLOCKS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("heading_level", pa.int32()), ("list_depth", pa.int32()), ("quote_depth", pa.int32()), ("language", pa.string()), ("text", pa.string())]))
_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string()), ("path", pa.string())])


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)


def _read(content, media_type: str, path: str | None, limits: dict):
    if isinstance(content, str):
        return reading.parse(content, media_type, path, **limits)
    return reading.read(bytes(content), media_type, path, **limits)


def extract(df: DataFrame, content: str = "content", media_type: str = "media_type", path: str = "path", keep: list[str] | None = None, failfast: bool = False, **limits) -> DataFrame:
    """Columns `keep` of df (all but content) with the columns of TEXT. Rows of other media types, and
    rows past the byte limit, never reach the parser's input as bytes to be parsed: text is null."""
    names = keep if keep is not None else [c for c in df.columns if c != content]
    source = df.select(*names, F.col(content).alias("_content"), F.col(media_type).alias("_type"), F.col(path).cast("string").alias("_path"))
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                content, kind, where = (batch.column(at + k)[i].as_py() for k in range(3))
                row = {"title": None, "language": None, "text": None, "len16": None, "blocks": None, "ids": None, "n_runs": None, "error": None}
                if content is not None and kind in reading.TEXT_TYPES:
                    try:
                        d = _read(content, kind, where, limits)
                        blocks = [{"start": b.start, "end": b.end, "kind": b.kind, "heading_level": b.heading_level, "list_depth": b.list_depth, "quote_depth": b.quote_depth, "language": b.language, "text": from_units(d.text[b.start : b.end])} for b in d.blocks]
                        row |= {"title": d.title and from_units(d.title), "language": d.language, "text": from_units(d.text), "len16": len(d.text), "blocks": blocks, "ids": [(k, d.start[e]) for k, e in d.ids.items()], "n_runs": len(d.runs)}
                    except BookError as error:
                        if failfast:
                            raise
                        row["error"] = error.as_row()
                rows.append(row)
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), _BLOCKS, pa.map_(pa.string(), pa.int32()), pa.int32(), _ERROR]
            cols = [pa.array([r[k] for r in rows], t) for k, t in zip(("title", "language", "text", "len16", "blocks", "ids", "n_runs", "error"), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *cols], names=[*names, "title", "language", "text", "len16", "blocks", "ids", "n_runs", "error"])

    return source.mapInArrow(run, f"{_columns(source.select(*names))}, {TEXT}" if names else TEXT)


def blocks(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """One row a block: keys, block number, and the block's fields."""
    return extracted.select(*keys, F.posexplode("blocks").alias("block", "b")).select(*keys, "block", "b.*")


def block_at(offsets: DataFrame, blocks_df: DataFrame, keys: list[str]) -> DataFrame:
    """offsets (keys, offset) with the block that holds it, or the one that follows."""
    joined = offsets.join(blocks_df.select(*keys, "block", "start", "end"), keys)
    last = joined.groupBy(*keys, "offset").agg(
        F.min_by("block", F.when(F.col("offset") < F.col("end"), F.col("end"))).alias("inside"), F.max_by("block", "end").alias("final"), F.max("end").alias("limit")
    )
    return last.select(*keys, "offset", F.coalesce("inside", F.when(F.col("offset") == F.col("limit"), F.col("final"))).alias("block"))


def map_documents(df: DataFrame, one, schema: str, arrow: pa.Schema, content: str = "content", media_type: str = "media_type", path: str = "path", keep: list[str] | None = None, argument: str | None = None, failfast: bool = False, unread: tuple[dict, ...] = ()) -> DataFrame:
    """Rows that `one(document, argument)` gives for each readable document, beside columns `keep`.
    The document is parsed once however much is asked of it. A document that can't be read
    gives the rows `unread`; failfast=True raises."""
    names = keep if keep is not None else [c for c in df.columns if c not in (content, argument)]
    source = df.select(*names, F.col(content).alias("_content"), F.col(media_type).alias("_type"), F.col(path).cast("string").alias("_path"), *([F.col(argument).alias("_argument")] if argument else []))
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i in range(batch.num_rows):
                content, kind, where = (batch.column(at + k)[i].as_py() for k in range(3))
                if kind not in reading.TEXT_TYPES:
                    continue
                try:
                    if content is None:
                        raise BookError("content", "the document is missing", where)
                    found = one(_read(content, kind, where, {}), batch.column(at + 3)[i].as_py() if argument else None)
                except BookError:
                    if failfast:
                        raise
                    found = unread
                owner += [i] * len(found)
                rows += found
            kept = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(at)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[f.name] for r in rows], f.type) for f in arrow)], names=[*names, *arrow.names])

    return source.mapInArrow(run, f"{_columns(source.select(*names))}, {schema}")


_SAMPLE = pa.schema([("offset", pa.int32()), ("canonical", pa.int32()), ("cfi", pa.string()), ("back", pa.int32()), ("range_cfi", pa.string()), ("range_start", pa.int32()), ("range_end", pa.int32()), ("match", pa.string())])


def cfi_samples(df: DataFrame, stride: int = 50, span: int = 9, **options) -> DataFrame:
    """Every stride-th offset as a point and a short range, and where they resolve to again: at `canonical`,
    the offset itself, or the next text where none of the document's characters is there. A document that can't be
    read gives one row of nulls."""

    def one(d: reading.Document, _) -> list[dict]:
        out = []
        told = {o for _, (_, _, begin, given) in d.runs for o in range(begin, begin + given)}
        starts = sorted(begin for _, (_, _, begin, _) in d.runs)
        for o in range(0, len(d.text) + 1, stride):
            point = d.cfi_at(o)
            range_ = d.cfi_for(o, min(o + span, len(d.text)))
            a, b = d.resolve(point), d.resolve(range_)
            k = bisect_right(starts, o)
            canonical = o if o in told or k == len(starts) else starts[k]
            out.append({"offset": o, "canonical": canonical, "cfi": str(point), "back": a and a[0], "range_cfi": str(range_), "range_start": b and b[0], "range_end": b and b[1], "match": a and a[2]})
        return out

    return map_documents(df, one, "offset int, canonical int, cfi string, back int, range_cfi string, range_start int, range_end int, match string", _SAMPLE, unread=(dict.fromkeys(_SAMPLE.names),), **options)


_POINTS = pa.schema([("offset", pa.int32()), ("cfi", pa.string())])


def cfis_at(df: DataFrame, offsets: str, before: bool = False, **options) -> DataFrame:
    """Rows (keys, content, offsets array) -> one row an offset with its CFI expression."""

    def one(d: reading.Document, wanted) -> list[dict]:
        return [{"offset": o, "cfi": C.expression(d.cfi_at(o, before))} for o in wanted or () if 0 <= o <= len(d.text)]

    return map_documents(df, one, "offset int, cfi string", _POINTS, argument=offsets, **options)


_RANGES = pa.schema([("start", pa.int32()), ("end", pa.int32()), ("cfi", pa.string())])


def cfis_for(df: DataFrame, spans: str, **options) -> DataFrame:
    """Rows (keys, content, spans array<struct<start,end>>) -> one row a span with the CFI of that range."""

    def one(d: reading.Document, wanted) -> list[dict]:
        return [{"start": s["start"], "end": s["end"], "cfi": C.expression(d.cfi_for(s["start"], s["end"]))} for s in wanted or () if 0 <= s["start"] <= s["end"] <= len(d.text)]

    return map_documents(df, one, "start int, end int, cfi string", _RANGES, argument=spans, **options)


_RESOLVED = pa.schema([("cfi", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())])


def resolve_cfis(df: DataFrame, cfis: str, **options) -> DataFrame:
    """Rows (keys, content, cfis array) -> one row a CFI with its span and match; null where it leads nowhere."""

    def one(d: reading.Document, wanted) -> list[dict]:
        out = []
        for text in wanted or ():
            c = C.try_parse(text)
            at = d.resolve(c) if c else None
            out.append({"cfi": text, "start": at and at[0], "end": at and at[1], "match": at and at[2]})
        return out

    return map_documents(df, one, "cfi string, start int, end int, match string", _RESOLVED, argument=cfis, **options)


_SPAN = pa.schema([("start", pa.int32()), ("end", pa.int32()), ("partial_cfi", pa.string()), ("progression", pa.float64()), ("before", pa.string()), ("highlight", pa.string()), ("after", pa.string())])
SPAN = "start int, end int, partial_cfi string, progression double, before string, highlight string, after string"


def locators_for(df: DataFrame, spans: str, context: int = 40, **options) -> DataFrame:
    """Rows (keys, content, spans array<struct<start,end>>) -> one locator a span."""

    def one(d: reading.Document, wanted) -> list[dict]:
        return [locating.build(d, s["start"], s["end"], context=context) for s in wanted or ()]

    return map_documents(df, one, SPAN, _SPAN, argument=spans, **options)


_MATCHED = pa.schema([("query_id", pa.int64()), ("hit_start", pa.int32()), ("hit_end", pa.int32()), ("fragment", pa.string()), *_SPAN])


def locators_for_queries(df: DataFrame, queries: str, case: bool = False, diacritics: bool = False, context: int = 40, **options) -> DataFrame:
    """Rows (keys, content, queries array<struct<query_id,query>>) -> one locator a match of each query in the
    document's reading text, with the id of the last element that starts no later."""
    rule = Sensitivity(case, diacritics)

    def one(d: reading.Document, wanted) -> list[dict]:
        out = []
        folded = folding.fold(d.text, rule)
        ids = sorted((d.start[e], name) for name, e in d.ids.items())
        for q in wanted or ():
            for a, b in folding.find(folding.needle_of(q["query"], rule), folded, d.text):
                k = bisect_right(ids, a, key=lambda x: x[0])
                out.append({"query_id": q["query_id"], "hit_start": a, "hit_end": b, "fragment": ids[k - 1][1] if k else None, **locating.build(d, a, b, context=context)})
        return out

    return map_documents(df, one, f"query_id bigint, hit_start int, hit_end int, fragment string, {SPAN}", _MATCHED, argument=queries, **options)


_FROM_CFI = pa.schema([("cfi", pa.string()), *_SPAN])


def locators_for_cfis(df: DataFrame, cfis: str, context: int = 40, **options) -> DataFrame:
    """Rows (keys, content, cfis array of content CFIs) -> one locator for each that resolves; a range gives
    the text it spans as highlight, and an exact CFI is kept as it is."""

    def one(d: reading.Document, wanted) -> list[dict]:
        out = []
        for text in wanted or ():
            c = C.try_parse(text)
            if c and (at := d.resolve(c)):
                out.append({"cfi": text, **locating.build(d, at[0], at[1], c.first() if at[2] == "exact" else None, context)})
        return out

    return map_documents(df, one, f"cfi string, {SPAN}", _FROM_CFI, argument=cfis, **options)


_LADDER = pa.schema([("n", pa.int32()), ("match", pa.string()), *_SPAN])


def resolve_locators(df: DataFrame, stored: str, context: int = 40, **options) -> DataFrame:
    """Rows (keys, content, stored array<struct<fragments,progression,position,offset_of_position,
    partial_cfi,before,highlight,after>>) -> one refreshed locator for each, with n and the kind of match."""

    def one(d: reading.Document, wanted) -> list[dict]:
        out = []
        for n, row in enumerate(wanted or ()):
            found = locating.resolve(d, locating.Stored.of(row), row.get("offset_of_position"))
            out.append({"n": n, "match": found.match, **locating.build(d, found.start, found.end, found.cfi and found.cfi.first(), context)})
        return out

    return map_documents(df, one, f"n int, match string, {SPAN}", _LADDER, argument=stored, **options)
