"""WARC: a deterministic sharded writer and its reader.

Records are dealt to shards by ranges of (key, digest, uri), cut at quantiles of the payload bytes, and
each shard is written in key order. A shard rolls to a new file when the compressed bytes reach
`roll_bytes`, by default an eighth of a shard's uncompressed size. Headers, ids and digests are made anew from key and payload, the date is a
parameter, and every record is a gzip member of its own, so equal input gives equal files.

A task writes under temporary names that no other attempt uses and returns what it wrote. Only
after all tasks have returned, a second job renames the files of those rows (again without harm if
it is repeated), and last the manifest is written; readers see the files that it lists, and nothing
where it is missing. Files of lost attempts are never listed and go with the temporary folder.

Equal payloads of at least `least_revisit` bytes are kept once: the record with the largest key is
a response, the others are revisits that refer to it. Which ones they are is aggregated from
digests; payloads are shuffled once, to the shards.

Defined results: a null payload is empty, a null uri has no WARC-Target-URI; a null key sorts
first and never is what others refer to, unless all keys of its group are null (then all are
responses); repeated rows with the largest key are all responses; an empty table gives a manifest
without files; line breaks in a uri are percent-encoded; one payload is held in memory at a time,
with its copies about four times its size. Keys are any 64-bit integers; records of one key, or of none,
spread over shards by digest and uri, only records that are equal in all three stay together.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, forget, small_batches, tracked

#: Uncompressed bytes of a shard at least, and shards at most (then shards are larger).
SHARD_BYTES, MOST_SHARDS = 32 << 20, 20_000
#: Files roll at a shard's uncompressed bytes over this.
ROLL_SHARE = 8
#: Weights by which the cuts between shards are found, a shard.
CUTS_A_SHARD = 16
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
_ROWS = "key bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_MANIFEST = "shard int, file int, name string, temporary string, bytes bigint, records bigint, sha1 string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, uri: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([key, uri, digest]))}>"


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _uri(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")


def record(key: int | None, uri: str | None, payload: bytes, refers: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit of an equal payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, uri, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(uri)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Key", None if key is None else str(key)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", str(refers))]
    return _member(headers, block)


class _Shard:
    """Rolls the files of one shard."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, roll: int, date: str):
        self.store, self.folder, self.shard, self.roll, self.date = store, folder, shard, roll, date
        self.files, self.out = 0, None

    def add(self, member: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.shard:05d}-{self.files:04d}-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.records, self.sha = 0, -1, hashlib.sha1()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.shard, None, str(self.files))), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        if self.size >= self.roll:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.shard, self.files, f"part-{self.shard:05d}-{self.files:04d}.warc.gz", self.temporary, self.size, self.records, self.sha.hexdigest()
            self.files += 1


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "file", "name", "temporary", "bytes", "records", "sha1"])


def _writer(folder: str, roll: int, date: str):
    """Rows sorted by (shard, key, digest, kind): a kind 0 row tells what the equal rows after it revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple] = []
        shard, told = None, (None, None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                number, key, digest, kind, uri, payload, refers = (batch.column(c)[i].as_py() for c in range(7))
                if kind == 0:
                    told = (key, digest, refers)
                    continue
                if shard is None or shard.shard != number:
                    done += shard.close() if shard else ()
                    shard = _Shard(store, base, number, roll, date)
                revisit = told[:2] == (key, digest)
                done += shard.add(record(key, uri, payload, told[2], revisit, date))
        done += shard.close() if shard else ()
        yield _manifest_batch(done)

    return run


def _rename(temporary: str, final: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, source = _store(temporary)
        _, target = _store(final)
        store.create_dir(target, recursive=True)
        for batch in batches:
            for name, old, size in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                there = store.get_file_info(f"{target}/{name}")
                if there.type == fs.FileType.NotFound or there.size != size:
                    store.move(f"{source}/{old}", f"{target}/{name}")
            yield batch

    return run


def _sorted_as(key: Column, *rest: Column) -> Column:
    """A string that sorts like (key, rest), a null key first."""
    number = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0")), *rest)


def _cuts(small: DataFrame, shard_bytes: int) -> tuple[list[str], int]:
    """Where (key, digest, uri) is cut between shards, and the bytes meant for a shard. A record is drawn
    with a chance that grows with its bytes, by a hash of itself: about CUTS_A_SHARD strings a shard
    reach the driver, the same in every run."""
    total = small.agg(F.sum("w")).first()[0] or 0
    shard_bytes = max(shard_bytes, total // MOST_SHARDS)
    step = max(1, shard_bytes // CUTS_A_SHARD)
    chance = F.pmod(F.xxhash64("key", "digest", "uri"), F.lit(1 << 30)) / float(1 << 30)
    drawn = small.where(chance < F.col("w") / step).select("at", F.greatest("w", F.lit(step)).alias("w")).collect()
    cuts, held = [], 0
    for at, w in sorted((r["at"], r["w"]) for r in drawn):
        if held and held + w > shard_bytes:
            if not cuts or at > cuts[-1]:
                cuts.append(at)
            held = 0
        held += w
    return cuts, shard_bytes


def _shard(cuts: list[str]):
    @F.pandas_udf("int")
    def shard(at: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in at], dtype="int32")

    return shard


def write_warc(rows: DataFrame, path: str, key: str, uri: str, payload: Column, least_revisit: int = LEAST_REVISIT, roll_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> None:
    """Write one record a row to `path`, a new folder that all executors reach."""
    spark = rows.sparkSession
    small_batches(spark)
    data = rows.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    data = data.withColumn("digest", F.sha1("payload"))
    named_uri = F.coalesce("uri", F.lit(""))
    with tracked() as passed:
        size = F.octet_length("payload").cast("long")
        small = cut(data.select("key", "digest", "uri", size.alias("n"), (size + 600).alias("w"), F.xxhash64("payload").alias("check"), _sorted_as(F.col("key"), F.col("digest"), named_uri).alias("at")), "digests")
        first = small.where(F.col("n") >= least_revisit).groupBy("digest", "n", "check").agg(F.max("key").alias("refers"), F.count("*").alias("rows")).where("rows > 1 and refers is not null")
        told = small.join(first.select("digest", "n", "check", "refers"), ["digest", "n", "check"]).where("key is null or key < refers").select("key", "digest", "refers").distinct()

        cuts, shard_bytes = _cuts(small, shard_bytes)
        shard = _shard(cuts)
        records = data.select(shard(_sorted_as(F.col("key"), F.col("digest"), named_uri)).alias("shard"), "key", "digest", F.lit(1).alias("kind"), "uri", "payload", F.lit(None).cast("long").alias("refers"))
        # A note goes to every shard that holds records of its key and digest, nearly always one.
        ends = told.withColumn("lo", shard(_sorted_as(F.col("key"), F.col("digest")))).withColumn("hi", shard(_sorted_as(F.col("key"), F.col("digest"), F.lit("\U0010ffff"))))
        notes = ends.select(F.explode(F.sequence("lo", "hi")).alias("shard"), "key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), "refers")
        dealt = records.union(notes).repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "key", "digest", "kind", "uri")
        written = cut(dealt.mapInArrow(_writer(f"{path}/temporary", roll_bytes or max(1, shard_bytes // ROLL_SHARE), date), _MANIFEST), "written")
        named = cut(written.mapInArrow(_rename(f"{path}/temporary", f"{path}/data"), _MANIFEST), "named")
    named.drop("temporary").orderBy("shard", "file").coalesce(1).write.json(f"{path}/manifest")
    forget(spark, passed)


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one at a time, read in pieces."""
    piece, out, unpack = stream.read(1 << 20), io.BytesIO(), zlib.decompressobj(31)
    while piece:
        out.write(unpack.decompress(piece))
        if unpack.eof:
            yield out.getvalue()
            piece, out, unpack = unpack.unused_data, io.BytesIO(), zlib.decompressobj(31)
        else:
            piece = b""
        piece = piece or stream.read(1 << 20)
    if out.getvalue():
        raise ValueError("the file ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["key", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        headers, block = parse(member)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(headers["X-Payload-Length"])
                        if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"a payload in {name} does not have its digest")
                        number = lambda h: None if headers.get(h) is None else int(headers[h])
                        rows.append((number("X-Key"), headers.get("WARC-Target-URI"), kind, number("X-Refers-To-Key"), size, digest, payload))
                        held += len(member)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest of `path` lists; payload is null for revisits."""
    files = spark.read.schema("name string, bytes bigint").json(f"{path}/manifest")
    n = max(1, files.count())
    return files.select("name").repartition(min(n, 100_000)).mapInArrow(_reader(f"{path}/data"), _ROWS)

