"""A Python data source over ZIP containers: spark.read.format("epub_zip").load(path).

One row an entry (book, path, size, is_dir, method, flags, crc32, compressed_size, local_offset, content,
error). Partitions are files, packed to `partition_bytes`; only the tail and the directory of a file are read,
and members only if the option content is true. Options: content, members (a regular expression
of paths), start and end (a byte range of each member), pattern (a glob), failfast.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernels.archive import Archive
from ..kernels.errors import ERROR, BookError

SCHEMA = f"book string, path string, size bigint, is_dir boolean, method int, flags int, crc32 bigint, compressed_size bigint, local_offset bigint, content binary, error {ERROR}"
PARTITION_BYTES = 64 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def open_archive(store: fs.FileSystem, path: str) -> Archive:
    """An archive over a file that is read by range."""
    handle = store.open_input_file(path)

    def read(start: int, end: int) -> bytes:
        handle.seek(start)
        return handle.read(end - start)

    return Archive(handle.size(), read).open()


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Files]:
        store, base = _store(self.options["path"])
        info = store.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
        pattern = self.options.get("pattern", "*.epub")
        files = sorted((f for f in files if info.type == fs.FileType.File or fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.path)
        out, held, size = [], [], 0
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        for f in files:
            if held and size + f.size > most:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        wanted = re.compile(self.options.get("members", ""))
        with_content = self.options.get("content", "false") == "true"
        start, end = (int(self.options[k]) if k in self.options else None for k in ("start", "end"))
        for path in partition.paths:
            try:
                archive = open_archive(store, path)
            except BookError as error:
                if self.options.get("failfast") == "true":
                    raise
                yield (path, *[None] * 9, tuple(error.as_row().values()))
                continue
            for e in archive.entries.values():
                if not wanted.search(e.path):
                    continue
                content = error = None
                if with_content and not e.is_dir:
                    try:
                        content = archive.read(e.path, start, None if end is None else min(end, e.size))
                    except BookError as failed:
                        if self.options.get("failfast") == "true":
                            raise
                        error = tuple(failed.as_row().values())
                yield path, e.path, e.size, e.is_dir, e.method, e.flags, e.crc32, e.compressed_size, e.local_offset, content, error


class EpubZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubZip)
