"""ZIP containers, read strictly: one disk, no ZIP64, stored or deflated members, and every statement
of a local header and data descriptor equal to the central directory's.

A source gives (length, read(start, end)). Opening reads the tail and the directory only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .errors import BookError
from .paths import archive_path

#: Fixed values of the format.
END, DIRECTORY, LOCAL, DESCRIPTOR = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08"
STORED, DEFLATED = 0, 8
_ALLOWED_FLAGS = 0x080E
_TAIL = 22 + 65535
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Limits:
    archive: int = 1 << 30
    directory: int = 16 << 20
    entries: int = 10_000
    compressed: int = 64 << 20
    entry: int = 64 << 20
    total: int = 512 << 20
    ratio: int = 1000


@dataclass(frozen=True)
class Entry:
    path: str
    raw_name: bytes
    size: int
    is_dir: bool
    method: int
    flags: int
    crc32: int
    compressed_size: int
    local_offset: int


def checked_range(length: int, start: int | None, end: int | None, kind: str = "archive", path: str | None = None) -> tuple[int, int]:
    a, b = start or 0, length if end is None else end
    if not 0 <= a <= b <= length:
        raise BookError(kind, f"range {a} to {b} is outside {length} bytes", path)
    return a, b


@dataclass
class Archive:
    length: int
    read_bytes: Callable[[int, int], bytes]
    limits: Limits = field(default_factory=Limits)
    entries: dict[str, Entry] = field(default_factory=dict)
    directory_at: int = 0
    _data_at: dict[str, int] = field(default_factory=dict)
    _verified: set[str] = field(default_factory=set)

    @classmethod
    def of_bytes(cls, data: bytes, limits: Limits | None = None) -> Archive:
        return cls(len(data), lambda a, b: data[a:b], limits or Limits()).open()

    def _fetch(self, start: int, end: int, path: str | None = None) -> bytes:
        out = self.read_bytes(start, end) if 0 <= start <= end <= self.length else b""
        if len(out) != end - start:
            raise BookError("archive", "the archive is cut short", path)
        return out

    def open(self) -> Archive:
        lim = self.limits
        if min(lim.archive - 22, lim.directory - 46, lim.entries - 1, lim.compressed, lim.entry, lim.total, lim.ratio - 1) < 0:
            raise BookError("archive", "limits are invalid")
        if not 22 <= self.length <= lim.archive:
            raise BookError("archive", "the archive is malformed or too large")
        tail_at = max(0, self.length - _TAIL)
        tail = self._fetch(tail_at, self.length)
        at = len(tail) - 22
        while at >= 0 and not (tail[at : at + 4] == END and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at = tail.rfind(END, 0, at + 3)
        if at < 0:
            raise BookError("archive", "no end of central directory")
        disk, first_disk, here, count, size, offset = struct.unpack_from("<4H2L", tail, at + 4)
        if disk or first_disk or here != count or 0xFFFF in (here, count) or 0xFFFFFFFF in (size, offset):
            raise BookError("archive", "several disks and ZIP64 are not read")
        if size > lim.directory or count > lim.entries or offset + size != tail_at + at:
            raise BookError("archive", "the central directory is out of bounds")
        self.directory_at = offset
        total, rest = 0, self._fetch(offset, offset + size)
        for _ in range(count):
            entry, rest = self._entry(rest)
            total += entry.size
            if entry.path in self.entries or total > lim.total:
                raise BookError("archive", "duplicate entry or too much content", entry.path)
            self.entries[entry.path] = entry
        if rest:
            raise BookError("archive", "bytes after the last directory entry")
        return self

    def _entry(self, data: bytes) -> tuple[Entry, bytes]:
        if len(data) < 46 or data[:4] != DIRECTORY:
            raise BookError("archive", "malformed directory entry")
        made_by, version, flags, method, _time, crc, packed, size, n_name, n_extra, n_comment, disk, _internal, external, local = struct.unpack_from("<4HL3L3H2H2L", data, 4)
        whole = 46 + n_name + n_extra + n_comment
        name = data[46 : 46 + n_name]
        if len(data) < whole or disk or version > 20 or flags & ~_ALLOWED_FLAGS or method not in (STORED, DEFLATED) or 0xFFFFFFFF in (packed, size, local):
            raise BookError("archive", "unsupported entry", name.decode("utf-8", "replace"))
        try:
            text = name.decode("utf-8")
        except UnicodeDecodeError:
            raise BookError("archive", "entry name is not UTF-8") from None
        is_dir = text.endswith("/")
        path = archive_path(text)
        kind = external >> 28 if made_by >> 8 == 3 else 0
        if kind not in (0, 4 if is_dir else 8):
            raise BookError("archive", "links and special files are not read", path)
        lim = self.limits
        if is_dir and (packed or size) or method == STORED and packed != size:
            raise BookError("archive", "entry sizes contradict each other", path)
        if packed > lim.compressed or size > lim.entry or (size > 0 and (packed == 0 or size / packed > lim.ratio)):
            raise BookError("archive", "entry passes a size limit", path)
        return Entry(path, name, size, is_dir, method, flags, crc, packed, local), data[whole:]

    def _locate(self, e: Entry) -> int:
        """Where the data starts, once the local header agrees."""
        if e.path not in self._data_at:
            head = self._fetch(e.local_offset, e.local_offset + 30, e.path)
            _version, flags, method, _time, crc, packed, size, n_name, n_extra = struct.unpack_from("<3HL3L2H", head, 4)
            at = e.local_offset + 30 + n_name + n_extra
            told = (crc, packed, size)
            right = told == (e.crc32, e.compressed_size, e.size) or (e.flags & 8 and told == (0, 0, 0))
            if head[:4] != LOCAL or flags != e.flags or method != e.method or not right or at + e.compressed_size > self.directory_at or self._fetch(e.local_offset + 30, e.local_offset + 30 + n_name, e.path) != e.raw_name:
                raise BookError("archive", "local header contradicts the directory", e.path)
            self._data_at[e.path] = at
        return self._data_at[e.path]

    def _check_descriptor(self, e: Entry, at: int) -> None:
        if e.flags & 8:
            want = struct.pack("<3L", e.crc32, e.compressed_size, e.size)
            after = self.read_bytes(at, min(at + 16, self.directory_at))
            if not (after.startswith(want) or after.startswith(DESCRIPTOR + want)):
                raise BookError("archive", "data descriptor contradicts the directory", e.path)

    def _pieces(self, e: Entry, at: int) -> Iterator[bytes]:
        """The member's content, piece by piece, never more than the directory told."""
        unpack = zlib.decompressobj(-15) if e.method == DEFLATED else None
        given = 0
        for a in range(at, at + e.compressed_size, _CHUNK):
            raw = self._fetch(a, min(a + _CHUNK, at + e.compressed_size), e.path)
            while raw:
                if unpack is None:
                    out, raw = raw, b""
                else:
                    try:
                        out = unpack.decompress(raw, max(1, min(_CHUNK, e.size - given + 1)))
                    except zlib.error as error:
                        raise BookError("archive", "can't inflate the entry", e.path) from error
                    raw = unpack.unconsumed_tail
                    if unpack.eof and (unpack.unused_data or raw):
                        raise BookError("archive", "bytes after the deflated data", e.path)
                given += len(out)
                if given > e.size:
                    raise BookError("archive", "the entry is longer than told", e.path)
                yield out
        if unpack is not None and not unpack.eof:
            raise BookError("archive", "the deflated data ends early", e.path)

    def read(self, path: str, start: int | None = None, end: int | None = None) -> bytes:
        e = self.entries.get(archive_path(path))
        if e is None or e.is_dir:
            raise BookError("archive", "no such entry", path)
        a, b = checked_range(e.size, start, end, path=e.path)
        at = self._locate(e)
        if e.path not in self._verified:
            crc, size, wanted = 0, 0, []
            for piece in self._pieces(e, at):
                crc = zlib.crc32(piece, crc)
                wanted.append(piece[max(0, a - size) : max(0, b - size)])
                size += len(piece)
            if size != e.size or crc != e.crc32:
                raise BookError("archive", "the entry fails its checks", e.path)
            self._check_descriptor(e, at + e.compressed_size)
            if e.method == STORED:
                self._verified.add(e.path)
            return b"".join(wanted)
        return self._fetch(at + a, at + b, e.path)
