"""Font obfuscation: the first bytes of a font are XORed with a key made from the book's identifier."""

from __future__ import annotations

import hashlib
import re

from .errors import BookError

#: Algorithm -> (name, bytes that are changed).
ALGORITHMS = {"http://www.idpf.org/2008/embedding": ("idpf", 1040), "http://ns.adobe.com/pdf/enc#RC": ("adobe", 1024)}
_UUID = re.compile(r"\s*(?:urn:uuid:)?([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})\s*", re.I)


def key_of(algorithm: str, identifier: str | None, path: str | None = None) -> tuple[bytes, int]:
    if algorithm not in ALGORITHMS:
        raise BookError("resource", "unsupported encryption", path)
    if not identifier:
        raise BookError("resource", "font obfuscation without a book identifier", path)
    name, length = ALGORITHMS[algorithm]
    if name == "idpf":
        return hashlib.sha1(re.sub("[ \t\r\n]", "", identifier).encode()).digest(), length
    m = _UUID.fullmatch(identifier)
    if not m:
        raise BookError("resource", "this obfuscation needs a UUID identifier", path)
    return bytes.fromhex(m[1].replace("-", "")), length


def reveal(data: bytes, algorithm: str, identifier: str | None, start: int = 0, path: str | None = None) -> bytes:
    """Bytes from offset `start` of an obfuscated font, in clear."""
    key, length = key_of(algorithm, identifier, path)
    changed = max(0, min(len(data), length - start))
    mask = (key * (length // len(key) + 2))[start % len(key) :][:changed]
    head = int.from_bytes(data[:changed], "big") ^ int.from_bytes(mask, "big")
    return head.to_bytes(changed, "big") + data[changed:]
