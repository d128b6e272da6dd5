"""UTF-16 code units. Offsets of texts count them everywhere, so kernels work on unit strings:
strings whose every character is one unit, an astral character being its two surrogates."""

from __future__ import annotations

import numpy as np


def to_units(text: str) -> str:
    if not text or max(text) < "\U00010000":
        return text
    pairs = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return pairs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def from_units(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in units) else units


def length16(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def is_high(c: str) -> bool:
    return "\ud800" <= c <= "\udbff"


def is_low(c: str) -> bool:
    return "\udc00" <= c <= "\udfff"
