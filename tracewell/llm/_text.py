"""Byte-level text kernels shared by the corpus operators.

All of them work on UTF-8 bytes, take whole texts and treat null as empty.
"""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, every other ASCII byte outside [0-9a-z] to a space; bytes >= 0x80 stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: A-Z to a-z, everything else unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(text: str | None) -> bytes:
    """The text as UTF-8; null is empty, a lone surrogate becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return utf8(text).translate(FOLD).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return utf8(text).translate(LOWER).split()


_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (SplitMix64) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Growing tables of r**k and r**-k modulo 2**64."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _R))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _R_INV))), dtype=np.uint64)


_POWERS = Powers()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles.

    Words are :func:`space_words`. With fewer than k words the whole sequence is
    the only shingle; with none the result is empty.
    """
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    n = len(flat)
    _POWERS.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _POWERS.up[:n], out=prefix[1:])
    gaps = np.flatnonzero(flat == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [n]))
    if len(starts) > k:
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix64((prefix[ends] - prefix[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64)))
