"""Vectorised word hashing shared by the operators that work on words.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. All functions work on a
*chunk*: the texts of a few documents joined by a newline, at most
``CHUNK_BYTES`` long unless a single text is longer. Hashes are 64-bit
polynomial hashes of the bytes, finished with a bit mixer, so a word's hash
depends on its bytes only, never on its place in a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=_U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** (0..n-1)`` modulo 2**64 (kept and grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, _U(base % (1 << 64)), _U)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher (xor-shift and odd multiplications)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_INVERSE = pow(_BASE, -1, 1 << 64)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive uint64 values."""
    if len(values) < width:
        return np.empty(0, _U)
    total = np.empty(len(values) + 1, _U)
    total[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(_INVERSE, len(values) - width + 1))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair of bounds."""
    total = np.empty(len(values) + 1, _U)
    total[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(values) + 1)[start]
               + (end - start).astype(_U))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in order, in lists of about ``limit`` bytes."""
    out: list[bytes] = []
    size = 0
    for t in texts:
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield out
            out, size = [], 0
        out.append(b)
        size += len(b) + 1
    if out:
        yield out


class Words:
    """Words of a chunk: byte bounds ``start``/``end``, and ``first``: index of
    the first word of each document, with the total number of words last."""

    def __init__(self, docs: list[bytes], lower: bool = False):
        joined = b"\n".join(docs) + b"\n"
        if lower:
            joined = joined.lower()  # of bytes: A-Z only
        self.raw = joined
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, begin)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.data], self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
