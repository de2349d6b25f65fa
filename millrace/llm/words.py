"""Hashed words and word shingles of Arrow string columns, computed over whole byte buffers at once.

Words are runs of bytes outside a set of single-byte separators; A-Z count as a-z. A word's hash is 64 bits of a
polynomial over randomly valued bytes, a shingle's mixes its words' hashes in order. Different words or shingles share
a hash with odds of about n^2 / 2^65 among n of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a chunk of its own.
CHUNK = 1 << 19
_M1, _M2, _BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    return values


BYTES = _byte_values()
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    if len(_pow.get(base, ())) < n:
        steps = np.full(max(n, CHUNK + 2), base, np.uint64)
        steps[0] = 1
        _pow[base] = np.cumprod(steps)
    return _pow[base][:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the hashes' base, or of its inverse."""
    return _powers(_INVERSE if inverse else _BASE, n)


def separators(extra: str = "") -> np.ndarray:
    """Which bytes part words: space, tab to carriage return, and the ASCII characters of `extra`."""
    out = np.zeros(256, bool)
    out[[32, *range(9, 14), *extra.encode("ascii")]] = True
    return out


BLANKS = separators()


def _hashed(data: np.ndarray, lo: int, hi: int, edges: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words in bytes lo to hi; texts end at edges."""
    data, edges = data[lo:hi], edges[(edges > lo) & (edges < hi)] - lo
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * _powers(_BASE, n), out=sums[1:])
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, n)[start]), start + lo, end + lo


class Words:
    """Words of consecutive texts: hash, start and end byte in `data`; text i has words ptr[i] to ptr[i + 1]."""

    __slots__ = ("data", "offsets", "hash", "start", "end", "ptr")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = BLANKS) -> None:
        self.data, self.offsets, n = data, offsets, len(data)
        edges = offsets[(offsets > 0) & (offsets < n)]
        found = []
        lo = 0
        while lo < n or not found:
            hi = self._cut(data, lo, sep) if n - lo > 2 * CHUNK else n
            found.append(_hashed(data, lo, hi, edges, sep))
            lo = hi
        self.hash, self.start, self.end = (np.concatenate(c) for c in zip(*found)) if len(found) > 1 else found[0]
        self.ptr = np.searchsorted(self.start, offsets)

    @staticmethod
    def _cut(data: np.ndarray, lo: int, sep: np.ndarray) -> int:
        """The end of a block of about CHUNK bytes that ends between words: all of a long text at once takes 40 bytes a
        byte."""
        hi = lo + CHUNK
        while hi < len(data):
            blank = np.flatnonzero(sep[data[hi : hi + 4096]])
            if len(blank):
                return hi + int(blank[0])
            hi += 4096
        return len(data)

    def part(self, lo: int, hi: int) -> Words:
        """Words lo to hi, which are of one text, as a text of their own."""
        out = Words.__new__(Words)
        out.hash, out.ptr = self.hash[lo:hi], np.array([0, hi - lo])
        return out

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first words, ptr) of runs of n words; a text of fewer words, but some, is one run."""
        words, ptr = self.hash, self.ptr
        count = np.diff(ptr)
        total = len(words)
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        out = np.full(total, n, np.uint64)
        for j in range(n):
            out = mix(out ^ padded[j : total + j])
        valid = np.ones(total, bool)
        for j in range(1, n):
            at = ptr[1:] - j
            valid[at[at >= ptr[:-1]]] = False
        for m in range(1, n):
            at = ptr[:-1][count == m]
            short = np.full(len(at), m, np.uint64)
            for j in range(m):
                short = mix(short ^ words[at + j])
            out[at] = short
            valid[at] = True
        where = np.flatnonzero(valid)
        sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        return out[where], where, np.concatenate([[0], np.cumsum(sizes)])


def buffers(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    parts = texts.buffers()
    offsets = np.frombuffer(parts[1], np.int64 if large else np.int32) if parts[1] is not None else np.zeros(1, np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi


def chunks(texts: pa.Array, sep: np.ndarray = BLANKS) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of a string array; null texts are empty."""
    for lo, hi, data, offsets in buffers(texts):
        yield lo, hi, Words(data, offsets, sep)


def strings(texts: list) -> pa.Array:
    return pa.array(texts, pa.string())
