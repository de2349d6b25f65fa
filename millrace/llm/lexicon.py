"""Word counts by group, gathered by ranges of hashed words.

Rows (lang, source, text) are counted in two steps. Tasks count the words of their texts by (lang, source) and pack
what they have counted into one row for each range of the hashed words; each range is then merged by one task, which
sees every count of its words. A word that a third of all texts hold arrives as one number from each task, and a source
that holds a third of all rows is spread over all ranges.

Words are runs of bytes outside a set of ASCII separators, A-Z count as a-z. They are told apart by 64-bit hashes, which
a language salts (see words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import tidy

#: Counts that a task holds before it merges them.
HELD = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_GROUPS = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))
_BLOBS = ("groups", "keys", "counts", "docs", "word_keys", "sizes", "bytes")
_SCHEMA = "part int, names array<struct<lang:string,source:string>>, " + ", ".join(f"{c} binary" for c in _BLOBS)


def lang_salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), np.uint64)[0]


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(start - (ends - size), size)]


class Tally:
    """Counts (key, group, n, docs) and the spelling of each key, merged when they grow; merged, both are sorted by key."""

    def __init__(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.counts: list[tuple[np.ndarray, ...]] = []
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.distinct, self.merged = 0, 0, False

    def group(self, lang: str, source: str) -> int:
        return self.names.setdefault((lang, source), len(self.names))

    def add(self, counts: tuple[np.ndarray, ...], words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.counts.append(counts)
        self.words.append(words)
        self.rows += len(counts[0])
        self.merged = False

    def merge(self) -> None:
        if self.merged:
            return
        if not self.counts:
            empty = np.empty(0, np.int64)
            self.counts, self.words = [(empty.astype(np.uint64), empty, empty, empty)], [(empty.astype(np.uint64), empty, empty.astype(np.uint8))]
        key, group, n, docs = (np.concatenate(c) for c in zip(*self.counts))
        order = np.lexsort((group, key))
        key, group = key[order], group[order]
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])) if len(key) else order
        key, group = key[begin], group[begin]
        n, docs = (np.add.reduceat(c[order], begin) if len(begin) else c for c in (n, docs))
        names, size, data = (np.concatenate(c) for c in zip(*self.words))
        names, at = np.unique(names, return_index=True)
        self.words = [(names, size[at], slices(data, (np.cumsum(size) - size)[at], size[at]))]
        self.counts, self.rows, self.distinct, self.merged = [(key, group, n, docs)], len(key), len(key), True

    def bounded(self, most: int) -> None:
        """Merges what is held once it is more than `most` and twice what was left the last time."""
        if self.rows > max(most, 2 * self.distinct):
            self.merge()

    def clear(self) -> None:
        self.counts, self.words, self.rows, self.distinct, self.merged = [], [], 0, 0, False

    def packed(self, parts: int) -> Iterator[pa.RecordBatch]:
        """A row for each of `parts` ranges of keys that has some."""
        self.merge()
        (key, group, n, docs), (names, size, data) = self.counts[0], self.words[0]
        listed = list(self.names)
        ends = np.concatenate([[0], np.cumsum(size)])
        edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
        cut = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
        word_cut = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
        for p in np.flatnonzero(np.diff(cut)):
            a, b, c, d = cut[p], cut[p + 1], word_cut[p], word_cut[p + 1]
            present, own = np.unique(group[a:b], return_inverse=True)
            blobs = (own.astype(np.int32), key[a:b], n[a:b], docs[a:b], names[c:d], size[c:d].astype(np.int32), data[ends[c] : ends[d]])
            groups = pa.array([[dict(zip(("lang", "source"), listed[i])) for i in present]], _GROUPS)
            columns = [pa.array([p], pa.int32()), groups, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "names", *_BLOBS])
        self.clear()

    def unpack(self, batch: pa.RecordBatch) -> None:
        kinds = (np.int32, np.uint64, np.int64, np.int64, np.uint64, np.int32, np.uint8)
        for i in range(batch.num_rows):
            names = batch.column(1)[i].as_py()
            at = np.array([self.group(x["lang"], x["source"]) for x in names], np.int64)
            own, key, n, docs, word, size, data = (np.frombuffer(batch.column(2 + j)[i].as_buffer(), k) for j, k in enumerate(kinds))
            self.add((key, at[own], n, docs), (word, size.astype(np.int64), data))


def _counted(words: W.Words, group: np.ndarray, salts: np.ndarray) -> tuple[tuple, tuple]:
    """Counts and spellings of a chunk's words; group: of each text; salts: of each group's language."""
    text = np.repeat(np.arange(len(group)), np.diff(words.ptr))
    own = group[text]
    key = W.mix(words.hash ^ salts[own])
    both = W.mix(key ^ W.mix(own.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    both, text = both[order], text[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    other = new.copy()
    other[1:] |= text[1:] != text[:-1]
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(both)))
    docs = np.add.reduceat(other.astype(np.int64), begin) if len(begin) else begin
    first = order[begin]
    size = words.end[first] - words.start[first]
    return (key[first], own[first], n, docs), (key[first], size, _LOWER[slices(words.data, words.start[first], size)])


def gathered(rows: DataFrame, sep: np.ndarray, parts: int, finish: Callable[[Tally], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `finish` makes of each range's merged counts. rows: lang, source (no nulls), text (null counts as empty)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            group = np.array([tally.group(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            salts = np.array([lang_salt(lang) for lang, _ in tally.names], np.uint64)
            for lo, hi, words in W.chunks(batch.column(2), sep):
                if len(words.hash):
                    tally.add(*_counted(words, group[lo:hi], salts))
                if tally.rows > HELD:
                    tally.merge()
                    if tally.rows > HELD // 2:
                        yield from tally.packed(parts)
        yield from tally.packed(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            tally.unpack(batch)
            tally.bounded(2 * HELD)
        if tally.rows:
            tally.merge()
            yield from finish(tally)

    packed = rows.select("lang", "source", "text").mapInArrow(tidy(count), _SCHEMA)
    return packed.repartitionById(parts, "part").mapInArrow(tidy(gather), schema)


def spelled(size: np.ndarray, data: np.ndarray, chosen: np.ndarray) -> pa.Array:
    """The chosen ones of words that lie one after the other."""
    start = np.cumsum(size) - size
    size = size[chosen]
    offsets = np.concatenate([[0], np.cumsum(size)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(slices(data, start[chosen], size)))]
    return pa.Array.from_buffers(pa.large_string(), len(chosen), buffers).cast(pa.string())
