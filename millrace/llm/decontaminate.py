"""Benchmark decontamination by SimHash of item-sized windows.

For every length that a benchmark item has, windows of that many words slide over the whole text. A window's SimHash
(64 bits, words weighted by their counts) is looked up in BLOCKS tables of 16 bits each: two fingerprints within RADIUS
differ in at most RADIUS // BLOCKS bits of some block, and the tables hold every key that near each item's blocks, so
no fingerprint within the radius is missed. Candidates are verified by the exact count-weighted Jaccard similarity of
their word shingles (sum of smaller counts / sum of larger counts), which must reach p / q.

Windows that share no shingle with any item of their length have similarity 0 and aren't fingerprinted. SimHash itself
is an estimate: a window whose fingerprint lies beyond the radius is no candidate, however similar it is.

Texts are lower-cased, words end at white space and ASCII punctuation. A text shorter than an item is one window. Items with
fewer words than a shingle are one shingle; items and texts without words (or null) match nothing. Items are handled in
blocks of BLOCK_ITEMS, each sent whole to the executors: a scan of all texts for each block. Repeated rows and items give repeated results, null ids are
kept; columns besides id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import table, tidy, unused

WORDS, P, Q = 5, 80, 100
RADIUS, BLOCKS = 11, 4
#: Items and UTF-8 bytes of items that are sent to the executors at once, for one scan; words that are handled at once.
BLOCK_ITEMS, BLOCK_BYTES, BLOCK_WORDS = 16384, 64 << 20, 1 << 16
_SEP = W.separators("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SHIFT = np.uint64(42)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 for every bit of the words' hashes: (n + 1, 64)."""
    bits = np.unpackbits(np.ascontiguousarray(W.mix(hashes)).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=out[1:])
    return out


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=-1)).view(np.uint64).reshape(-1)


def _near_keys(radius: int) -> np.ndarray:
    """All 16-bit masks of at most `radius` bits."""
    return np.flatnonzero(np.bitwise_count(np.arange(65536, dtype=np.uint32)) <= radius).astype(np.uint32)


class Benchmark:
    """Items of one block: fingerprints, block tables and shingle counts."""

    def __init__(self, ids: list[int], texts: list[str], n: int = WORDS, p: int = P, q: int = Q, radius: int = RADIUS) -> None:
        self.n, self.p, self.q, self.radius = n, p, q, radius
        self.ids: list[int] = []
        self.lengths: list[int] = []
        #: Each item's distinct shingles, sorted, with their counts.
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        prints = []
        at = 0
        for _, _, words in W.chunks(W.strings(texts), _SEP):
            shingles, _, ptr = words.shingles(n)
            for i in range(len(words.ptr) - 1):
                own = words.hash[words.ptr[i] : words.ptr[i + 1]]
                if len(own):
                    self.ids.append(ids[at])
                    self.lengths.append(len(own))
                    self.counts.append(np.unique(shingles[ptr[i] : ptr[i + 1]], return_counts=True))
                    prints.append(_fingerprints(_bit_sums(own)[-1:])[0])
                at += 1
        self.prints = np.array(prints, np.uint64)
        masks = _near_keys(radius // BLOCKS)
        self.tables = []
        for b in range(BLOCKS):
            keys = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint32)
            near = (keys[:, None] ^ masks[None]).reshape(-1)
            items = np.repeat(np.arange(len(keys)), len(masks)).astype(np.int32)
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange(65537))
            self.tables.append((starts.astype(np.int64), items[order]))
        #: shingle -> lengths of the items that have it, in arrays, with a first table of the shingles' top bits.
        every = np.concatenate([k for k, _ in self.counts]) if self.counts else np.empty(0, np.uint64)
        lengths = np.repeat(self.lengths, [len(k) for k, _ in self.counts]).astype(np.int64)
        order = np.lexsort((lengths, every))
        every, lengths = every[order], lengths[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (lengths[1:] != lengths[:-1])
        every, self.key_lengths = every[new], lengths[new]
        self.keys, first = np.unique(every, return_index=True)
        self.key_ptr = np.append(first, len(every))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> _SHIFT] = True
        self.short = sorted({m for m in self.lengths if m < n})

    def _hits(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item length) of the shingles shared with items, a shingle of m < n words as such. A long text is
        read in blocks."""
        firsts, sizes = [], []
        total = len(words.hash)
        for m in [self.n, *self.short]:
            step = BLOCK_WORDS if len(words.ptr) == 2 and total > BLOCK_WORDS + m else max(1, total)
            for lo in range(0, total - m + 1 if step < total else 1, step):
                part = words.part(lo, min(total, lo + step + m - 1)) if step < total else words
                shingles, where, _ = part.shingles(m)
                at = np.flatnonzero(self.maybe[shingles >> _SHIFT])
                k = np.searchsorted(self.keys, shingles[at])
                real = self.keys[np.minimum(k, len(self.keys) - 1)] == shingles[at] if len(self.keys) else np.zeros(len(at), bool)
                at, k = at[real], k[real]
                held = self.key_ptr[k + 1] - self.key_ptr[k]
                inner = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
                length = self.key_lengths[np.repeat(self.key_ptr[k], held) + inner]
                fits = (length < self.n) == (m < self.n)
                firsts.append(np.repeat(where[at] + lo, held)[fits])
                sizes.append(length[fits])
        return np.concatenate(firsts), np.concatenate(sizes)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, each once."""
        pairs = []
        for b, (starts, items) in enumerate(self.tables):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            count = starts[key + 1] - starts[key]
            window = np.repeat(np.arange(len(prints)), count)
            inner = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            item = items[np.repeat(starts[key], count) + inner]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            pairs.append(window[near] * len(self.prints) + item[near])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.prints), both % len(self.prints)

    def similar(self, shingles: np.ndarray, item: int) -> float | None:
        """Count-weighted Jaccard similarity of a window's shingles with an item, if it reaches p / q."""
        mine, held = np.unique(shingles, return_counts=True)
        theirs, counts = self.counts[item]
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        common = int(np.minimum(held, counts[at])[theirs[at] == mine].sum())
        total = int(held.sum() + counts.sum()) - common
        return common / total if self.q * common >= self.p * total else None

    def matches(self, words: W.Words) -> dict[int, dict[int, tuple[float, int, int]]]:
        """text -> item -> (similarity, first word, word after the last) of its best window, the first among equals.

        Windows are fingerprinted around hits only, in blocks of at most BLOCK_WORDS starts."""
        firsts, sizes = self._hits(words)
        out: dict[int, dict[int, tuple[float, int, int]]] = {}
        for m in np.unique(sizes).tolist():
            first = firsts[sizes == m]
            text = np.searchsorted(words.ptr, first, "right") - 1
            lo, hi = words.ptr[text], words.ptr[text + 1]
            begin = np.where(hi - lo > m, np.maximum(lo, first + min(self.n, m) - m), lo)
            end = np.where(hi - lo > m, np.minimum(first, hi - m), lo)
            marks = np.zeros(len(words.hash) + 1, np.int32)
            np.add.at(marks, begin, 1)
            np.add.at(marks, end + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks) > 0)
            del marks
            text = np.searchsorted(words.ptr, starts, "right") - 1
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (np.diff(starts) > m) | (np.diff(text) > 0)
            bounds = np.append(np.flatnonzero(fresh), len(starts))
            for a, b in zip(bounds, bounds[1:]):
                for c in range(int(a), int(b), BLOCK_WORDS):
                    self._judge(words, int(text[a]), starts[c : min(int(b), c + BLOCK_WORDS)], m, out)
        return out

    def _judge(self, words: W.Words, text: int, starts: np.ndarray, m: int, out: dict) -> None:
        lo, hi = int(starts[0]), min(int(starts[-1]) + m, int(words.ptr[text + 1]))
        sums = _bit_sums(words.hash[lo:hi])
        a = starts - lo
        b = np.minimum(a + m, hi - lo)
        window, item = self.candidates(_fingerprints(sums[b] - sums[a]))
        k = min(self.n, m)
        shingles = None
        for w, i in zip(window.tolist(), item.tolist()):
            if self.lengths[i] != m:
                continue
            if shingles is None:
                shingles = words.part(lo, hi).shingles(k)[0]
            similarity = self.similar(shingles[a[w] : a[w] + max(1, int(b[w] - a[w]) - k + 1)], i)
            if similarity is not None:
                base = lo - int(words.ptr[text])
                new = (similarity, base + int(a[w]), base + int(b[w]))
                best = out.setdefault(text, {})
                old = best.get(i)
                if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                    best[i] = new


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, **options) -> Iterator[Benchmark]:
    """The items in blocks of a bounded size, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.lower(text_col)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") * 4
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Benchmark(ids, texts, **options)
            ids, texts, size = [], [], 0
    if ids:
        yield Benchmark(ids, texts, **options)


def find_contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word): a row for each text and item that matches."""
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("text"))

    def scan(items: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for lo, _, words in W.chunks(batch.column(1), _SEP):
                    for text, found in items.matches(words).items():
                        out += [(ids[lo + text], items.ids[i], *m) for i, m in found.items()]
                if out:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        return rows.mapInArrow(tidy(run), schema)

    out = None
    for items in _blocks(benchmark, item_col, "text", **options):
        found = scan(items)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """The rows of df whose text matches no item. Rows are filtered where they lie."""
    lower = unused(df, "_millrace_lower")
    for items in _blocks(benchmark, item_col, "text", **options):

        def run(batches: Iterator[pa.RecordBatch], items: Benchmark = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, words in W.chunks(batch.column(lower), _SEP):
                    keep[[lo + t for t in items.matches(words)]] = False
                yield batch.drop_columns([lower]).filter(pa.array(keep))

        df = df.withColumn(lower, F.lower(text_col)).mapInArrow(tidy(run), df.schema)
    return df


def op8(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
