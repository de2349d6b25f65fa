"""Phrase collocation mining.

Words that occur `least` times or more in their language get dense numbers; all other words break a piece of text, since
no frequent phrase holds them. Every place of a run of numbered words gives one key of fixed width: the numbers of the
five words from there on, zeros behind the run's end. A task packs its keys, sorts them by radix (16 bits a pass) and
counts runs of equal ones; what is left is range-partitioned by splitters and radix-sorted once more, and as keys are in
order, runs of equal prefixes count the phrases of two, three, four and five words alike. Prefixes at a range's borders
are summed over ranges. Splitters come from a bounded sample of texts: they spread work and decide nothing else.

A candidate's score floor(1000 a n / (l r)) is that of its weakest cut; sums and products run in decimals of 38 digits.
A candidate that a longer one contains with as many occurrences (`percent` of them) is dropped. Ranks go to `top` in each
language, by score and occurrences descending, then the phrase.

A null text is empty, a null language `und`. A-Z count as a-z; other columns (ids too) are ignored, so repeated rows
count as often as they occur. A table without a frequent phrase, or an empty one, gives no rows. Words are told apart by
64-bit hashes while they are counted (see words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from . import words as W
from .common import discard, materialise, table, text_of, tidy

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
PIECE_ENDS = ".,;:!?"
_SEP = W.separators(PIECE_ENDS)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 11, 12, 13, *PIECE_ENDS.encode("ascii")]] = True
#: Numbered words that are sent to every task (24 bytes each); more are joined to the words of the texts.
DICTIONARY_ROWS = 2_000_000
#: Keys that a task holds before it counts them.
HELD = 2_000_000
#: Bytes of text for a range of keys.
RANGE_BYTES = 16 << 20
#: Texts sampled for splitters, their bytes at most, and keys of each.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_KEYS = 4096, 1 << 17, 64


def _frequent(least: int) -> Callable[[lexicon.Tally], Iterator[pa.RecordBatch]]:
    """Rows (lang, word, key, n) of frequent words, and (lang, null, null, n) of all words of a range."""

    def finish(tally: lexicon.Tally) -> Iterator[pa.RecordBatch]:
        (key, group, n, _), (_, size, data) = tally.counts[0], tally.words[0]
        langs = [lang for lang, _ in tally.names]
        chosen = np.flatnonzero(n >= least)
        names = ["lang", "word", "key", "n"]
        if len(chosen):
            lang = pa.array(langs).take(pa.array(group[chosen]))
            word = lexicon.spelled(size, data, chosen)
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(key[chosen].view(np.int64)), pa.array(n[chosen])], names=names)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.diff(group[order], prepend=-1))
        sums = np.add.reduceat(n[order], begin)
        lang = pa.array([langs[g] for g in group[order][begin]], pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.nulls(len(begin), pa.string()), pa.nulls(len(begin), pa.int64()), pa.array(sums)], names=names)

    return finish


def dictionary(words: DataFrame) -> DataFrame:
    """words (lang, word, key, n) with dense numbers from 1, a written table."""
    told = materialise(words.withColumn("m", F.monotonically_increasing_id()), "frequent-words")
    parts = told.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = parts.select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    at = (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("base") + 1).cast("int")
    out = materialise(told.withColumn("p", F.shiftright("m", 33)).join(parts, "p").select("lang", "word", "key", "n", at.alias("id")), "dictionary")
    discard(told)
    return out


def _breaks(words: W.Words) -> np.ndarray:
    """Where a word begins a text or a piece."""
    out = np.zeros(len(words.hash), bool)
    if len(out):
        out[words.ptr[:-1][np.diff(words.ptr) > 0]] = True
        seen = np.concatenate([[0], np.cumsum(_ENDS[words.data], dtype=np.int64)])
        out[1:] |= seen[words.start[1:]] > seen[words.end[:-1]]
    return out


def _salted(batch: pa.RecordBatch) -> Iterator[tuple[W.Words, np.ndarray]]:
    """(words, their keys in the dictionary) of chunks of a batch of (lang, text)."""
    salts: dict[str, np.uint64] = {}
    langs = batch.column(0).to_pylist()
    salt = np.array([salts.setdefault(x, lexicon.lang_salt(x)) for x in langs], np.uint64)
    for lo, hi, words in W.chunks(batch.column(1), _SEP):
        yield words, W.mix(words.hash ^ np.repeat(salt[lo:hi], np.diff(words.ptr)))


def _run_of(numbers: np.ndarray, begin: np.ndarray) -> bytes:
    """Numbers of words in order; a zero is a break: an infrequent word, or one put in where a piece begins."""
    return np.insert(numbers, np.flatnonzero(begin), 0).astype(np.int32).tobytes()


def encoder(known: DataFrame, most: int = DICTIONARY_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A function from rows (lang, text) to rows (numbers): the dictionary's numbers of the words, zeros between runs.

    A dictionary of at most `most` rows is sent to the tasks. With more, words are joined to it one by one and gathered
    again by the chunk that they come from."""
    if known.count() <= most:
        held = known.select("key", "id").toArrow()
        keys, ids = (held.column(i).to_numpy() for i in (0, 1))
        keys = keys.astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order].astype(np.int32)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words, key in _salted(batch) if len(keys) else ():
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    numbers = np.where(keys[at] == key, ids[at], 0)
                    yield pa.RecordBatch.from_arrays([pa.array([_run_of(numbers, _breaks(words))], pa.binary())], names=["numbers"])

        return lambda rows: rows.select("lang", "text").mapInArrow(tidy(coded), "numbers binary")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for words, key in _salted(batch):
                block = pa.array(np.full(len(key), number, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [block, pa.array(np.arange(len(key), dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(_breaks(words))],
                    names=["block", "place", "key", "begin"],
                )
                number += 1

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.argsort(batch.column(0)[i].values.field(0).to_numpy())
                numbers, begin = (batch.column(0)[i].values.field(j).to_numpy(zero_copy_only=False)[at] for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([_run_of(numbers, begin)], pa.binary())], names=["numbers"])

    def joined(rows: DataFrame) -> DataFrame:
        each = rows.select("lang", "text").mapInArrow(tidy(spread), "block int, place int, key long, begin boolean")
        each = materialise(each.withColumn("task", F.spark_partition_id()), "words")
        found = each.join(known.select("key", "id"), "key", "left")
        listed = found.groupBy("task", "block").agg(F.collect_list(F.struct("place", F.coalesce("id", F.lit(0)).alias("id"), "begin")).alias("w"))
        return listed.select("w").mapInArrow(tidy(together), "numbers binary")

    return joined


def windows(numbers: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """A column for each place with a word behind it in its run: `longest` numbers from there, zeros after the run."""
    padded = np.concatenate([numbers, np.zeros(longest, numbers.dtype)])
    at = np.flatnonzero((padded[: len(numbers)] > 0) & (padded[1 : len(numbers) + 1] > 0))
    out = np.zeros((longest, len(at)), np.uint32)
    live = np.ones(len(at), bool)
    for j in range(longest):
        live &= padded[at + j] > 0
        out[j] = np.where(live, padded[at + j], 0)
    return out


def packed(columns: np.ndarray, width: int) -> np.ndarray:
    """Keys as rows of 16-bit digits, most significant first: width digits a number."""
    if width == 1:
        return columns.astype(np.uint16)
    return np.stack([half for c in columns for half in ((c >> 16).astype(np.uint16), (c & 0xFFFF).astype(np.uint16))])


def radix_runs(digits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted, each once, with the sums of their counts. A stable sort of 16-bit digits is a counting sort."""
    order = np.argsort(digits[-1], kind="stable")
    for digit in digits[-2::-1]:
        order = order[np.argsort(digit[order], kind="stable")]
    digits = digits[:, order]
    new = np.ones(digits.shape[1], bool)
    new[1:] = (digits[:, 1:] != digits[:, :-1]).any(axis=0)
    begin = np.flatnonzero(new)
    return digits[:, begin], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]


def _heads(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first four digits and the next four, as numbers."""
    out = []
    for part in (digits[:4], digits[4:8]):
        value = np.zeros(digits.shape[1], np.uint64)
        for digit in part:
            value = value << np.uint64(16) | digit.astype(np.uint64)
        out.append(value)
    return out[0], out[1]


def parts_of(digits: np.ndarray, splitters: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted splitters each sorted key reaches."""
    first, second = _heads(digits)
    cuts = [np.array([s[i] for s in splitters], np.uint64) for i in (0, 1)]
    out = np.searchsorted(cuts[0], first, "left")
    upper = np.searchsorted(cuts[0], first, "right")
    for value in np.unique(first[out < upper]):  # at most as many as splitters
        at = slice(*(int(np.searchsorted(first, value, side)) for side in ("left", "right")))
        lo, hi = out[at.start], upper[at.start]
        out[at] = lo + np.searchsorted(cuts[1][lo:hi], second[at], "right")
    return out


class _Keys:
    """Keys and their counts, combined when many are held."""

    def __init__(self, n_digits: int) -> None:
        self.held, self.rows, self.n_digits, self.distinct = [], 0, n_digits, 0

    def bounded(self, most: int) -> None:
        """Combines what is held once it is more than `most` and twice what was left the last time: a range of many
        distinct keys is sorted as often as it doubles, not with every blob that comes."""
        if self.rows > max(most, 2 * self.distinct):
            self.combined()

    def add(self, digits: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((digits, counts))
        self.rows += len(counts)

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            digits, counts = np.concatenate([d for d, _ in self.held], axis=1), np.concatenate([c for _, c in self.held])
        else:
            digits, counts = np.empty((self.n_digits, 0), np.uint16), np.empty(0, np.int64)
        digits, counts = radix_runs(digits, counts)
        self.held, self.rows, self.distinct = [(digits, counts)], len(counts), len(counts)
        return digits, counts

    def clear(self) -> None:
        self.held, self.rows, self.distinct = [], 0, 0


def _splitters(coded: DataFrame, width: int, parts: int) -> list[tuple[int, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                digits = packed(windows(np.frombuffer(blob.as_buffer(), np.int32)), width)
                step = max(1, digits.shape[1] // SAMPLE_KEYS)
                a, b = _heads(digits[:, ::step])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held = coded.mapInArrow(tidy(run), "a long, b long").toArrow()
    a, b = (held.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.unique(np.arange(1, parts) * len(a) // parts) if len(a) else []
    return sorted({(int(a[i]), int(b[i])) for i in at})


def phrase_counts(coded: DataFrame, width: int, splitters: list[tuple[int, int]], least: int = LEAST) -> DataFrame:
    """(ids array<int>, a): phrases of 2 to LONGEST numbered words that occur `least` times or more."""
    size = LONGEST * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(size)

        def dealt() -> Iterator[pa.RecordBatch]:
            digits, counts = keys.combined()
            edges = np.searchsorted(parts_of(digits, splitters), np.arange(len(splitters) + 2))
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                blobs = (np.ascontiguousarray(digits[:, a:b]), counts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names=["part", "keys", "counts"])
            keys.clear()

        for batch in batches:
            for blob in batch.column(0):
                digits = packed(windows(np.frombuffer(blob.as_buffer(), np.int32)), width)
                keys.add(digits, np.ones(digits.shape[1], np.int64))
                if keys.rows > HELD:
                    keys.combined()
                    if keys.rows > HELD // 2:
                        yield from dealt()
        yield from dealt()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(size)
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                keys.add(np.frombuffer(batch.column(1)[i].as_buffer(), np.uint16).reshape(size, -1), counts)
                keys.bounded(2 * HELD)
        digits, counts = keys.combined()
        if not len(counts):
            return
        numbers = digits.astype(np.int32) if width == 1 else digits[::2].astype(np.int32) << 16 | digits[1::2].astype(np.int32)
        new = np.zeros(len(counts), bool)
        new[0] = True
        for m in range(1, LONGEST + 1):
            new[1:] |= numbers[m - 1, 1:] != numbers[m - 1, :-1]
            if m == 1:
                continue
            begin = np.flatnonzero(new)
            sums, prefix = np.add.reduceat(counts, begin), numbers[:m, begin]
            kept = sums >= least
            kept[[0, -1]] = True  # other ranges may hold more of these
            kept &= prefix[m - 1] > 0
            ids = pa.ListArray.from_arrays(pa.array(np.arange(kept.sum() + 1, dtype=np.int32) * m), pa.array(prefix[:, kept].T.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sums[kept])], names=["ids", "a"])

    moved = coded.mapInArrow(tidy(count), "part int, keys binary, counts binary").repartitionById(len(splitters) + 1, "part")
    out = moved.mapInArrow(tidy(gather), "ids array<int>, a long")
    return out.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _wide(c: str) -> Column:
    return F.col(c).cast(T.DecimalType(19, 0))


def scored(grams: DataFrame, known: DataFrame, totals: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of grams (ids, a) that no longer one replaces. known: id, lang, word, n; totals:
    lang, n."""
    every = grams.select("ids", "a").unionByName(known.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    size = F.size("ids")
    inner = F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m)))
    parts = grams.where(size > 2).select("a", F.explode(F.flatten(inner)).alias("ids"))
    parts = parts.groupBy("ids").agg(F.max("a").alias("longer"))
    kept = grams.join(parts, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    words = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(known.select("id", "lang", "word"), "id")
    words = words.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    words = words.select("ids", "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    kept = kept.drop("longer").join(words, "ids").join(totals, "lang")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    above, below = (F.col("a") * 1000).cast(T.DecimalType(19, 0)) * _wide("n"), _wide("l") * _wide("r")
    cuts = cuts.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    out = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest)
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, percent: int = PERCENT, dictionary_rows: int = DICTIONARY_ROWS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.lit("").alias("source"), text_of(text_col).alias("text"))
    texts, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Ranges grow in number with the texts, so none grows in size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    counted = materialise(lexicon.gathered(rows, _SEP, parts, _frequent(least), "lang string, word string, key long, n long"), "word-counts")
    totals = counted.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    known = dictionary(counted.where("word IS NOT NULL"))
    width = 1 if known.count() < 1 << 16 else 2
    code = encoder(known, dictionary_rows)
    share = min(1.0, SAMPLE_DOCS / max(1, texts))
    chosen = rows.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))).distinct()
    grams = materialise(phrase_counts(code(rows), width, _splitters(code(chosen), width, parts), least), "phrases")
    found = scored(grams, known, totals, percent)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m)
), f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100),
longer AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS a FROM (
    SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m > 2)) GROUP BY ALL
), kept AS (SELECT c.* FROM cand c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase WHERE g.a IS NULL OR 100 * g.a < 100 * c.a),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
scores AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') AND l.m = k
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ') AND r.m = c.m - k JOIN total t ON t.lang = c.lang
), weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
