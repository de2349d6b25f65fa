"""Source divergence audit by dense term blocks.

Terms are runs of letters A-Z, a-z (one case) and characters beyond ASCII. Each language keeps the V terms that at least
`least` of its documents hold. Its groups (sources) are rows and its kept terms columns of a matrix of counts. Ranges of
hashed terms give blocks of columns, and neighbouring blocks are laid together until they hold TERMS terms, so how many
there are depends on the terms alone. With GROUPS groups such a block is a dense numpy int64 tile: smoothed shares
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), all pairs of its groups by broadcasting, f = floor((p - q)^2 / (p + q)).
Partial pair sums of the blocks are added up, and each group's heap of its `top` terms above the language's own share is
merged from those of the blocks.

Null text, language and source read as ''. A group without terms has counts of 0; a language without kept terms has pair
values of 0 and no term rows. Repeated rows are documents of their own, other columns are ignored, an empty table gives
no rows. Shares are exact while a group's counts N + 2 V stay below 9 * 10^15.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon
from .common import discard, materialise, table, text_of

LEAST, TOP = 10, 10
#: Terms and groups of a tile.
TERMS, GROUPS = 4096, 128
_SEP = np.zeros(256, bool)
_SEP[:128] = True
_SEP[65:91] = _SEP[97:123] = False
_BLOCK = "lang string, block long, source string, n long, at binary, counts binary, terms array<string>"
_KINDS = {"lang": pa.string(), "block": pa.int64(), "source": pa.string(), "n": pa.int64(), "at": pa.binary(), "counts": pa.binary(), "terms": pa.list_(pa.string())}


def _blocks(least: int, width: int) -> Callable[[lexicon.Tally], Iterator[pa.RecordBatch]]:
    """For each block of kept terms a row of the terms (source null) with their counts in the language, and a row for
    each source that holds some: columns `at` and their counts."""

    def finish(tally: lexicon.Tally) -> Iterator[pa.RecordBatch]:
        (key, group, n, docs), (_, size, data) = tally.counts[0], tally.words[0]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        kept = np.add.reduceat(docs, begin) >= least
        listed = list(tally.names)
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in listed))}
        lang_of = np.array([langs[lang] for lang, _ in listed])
        own = lang_of[group[begin]]  # keys are salted by language
        for lang, i in langs.items():
            chosen = np.flatnonzero(kept & (own == i))
            for lo in range(0, len(chosen), width):
                some = chosen[lo : lo + width]
                # Blocks are named by their first key: ranges don't share keys.
                name = int(key[begin[some[0]]].view(np.int64))
                place = np.full(len(begin), -1, np.int32)
                place[some] = np.arange(len(some))
                rows = np.flatnonzero(place[word] >= 0)
                at, held, of = place[word[rows]], n[rows], group[rows]
                totals = np.zeros(len(some), np.int64)
                np.add.at(totals, at, held)
                out = [(lang, name, None, int(totals.sum()), None, totals.tobytes(), lexicon.spelled(size, data, some).to_pylist())]
                order = np.argsort(of, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    out.append((lang, name, listed[of[mine[0]]][1], int(held[mine].sum()), at[mine].tobytes(), held[mine].tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS.values())], names=list(_KINDS))

    return finish


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), three digits at a time so that nothing passes 64 bits."""
    total = np.int64(total)
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of floor((p - q)^2 / (p + q)) over the terms, for each row of p with each of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    for i in range(len(p)):
        gap = p[i] - q
        out[i] = (gap * gap // (p[i] + q)).sum(axis=1)
    return out


_RESULT = "lang string, source string, part string, item string, value long"


def _tile(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Partial pair sums and heaps of one tile: rows are counts of the groups of blocks a and b, each for some columns from
    `base` on (or none), and the terms of these columns where a = b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, a, b = pdf["lang"].iloc[0], int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        terms = pdf[pdf["source"].isna()]
        groups = pdf[pdf["source"].notna()]
        width = int(pdf["width"].iloc[0])

        def dense(side: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
            totals = dict(zip(side["source"], side["total"]))
            names = sorted(totals)
            place = {name: i for i, name in enumerate(names)}
            counts = np.zeros((len(names), width), np.int64)
            for name, base, at, held in zip(side["source"], side["base"], side["at"], side["counts"]):
                if held is not None:
                    counts[place[name], int(base) + np.frombuffer(at, np.int32)] = np.frombuffer(held, np.int64)
            return names, counts, np.stack([shares(c, totals[n]) for c, n in zip(counts, names)]) if width and names else counts

        out = []
        names, counts, p = dense(groups[groups["g"] == a])
        if a == b:
            sums = distances(p, p)
            out += [(lang, names[i], "pair", names[j], int(sums[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
        else:
            others, _, q = dense(groups[groups["g"] == b])
            sums = distances(p, q)
            out += [(lang, names[i], "pair", others[j], int(sums[i, j])) for i in range(len(names)) for j in range(len(others))]
        if a == b and len(terms):
            held, spelled = np.zeros(width, np.int64), np.empty(width, object)
            for base, mine, listed in zip(terms["base"], terms["counts"], terms["terms"]):
                held[int(base) : int(base) + len(listed)] = np.frombuffer(mine, np.int64)
                spelled[int(base) : int(base) + len(listed)] = listed
            q = shares(held, int(terms["total"].iloc[0]))
            gap = p - q
            value = gap * gap // (p + q)
            for i, name in enumerate(names):
                above = np.flatnonzero((counts[i] > 0) & (gap[i] > 0))
                best = heapq.nsmallest(top, ((-int(value[i, t]), spelled[t]) for t in above))
                out += [(lang, name, "term", term, -v) for v, term in best]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"]).astype({"value": "int64"})

    return run


def _laid(counted: DataFrame, width: int) -> DataFrame:
    """(lang, block, tile, base): where each block's columns lie: a tile begins with the block that comes first after
    `width` further columns of its language."""
    blocks = counted.where("source IS NULL").select("lang", "block", F.size("terms").alias("size"))
    before = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    blocks = blocks.withColumn("tile", F.floor(F.col("before") / width))
    base = F.col("before") - F.min("before").over(Window.partitionBy("lang", "tile"))
    return blocks.select("lang", "block", "tile", base.alias("base"), "size")


def divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, width: int = TERMS, height: int = GROUPS
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows rank the other sources of the language by their distance,
    `term` rows the terms that a source has more of than its language."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    counted = materialise(lexicon.gathered(rows, _SEP, parts, _blocks(least, width), _BLOCK), "term-blocks")
    groups = materialise(rows.select("lang", "source").distinct(), "groups")
    # Sums over blocks: a row for each group and one (source null) for each language.
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = counted.where("source IS NULL").groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / height).cast("int").alias("height"))
    told = groups.unionByName(groups.select("lang", F.lit(None).cast("string").alias("source")).distinct())
    mine = (told["lang"] == sums["lang"]) & told["source"].eqNullSafe(sums["source"])
    told = told.join(sums, mine, "left").select(told["lang"], told["source"], F.coalesce("n", F.lit(0)).alias("n"))
    told = told.join(kept, "lang", "left").join(sizes, "lang")
    total = F.col("n") + 2 * F.coalesce("v", F.lit(0))
    told = told.select("lang", "source", total.alias("total"), "height", F.pmod(F.xxhash64("source"), F.col("height")).cast("int").alias("g"))
    told = materialise(told, "group-sums")
    laid = materialise(_laid(counted, width), "columns")
    widths = laid.groupBy("lang", "tile").agg(F.sum("size").alias("width"))
    widths = sizes.select("lang").join(widths, "lang", "left").select("lang", F.coalesce("tile", F.lit(0)).alias("tile"), F.coalesce("width", F.lit(0)).alias("width"))
    # The matrix is dense: every group of a language meets every tile of its terms.
    dense = told.join(widths, "lang")
    placed = counted.join(laid.drop("size"), ["lang", "block"]).select("lang", "tile", "source", "base", "at", "counts", "terms")
    same = (dense["lang"] == placed["lang"]) & (dense["tile"] == placed["tile"]) & dense["source"].eqNullSafe(placed["source"])
    held = dense.join(placed, same, "left").select(*[dense[c] for c in dense.columns], "base", "at", "counts", "terms")
    every = F.sequence(F.lit(0), F.col("height") - 1)
    spread = held.where("source IS NOT NULL").withColumn("y", F.explode(every))
    spread = spread.select("*", F.least("g", "y").alias("a"), F.greatest("g", "y").alias("b")).drop("y")
    heads = held.where("source IS NULL AND width > 0").withColumn("a", F.explode(every)).withColumn("b", F.col("a"))
    tiles = spread.unionByName(heads.select(*spread.columns))
    found = materialise(tiles.groupBy("lang", "tile", "a", "b").applyInPandas(_tile(top), _RESULT), "tiles")
    discard(counted, laid)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)


def op13(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), each AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
held AS (SELECT e.lang, source, e.term, count(*) AS c FROM each e JOIN kept k ON k.lang = e.lang AND k.term = e.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM held GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS BIGINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
), whole AS (
  SELECT h.lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 2)) // (any_value(t.n) + 2 * any_value(v)) AS BIGINT) AS q
  FROM held h JOIN v ON v.lang = h.lang JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) t ON t.lang = h.lang GROUP BY h.lang, term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN whole w ON w.lang = p.lang AND w.term = p.term WHERE c > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
