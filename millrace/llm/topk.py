"""Exact top-k search by inner product with ball trees.

Vectors are dealt to shards; each shard builds a ball tree (centre c and radius r of every node). For a query q no
vector of a node scores above q.c + |q| r. A block of queries descends the tree together: at each node the queries
whose bound stays below their current kth score drop out, children are visited in the order of their bounds, and
leaves are scored exactly. First every query searches the shard that it lies in; its kth score there is shared with the
searches of all other shards, which start from it. Query blocks meet shards in an equi-join key, so a task holds one
block and one shard.

Scores are whole numbers: components are floor(64 x), products are summed in doubles where these are exact and in
Python integers elsewhere. Equal scores go to the smaller id, null ids last. Vectors that are null or hold null or
non-finite components take no part; vectors meet vectors of the same length only, a query never meets its own id.
Repeated rows are repeated results, and a query id that repeats is answered once for each row, in one ranking. Columns
besides id and vector are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 4096, 256
_NO_ID = (1 << 63) - 1
_EXACT = float(1 << 52)


class BallTree:
    """Nodes in arrays; a node's vectors are rows order[first:last]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.first, self.last, self.left, self.right, centres, radii = [], [], [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            node = len(self.first)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            part = x[self.order[first:last]]
            centre = part.mean(axis=0)
            distance = np.linalg.norm(part - centre, axis=1)
            self.first.append(first)
            self.last.append(last)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radii.append(distance.max() * (1 + 1e-9) + 1e-9)
            if last - first > leaf and distance.max() > 0:
                a = part[distance.argmax()]
                along = part @ (part[np.linalg.norm(part - a, axis=1).argmax()] - a)
                self.order[first:last] = self.order[first:last][np.argsort(along, kind="stable")]
                middle = (first + last) // 2
                stack += [(first, middle, node, 0), (middle, last, node, 1)]
        self.centre, self.radius = np.array(centres), np.array(radii)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of each query's best k of x with scores of at least `least`."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if not len(x) or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if top >= _EXACT or top * (len(x) + 1) >= 2.0**62:
        return _by_integers(x, ids, q, own, k, least)
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    span = len(x) + 1
    tree, none = BallTree(x), -(1 << 62)
    best = np.full((len(q), k), none, np.int64)  # score * span - rank, so equal scores order by id
    kth = least.astype(np.float64).copy()
    length = np.linalg.norm(q, axis=1)
    slack = 1e-9 * (1 + top)

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        return q[rows] @ tree.centre[node] + length[rows] * tree.radius[node] + slack

    stack = [(0, np.arange(len(q)))]
    while stack:
        node, rows = stack.pop()
        rows = rows[bound(node, rows) >= kth[rows]]
        if not len(rows):
            continue
        if tree.left[node] < 0:
            at = tree.order[tree.first[node] : tree.last[node]]
            scores = np.rint(q[rows] @ x[at].T)
            fits = (scores >= kth[rows, None]) & (ids[at][None] != own[rows, None])
            some = fits.any(axis=1)
            rows, scores, fits = rows[some], scores[some], fits[some]
            keys = np.where(fits, scores.astype(np.int64) * span - rank[at][None], none)
            both = np.concatenate([best[rows], keys], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            low = best[rows].min(axis=1)
            kth[rows] = np.where(low > none, np.maximum(kth[rows], -((-low) // span)), kth[rows])
        else:
            children = [tree.left[node], tree.right[node]]
            order = np.argsort([bound(c, rows).mean() for c in children])
            stack += [(children[c], rows) for c in order]  # the higher bound is visited first
    row, column = np.nonzero(best > none)
    keys = best[row, column]
    score = -((-keys) // span)
    by_rank = np.empty(len(x), np.int64)
    by_rank[rank] = np.arange(len(x))
    return row, ids[by_rank[score * span - keys]], score


def _by_integers(x, ids, q, own, k, least):
    vectors = [[int(v) for v in row] for row in x]
    out = []
    for i, row in enumerate(q):
        mine = [int(v) for v in row]
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), int(d)) for v, d in zip(vectors, ids) if d != own[i])
        out += [(i, d, min(max(-s, -(2**63)), 2**63 - 1)) for s, d in scored[:k] if -s >= least[i]]
    return tuple(np.array([o[j] for o in out], np.int64) for j in range(3))


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.coalesce(sound, F.lit(False))).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.size(x).alias("dims"), F.transform(x, lambda v: v.cast("double")).alias("v")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["v"] = [np.floor(64 * np.asarray(v, np.float64)).tobytes() for v in pdf["v"]]
            yield pdf

    return rows.mapInPandas(run, "id long, dims int, v binary")


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), dims)


_FOUND = "row long, query_id long, vec_id long, score long"


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds, against all rows."""
    # Row numbers deal repeated rows to many shards and tell repeated queries apart; the tables are written, so they stay.
    rows = materialise(_packed(df, id_col, vector_col).withColumn("place", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.select("id", "dims", "v", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"))
    asks = dealt.withColumn(id_col, F.when(F.col("id") != _NO_ID, F.col("id"))).where(F.coalesce(is_query, F.lit(False)))
    asks = materialise(asks.select(F.monotonically_increasing_id().alias("row"), "id", "dims", "v", "shard"), "queries")
    blocks = max(1, -(-asks.count() // QUERY_ROWS))

    def found(stored: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(queries):
            return pd.DataFrame({c.split(" ")[0]: pd.Series([], dtype="int64") for c in _FOUND.split(", ")})
        dims = int(stored["dims"].iloc[0])
        own = queries["id"].to_numpy(np.int64)
        least = queries["least"].to_numpy(np.float64)
        row, ids, score = search(_matrix(stored["v"], dims), stored["id"].to_numpy(np.int64), _matrix(queries["v"], dims), own, k, least)
        return pd.DataFrame({"row": queries["row"].to_numpy(np.int64)[row], "query_id": own[row], "vec_id": ids, "score": score})

    none = F.lit(-float("inf"))
    home = dealt.groupBy("dims", "shard").cogroup(asks.withColumn("least", none).groupBy("dims", "shard")).applyInPandas(found, _FOUND)
    home = materialise(home, "home-shards")
    out = home
    if shards > 1:
        kth = home.groupBy("row").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        shared = asks.join(kth, "row", "left").withColumn("least", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(none))
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
        sent = shared.withColumnRenamed("shard", "home").select("row", "id", "dims", "v", "least", block.alias("block"), F.explode(others).alias("shard"))
        stored = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        away = stored.groupBy("dims", "shard", "block").cogroup(sent.groupBy("dims", "shard", "block")).applyInPandas(found, _FOUND)
        out = home.unionByName(away)
    # k rows a query and shard at most; ranking them needs no more than the best k of each task.
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = out.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op6(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
