"""Connected components by alternating stars.

Every round links each node's larger neighbours, then its smaller ones, to the smallest node it knows; edges only ever
move within their component, and the rounds end when every component is a star around its smallest node. All state
lives in written tables; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % F.lit(1 << 40)))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to another are left out."""
    pair = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pair = materialise(pair, "edges")
    before = _state(pair)
    while before[0]:
        both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        old, pair = pair, materialise(small.where("a <> b").distinct(), "edges")
        discard(old)
        after = _state(pair)
        if after == before:
            break
        before = after
    roots = pair.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pair.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
