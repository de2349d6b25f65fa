"""Exact order statistics of any number of values, by histograms in rounds.

A round counts the values of each key's open intervals in bins of equal width, finds the bin that holds the wanted rank,
and goes on with the least and largest value of that bin. The largest value of an interval has a bin of its own, so
every round narrows, whatever the values. What is gathered is a histogram of BINS rows for an interval, and, once an
interval holds at most SMALL values, those.

Nulls are left out. Values order as -inf, finite ones, inf, NaN; -0.0 equals 0.0. Keys may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.interim import materialise

BINS, SMALL = 1024, 4096


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 for low to bins - 1 for high alone, rising in between; halves keep the width finite."""
    share = F.coalesce(F.try_divide(value / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    return F.when(value == high, bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 2))).cast("int")


def _within(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """(key, lo, hi, value, times): values of each interval."""
    held = intervals.select(F.col("key").alias("k"), "lo", "hi").distinct()
    same = values["key"].eqNullSafe(held["k"]) & (values["value"] >= held["lo"]) & (values["value"] <= held["hi"])
    return values.join(held, same).select("key", "lo", "hi", "value", "times")


def _narrowed(targets: DataFrame, counts: DataFrame, order: str) -> DataFrame:
    """Targets (key, rank, below, lo, hi) in the part of `counts` (key, lo, hi, order, n, low, high) that holds their rank."""
    before = Window.partitionBy("key", "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    parts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.select(F.col("key").alias("k"), F.col("lo").alias("l"), F.col("hi").alias("h"), "before", "n", "low", "high")
    same = targets["key"].eqNullSafe(parts["k"]) & targets["lo"].eqNullSafe(parts["l"]) & targets["hi"].eqNullSafe(parts["h"])
    at = F.col("below") + F.col("before")
    met = targets.join(parts, same).where((at <= F.col("rank")) & (F.col("rank") < at + F.col("n")))
    return met.select("key", "rank", at.alias("below"), F.col("low").alias("lo"), F.col("high").alias("hi"), "n")


def order_statistics(values: DataFrame, wanted: DataFrame, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(key, rank, value): the values of rank `rank` (from 0) of each key. values: key, value and, if it has such a
    column, how often (`times`); wanted: key, rank, each once; ranks beyond a key's values give no row. values are read
    in every round: they should be a table or cheap."""
    times = F.col("times") if "times" in values.columns else F.lit(1)
    held = values.where(F.col("value").isNotNull()).select("key", F.col("value").cast("double").alias("value"), times.cast("long").alias("times"))
    infinite = F.lit(float("inf"))
    kind = F.when(F.isnan("value"), 2).when(F.col("value") == infinite, 1).when(F.col("value") == -infinite, -1).otherwise(0)
    none = F.lit(None).cast("double")
    sums = [F.sum("times").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    ends = held.groupBy("key", kind.alias("kind")).agg(*sums).select("key", none.alias("lo"), none.alias("hi"), "kind", "n", "low", "high")
    todo = wanted.select("key", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), none.alias("lo"), none.alias("hi"))
    state = materialise(_narrowed(todo, ends, "kind"), "ranks")
    found = []
    single = F.col("lo").eqNullSafe(F.col("hi"))
    while True:
        found.append(state.where(single))
        # Few values: each distinct one is a bin of its own.
        few = state.where(~single & (F.col("n") <= small)).drop("n")
        each = _within(held, few).withColumn("bin", F.col("value")).groupBy("key", "lo", "hi", "bin").agg(*sums)
        found.append(_narrowed(few, each, "bin"))
        wide = state.where(~single & (F.col("n") > small)).drop("n")
        if wide.isEmpty():
            break
        inside = _within(held, wide).withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
        state = materialise(_narrowed(wide, inside.groupBy("key", "lo", "hi", "bin").agg(*sums), "bin"), "ranks")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("key", "rank", F.col("lo").alias("value"))


def _values(df: DataFrame, key: str, value: str, times: str | None) -> DataFrame:
    held = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), (F.col(times) if times else F.lit(1)).alias("times"))
    return materialise(held.where(F.col("value").isNotNull()), "values")


def floor_percentiles(df: DataFrame, qs: dict[str, float], key: str = "config", value: str = "duration", times: str | None = None) -> DataFrame:
    """For each key the value at floor(q (n - 1)) of its sorted values; `times` names how often a row's value counts."""
    held = _values(df, key, value, times)
    sizes = held.groupBy("key").agg(F.sum("times").alias("n"))
    ranks = {name: F.floor(F.lit(q) * (F.col("n") - 1)) for name, q in qs.items()}
    wanted = sizes.select("key", F.explode(F.array_distinct(F.array(*ranks.values()))).alias("rank"))
    found = order_statistics(held, wanted).withColumnRenamed("key", "k")
    met = sizes.join(found, sizes["key"].eqNullSafe(found["k"]))
    picks = [F.max(F.when(F.col("rank") == ranks[name], F.col("value"))).alias(name) for name in qs]
    return met.groupBy(F.col("key").alias(key)).agg(*picks)


def linear_percentiles(df: DataFrame, qs: dict[str, float], key: str = "config", value: str = "duration") -> DataFrame:
    """For each key of df the value at q (n - 1) of its sorted values, interpolated between neighbours; null without any."""
    held = _values(df, key, value, None)
    sizes = held.groupBy("key").agg(F.count("*").alias("n"))
    places = {name: F.lit(q) * (F.col("n") - 1) for name, q in qs.items()}
    ranks = F.array(*[f(h) for h in places.values() for f in (F.floor, F.ceil)])
    found = order_statistics(held, sizes.select("key", F.explode(F.array_distinct(ranks)).alias("rank"))).withColumnRenamed("key", "k")
    met = sizes.join(found, sizes["key"].eqNullSafe(found["k"]))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    picks = []
    for name, h in places.items():
        low, high = at(F.floor(h)), at(F.ceil(h))
        share = F.max(h - F.floor(h))
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    told = met.groupBy(F.col("key").alias("k")).agg(*picks)
    every = df.select(key).distinct()
    return every.join(told, every[key].eqNullSafe(told["k"]), "left").drop("k")
