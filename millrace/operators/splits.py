"""Leak-free assignment of whole groups to test, dev and train."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20260730


def shuffled(seed: int, *keys: str) -> Column:
    """A stable pseudo-random order, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def group_hours(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.coalesce("duration", F.lit(0.0))) / 3600).alias("hours"))


def assign_groups(df: DataFrame, dev: float = 0.05, test: float = 0.05, seed: int = SEED) -> DataFrame:
    """(config, book, split). Books fill test, then dev, in shuffled order, where one overshoots its target by at most
    half its own length; the rest train. Without a test book the smallest of several becomes one.

    The fold runs over a partition's books, never over its rows, in time and memory in proportion to them."""
    books = df.groupBy("config", "book").agg(F.sum(F.coalesce("duration", F.lit(0.0))).cast("double").alias("d"))
    kinds = ", ".join(f"{c} {books.schema[c].dataType.simpleString()}" for c in ("config", "book"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "book"], na_position="first")
        total = float(pdf["d"].sum())
        wanted, got = {"test": total * test, "dev": total * dev}, {"test": 0.0, "dev": 0.0}
        out = []
        for d in pdf["d"].tolist() if total > 0 else ():
            side = next((s for s in wanted if got[s] < wanted[s] and got[s] + d <= wanted[s] + d / 2), "train")
            if side != "train":
                got[side] += d
            out.append(side)
        if total > 0 and "test" not in out and len(out) > 1:
            out[int(pdf["d"].to_numpy().argmin())] = "test"
        return pd.DataFrame({"config": pdf["config"], "book": pdf["book"], "split": out or "train"})

    return books.withColumn("h", shuffled(seed, "config", "book")).groupBy("config").applyInPandas(fold, f"{kinds}, split string")


def with_split(df: DataFrame, split_map: DataFrame, default: str | None = None) -> DataFrame:
    """df plus its split; the map has one row for each (config, book) and joins as the planner sees fit."""
    out = df.join(split_map.select("config", "book", "split"), ["config", "book"], "left")
    return out if default is None else out.withColumn("split", F.coalesce("split", F.lit(default)))


def books_per_split(split_map: DataFrame) -> DataFrame:
    return split_map.groupBy("config", "split").agg(F.count("*").alias("n_books"))
