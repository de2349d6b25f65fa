"""Policies for ids that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def min_duration(df: DataFrame, keys: tuple[str, ...] = ("config", "id")) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.coalesce("duration", F.lit(0.0))).alias("duration"))


def first_row(df: DataFrame, order: list, keys: tuple[str, ...] = ("config", "id")) -> DataFrame:
    """One whole row for each key: the first in a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def min_shard(df: DataFrame, keys: tuple[str, ...] = ("config", "id")) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.coalesce("shard", F.lit(0))).alias("shard"))


def id_uniqueness(df: DataFrame) -> DataFrame:
    """Partitions with repeated ids: rows, distinct ids, their ratio, hours as stored and scaled to distinct ids."""
    per = df.groupBy("config").agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), (F.sum("duration") / 3600).alias("hours")
    )
    return per.where("n_rows > n_ids").select(
        "*", (F.col("n_rows") / F.col("n_ids")).alias("factor"), (F.col("hours") * F.col("n_ids") / F.col("n_rows")).alias("unique_hours")
    )
