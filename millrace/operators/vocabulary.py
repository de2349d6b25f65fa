"""Character vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import characters


def char_counts(df: DataFrame, normal: str) -> DataFrame:
    """(char, n) of normalized texts; counts are summed per task before they move."""
    return df.select(F.explode(characters(F.col(normal))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def new_chars(counts: DataFrame, donor: DataFrame) -> DataFrame:
    return counts.join(donor.select(F.col("token").alias("char")), "char", "left_anti")


def extend(counts: DataFrame, donor: DataFrame, floor: int = 50) -> DataFrame:
    """(token, id): the donor's ids, then new characters that occur at least `floor` times in code-point order."""
    fresh = new_chars(counts, donor).where(F.col("n") >= floor)
    last = donor.agg(F.max("id").alias("last"))
    rank = F.row_number().over(Window.orderBy("char"))  # as many rows as characters exist
    added = fresh.select("char", rank.alias("r")).join(F.broadcast(last)).select(F.col("char").alias("token"), (F.col("last") + F.col("r")).cast("int").alias("id"))
    return donor.select("token", F.col("id").cast("int").alias("id")).unionByName(added)


def rare_share(counts: DataFrame, donor: DataFrame, floor: int = 50) -> DataFrame:
    """Characters below the floor that the donor lacks, and their share of all occurrences."""
    known = counts.join(donor.select(F.col("token").alias("char"), F.lit(True).alias("known")), "char", "left")
    rare = F.col("known").isNull() & (F.col("n") < floor)
    return known.agg(
        F.count_if(rare).alias("n_rare"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("occurrences"),
        (F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"),
    )


def as_map(vocab: DataFrame) -> dict[str, int]:
    """A vocabulary as a literal: as many entries as characters exist."""
    return {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
