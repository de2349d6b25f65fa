"""Evaluation sets: held-out and seen segments, matched and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import min_shard
from .splits import SEED, shuffled


def matched_books(split_map: DataFrame, seed: int = SEED) -> DataFrame:
    """(config, book): as many shuffled train books as the config has test books."""
    n_test = split_map.groupBy("config").agg(F.count_if(F.col("split") == "test").alias("n_test"))
    train = split_map.where("split = 'train'")
    place = F.row_number().over(Window.partitionBy("config").orderBy(shuffled(seed, F.lit("match"), "config", "book"), "book"))
    return train.withColumn("place", place).join(n_test, "config").where("place <= n_test").select("config", "book")


def pools(segments: DataFrame, split_map: DataFrame, trained: DataFrame, trainable: Column, match: bool = False) -> DataFrame:
    """(config, side, id, shard): distinct trainable ids of test books ('honest') and of train books that weren't
    trained on ('leaked'). With match, leaked ids come from matched_books; configs without any there are unrestricted."""
    placed = segments.join(split_map, ["config", "book"])
    honest = placed.where((F.col("split") == "test") & trainable)
    seen = placed.where("split = 'train'")
    if match:
        allowed = matched_books(split_map)
        free = seen.join(allowed.select("config").distinct(), "config", "left_anti")
        seen = seen.join(allowed, ["config", "book"], "left_semi").unionByName(free)
    seen = seen.where(trainable).join(trained.select("config", "id"), ["config", "id"], "left_anti")
    tag = lambda df, side: min_shard(df).withColumn("side", F.lit(side))
    return tag(honest, "honest").unionByName(tag(seen, "leaked")).select("config", "side", "id", "shard")


def sample(pool: DataFrame, per_config: int, min_leaked: int, seed: int = SEED) -> DataFrame:
    """At most per_config shuffled ids of each (config, side); leaked sides below min_leaked give none."""
    side = Window.partitionBy("config", "side")
    size = pool.groupBy("config", "side").agg(F.count("*").alias("pool"))
    small = size.where((F.col("side") == "leaked") & (F.col("pool") < min_leaked)).select("config", "side")
    place = F.row_number().over(side.orderBy(shuffled(seed, "config", "side", "id"), "id"))
    chosen = pool.withColumn("place", place).where(F.col("place") <= per_config)
    return chosen.join(small, ["config", "side"], "left_anti").select("config", "side", "id", "shard")


def summary(pool: DataFrame, configs: DataFrame, min_leaked: int) -> DataFrame:
    per = pool.groupBy("config").agg(
        F.count_if(F.col("side") == "honest").alias("honest_pool"), F.count_if(F.col("side") == "leaked").alias("leaked_pool")
    )
    out = configs.select("config").distinct().join(per, "config", "left").na.fill(0, ["honest_pool", "leaked_pool"])
    return out.withColumn("leaked_excluded", F.col("leaked_pool") < min_leaked)


def pick_clips(df: DataFrame, low: float, high: float, max_books: int, per_book: int, seed: int = SEED) -> DataFrame:
    """(config, book, id, shard): per_book shuffled segments of middling length from at most max_books evenly spaced books."""
    rows = df.where(F.coalesce("duration", F.lit(0.0)).between(low, high))
    books = rows.select("config", "book").distinct()
    order, all_ = Window.partitionBy("config").orderBy("book"), Window.partitionBy("config")
    books = books.select("config", "book", (F.row_number().over(order) - 1).alias("at"), F.count("*").over(all_).alias("n"))
    evenly = F.transform(F.sequence(F.lit(0), F.lit(max_books - 1)), lambda i: F.floor(i * (F.col("n") / max_books)).cast("int"))
    books = books.where((F.col("n") <= max_books) | F.array_contains(evenly, F.col("at"))).select("config", "book")
    place = F.row_number().over(Window.partitionBy("config", "book").orderBy(shuffled(seed, "config", "book", "id"), "id", "shard"))
    chosen = rows.join(books, ["config", "book"], "left_semi").withColumn("place", place)
    return chosen.where(F.col("place") <= per_book).select("config", "book", "id", "shard")
