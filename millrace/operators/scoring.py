"""Error rates of recognised text, their rollups, comparisons and intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.edits import edits
from millrace.functions.text import normalize, words


def utterance_errors(records: DataFrame) -> DataFrame:
    """records plus word_errors, words, char_errors, chars. Both sides are normalized; characters leave out spaces."""
    normal = records.withColumns({"_r": normalize(F.col("reference")), "_h": normalize(F.col("hypothesis"))})
    told = normal.withColumn("_e", edits("_r", "_h"))
    return told.withColumns(
        {
            "word_errors": F.col("_e.word_errors"),
            "words": F.size(words(F.col("_r"))).cast("long"),
            "char_errors": F.col("_e.char_errors"),
            "chars": F.length(F.replace("_r", F.lit(" "), F.lit(""))).cast("long"),
        }
    ).drop("_r", "_h", "_e")


def _rate(errors: str, total: str):
    return F.when(F.sum(total) > 0, F.sum(errors) / F.sum(total)).otherwise(0.0)


def _scores():
    predicted = F.col("language_pred") != ""
    return [
        F.count("*").alias("n"),
        F.sum("word_errors").alias("word_errors"),
        F.sum("words").alias("words"),
        F.sum("char_errors").alias("char_errors"),
        F.sum("chars").alias("chars"),
        F.round(_rate("word_errors", "words"), 4).alias("wer"),
        F.round(_rate("char_errors", "chars"), 4).alias("cer"),
        F.avg(F.when(predicted, (F.col("language_pred") == F.col("config")).cast("double"))).alias("lid_acc"),
    ]


def scores_by_config(errors: DataFrame) -> DataFrame:
    """Pooled rates of each config; errors: utterance_errors with a language_pred column."""
    return errors.groupBy("config").agg(*_scores())


def rollup(errors: DataFrame) -> DataFrame:
    """scores_by_config plus __micro__, pooled over all rows, and __macro__, the mean of the configs' rounded rates."""
    rolled = errors.rollup("config").agg(*_scores(), F.grouping("config").alias("g"))
    named = rolled.withColumn("config", F.when(F.col("g") == 1, "__micro__").otherwise(F.col("config")))
    per = named.where("g = 0")
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    macro = per.agg(
        F.lit("__macro__").alias("config"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("word_errors", "words", "char_errors", "chars")],
        mean("wer"), mean("cer"), F.avg("lid_acc").alias("lid_acc"),
    )
    return named.drop("g").unionByName(macro)


def lid_accuracy(records: DataFrame) -> DataFrame:
    """Share of right predictions among rows that have one; configs without any are left out."""
    told = records.where(F.col("language_pred") != "")
    return told.groupBy("config").agg(F.count("*").alias("n"), F.avg((F.col("language_pred") == F.col("config")).cast("double")).alias("lid_acc"))


def leak_gap(honest: DataFrame, leaked: DataFrame) -> DataFrame:
    """Rates of both sides for configs that both have, the gap in points and the relative inflation."""
    side = lambda df, name: df.groupBy("config").agg(_rate("word_errors", "words").alias(name))
    both = side(honest, "honest").join(side(leaked, "leaked"), "config")
    return both.select(
        "*", ((F.col("honest") - F.col("leaked")) * 100).alias("gap_points"),
        F.when(F.col("leaked") > 0, F.col("honest") / F.col("leaked") - 1).alias("inflation"),
    )


def verdict(low, high):
    return F.when((low <= 0) & (high >= 0), "spans zero").when(low > 0, "leakage helps").otherwise("leakage hurts")


def matched_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: both systems' pooled word rate over the configs that both cover."""
    both = ours.select("config").distinct().intersect(theirs.select("config").distinct())
    pool = lambda df, name: df.join(both, "config", "left_semi").agg(_rate("word_errors", "words").alias(name), F.count("*").alias(f"n_{name}"))
    a, b = pool(ours, "ours").withColumn("k", F.lit(1)), pool(theirs, "theirs").withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k")


def poisson_steps(mean: float = 1.0) -> list[int]:
    """Where a 32-bit number passes from one count to the next under the inverse distribution of a Poisson variable."""
    out, term, upto, k = [], math.exp(-mean), 0.0, 0
    while True:
        upto += term
        step = math.floor(upto * 2**32)
        if step >= 2**32 or (out and step == out[-1]):
            return out
        out.append(step)
        k += 1
        term *= mean / k


def bootstrap_delta(honest: DataFrame, leaked: DataFrame, rounds: int = 2000, seed: int = 7, row: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(mean, low, high) of the difference of two pooled rates, whole utterances resampled, sides independent.

    Each utterance is drawn Poisson(1) times in every round, which needs no row to be gathered. A draw is a function of
    seed, side, round and the row's key (columns `row`, or all others of a table without them; rows of one key are
    numbered), so any engine repeats it. An md5 gives four draws of 32 bits. Tasks sum their rows for every round, and
    only sums of (four rounds, side) move. A row costs far more than its bytes tell, so rows are dealt by number."""
    named = [c for c in row if c in honest.columns] or [c for c in honest.columns if c not in ("word_errors", "words")]
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named])
    parts = max(int(honest.sparkSession.conf.get("spark.sql.shuffle.partitions")), honest.sparkSession.sparkContext.defaultParallelism)
    nth = F.row_number().over(Window.partitionBy("side", "key").orderBy("word_errors", "words"))
    tagged = lambda df, side: df.select(F.lit(side).alias("side"), key.alias("key"), "word_errors", "words")
    both = tagged(honest, 0).unionByName(tagged(leaked, 1)).repartition(parts, "side", "key").withColumn("nth", nth)
    four = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // 4) - 1))).alias("four"))
    four = four.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "side", "four", "key", "nth").cast("binary")))
    sums = []
    for j in range(4):
        number = F.conv(F.substring("h", 8 * j + 1, 8), 16, 10).cast("long")
        times = sum((number >= step).cast("long") for step in poisson_steps())
        sums.append(F.struct(F.lit(j).alias("j"), F.sum(times * F.col("word_errors")).alias("e"), F.sum(times * F.col("words")).alias("w")))
    parts = four.groupBy("four", "side").agg(F.array(*sums).alias("s")).select("four", "side", F.inline("s"))
    rates = parts.select((F.col("four") * 4 + F.col("j")).alias("round"), "side", F.when(F.col("w") > 0, F.col("e") / F.col("w")).otherwise(0.0).alias("rate"))
    signed = F.when(F.col("side") == 0, F.col("rate")).otherwise(-F.col("rate"))
    delta = rates.where(F.col("round") < rounds).groupBy("round").agg(F.sum(signed).alias("d"))
    # One row a round: the percentile's map holds `rounds` values.
    return delta.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
