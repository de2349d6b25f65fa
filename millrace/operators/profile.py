"""Profiles of partitions and of recording versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import characters
from millrace.sources.interim import materialise
from millrace.sources.scans import first_shards

from .quantiles import floor_percentiles


def profile_state(df: DataFrame, first: tuple[str, ...] = ("shard", "doc_id")) -> DataFrame:
    """(config, kind, name, number, n, at): what a profile needs of some rows, in a form that adds up: how often each
    source, duration, shard and character occurs, and the first text (by `first`) up to 120 characters."""
    none = F.lit(None)
    item = lambda kind, name=none.cast("string"), number=none.cast("double"): F.struct(F.lit(kind).alias("kind"), name.alias("name"), number.alias("number"))
    chars = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""))
    plain = F.array(item("source", F.col("source_file")), item("duration", number=F.col("duration").cast("double")), item("shard", F.col("shard").cast("string")))
    each = df.select("config", F.inline(F.concat(plain, F.transform(chars, lambda c: item("char", c)))))
    told = F.when(F.length("text") > 0, F.substring("text", 1, 120))
    at = F.when(told.isNotNull(), F.struct(*first))
    texts = df.groupBy("config").agg(F.lit("text").alias("kind"), F.min_by(told, at).alias("name"), F.min(at).alias("at")).where("name IS NOT NULL")
    return each.groupBy("config", "kind", "name", "number").agg(F.count("*").alias("n")).unionByName(texts, allowMissingColumns=True)


def merged_states(states: DataFrame) -> DataFrame:
    """One state of several."""
    counts = states.where("kind <> 'text'").groupBy("config", "kind", "name", "number").agg(F.sum("n").alias("n"))
    texts = states.where("kind = 'text'").groupBy("config", "kind").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
    return counts.unionByName(texts, allowMissingColumns=True)


def profile_of(state: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """The audit row of each config: files, segments, hours, sources and their shares, duration percentiles, characters,
    its three commonest sources and its first text. state: a written profile_state; scales (config, n_files, scale): how
    many shards there are and by what segments and hours are scaled up, where the state is of some of them."""
    kind = lambda k: state.where(F.col("kind") == k)
    rank = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("n"), "name"))
    common = lambda k: F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)) / F.sum("n")
    best = F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "name"))))
    by_source = kind("source").withColumn("r", rank).groupBy("config").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_sources"),
        F.max("n").alias("max_per_source"),
        common(1).alias("top1_share"),
        common(5).alias("top5_share"),
        F.array_join(F.transform(best, lambda x: x["name"]), ",").alias("sample_sources"),
    )
    if scales is None:
        scales = kind("shard").groupBy("config").agg(F.count("*").alias("n_files"), F.lit(1.0).alias("scale"))
    hours = kind("duration").groupBy("config").agg((F.sum(F.col("number") * F.col("n")) / 3600).alias("hours"), F.max("number").alias("duration_max"))
    medians = floor_percentiles(kind("source"), {"median_per_source": 0.5}, value="n")
    durations = floor_percentiles(kind("duration"), {"duration_p50": 0.5, "duration_p90": 0.9}, value="number", times="n")
    letters = kind("char").groupBy("config").agg(F.count("*").alias("charset_size"))
    out = scales
    for part in (by_source, hours, medians, durations, letters, kind("text").select("config", F.col("name").alias("sample_text"))):
        out = out.join(part, "config", "left")
    named = F.regexp_extract("config", "^(.*)_([a-z]{3})$", 2)
    return out.select(
        "config",
        F.when(named != "", F.regexp_extract("config", "^(.*)_([a-z]{3})$", 1)).otherwise(F.col("config")).alias("language"),
        named.alias("iso"),
        "n_files",
        F.floor(F.col("n") * F.col("scale")).alias("n_segments"),
        (F.col("hours") * F.col("scale")).alias("total_hours"),
        "n_sources", "median_per_source", "max_per_source", "top1_share", "top5_share",
        "duration_p50", "duration_p90", "duration_max", "charset_size", "sample_sources",
        F.coalesce("sample_text", F.lit("")).alias("sample_text"),
    )


def profile(df: DataFrame, most: int | None = None) -> DataFrame:
    """The audit rows of df; with `most`, of each config's first `most` shards, scaled up to all of them."""
    if most is None:
        return profile_of(materialise(profile_state(df), "profile"))
    sampled = first_shards(df, most)
    n_files = df.groupBy("config").agg(F.countDistinct("shard").alias("n_files"))
    scales = n_files.withColumn("scale", F.col("n_files") / F.least("n_files", F.lit(most)))
    return profile_of(materialise(profile_state(sampled), "profile"), scales)


def charsets(df: DataFrame, normal: str) -> DataFrame:
    """(config, charset): the distinct characters of normalized texts in code-point order."""
    one = df.select("config", F.explode(F.array_distinct(characters(F.col(normal)))).alias("c")).distinct()
    return one.groupBy("config").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("charset"))


def version_counts(df: DataFrame) -> DataFrame:
    """(config, version, n, n_books); values of another form count as UNPARSED:<value>."""
    named = F.when(F.col("version") == "", F.concat(F.lit("UNPARSED:"), F.col("source_file"))).otherwise(F.col("version"))
    return df.select("config", named.alias("version"), "book").groupBy("config", "version").agg(
        F.count("*").alias("n"), F.countDistinct("book").alias("n_books")
    )


def version_profile(df: DataFrame) -> DataFrame:
    """The most frequent version of each config, the smallest among equals."""
    counts = version_counts(df)
    order = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("n"), "version"))
    total = F.sum("n").over(Window.partitionBy("config"))
    n_versions = F.count("*").over(Window.partitionBy("config"))
    ranked = counts.select("config", "version", "n", "n_books", (F.col("n") / total).alias("share"), n_versions.alias("n_versions"), order.alias("o"))
    return ranked.where("o = 1").select("config", F.col("version").alias("dominant"), "n", "share", "n_versions", F.col("n_books").alias("dominant_books"))


def version_overlap(df: DataFrame) -> DataFrame:
    """(config, v1, v2, shared_books) of versions that have a book in common."""
    one = df.select("config", "book", "version").distinct()
    a, b = one.withColumnRenamed("version", "v1"), one.withColumnRenamed("version", "v2")
    return a.join(b, ["config", "book"]).where("v1 < v2").groupBy("config", "v1", "v2").agg(F.count("*").alias("shared_books"))


def dominant_rows(df: DataFrame, books: list[str] | None = None) -> DataFrame:
    top = version_profile(df).select("config", F.col("dominant").alias("version"))
    out = df.join(F.broadcast(top), ["config", "version"], "left_semi")  # a row for each config
    return out if books is None else out.where(F.col("book").isin(*books))
