"""Segment views over the test tables, in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parse import parse_source

from .scans import spread

CONFIGS = {"en": "English_eng", "fr": "French_fra", "de": "German_deu", "es": "Spanish_spa"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as segments: config, id, text, duration, source_file, shard, book, chapter, version."""
    docs = spread(read(spark, sf_dir, "documents"))
    config = F.lit("Unknown_und")
    for lang, name in CONFIGS.items():
        config = F.when(F.col("lang") == lang, name).otherwise(config)
    source = F.concat(F.upper("source"), F.lit("."), F.col("doc_id") % 20, F.lit("."), F.col("doc_id") % 3)
    out = docs.select(
        config.alias("config"),
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        "text",
        F.col("n_chars").cast("double").alias("duration"),
        source.alias("source_file"),
        (F.col("doc_id") % 8).cast("int").alias("shard"),
    )
    return out.withColumns(parse_source(F.col("source_file")))


#: Columns that give segments_big a total order within an id.
BIG_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def segments_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as segments with repeated ids."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("config"),
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_quantity").alias("duration"),
        F.col("l_suppkey").cast("string").alias("book"),
        (F.col("l_linenumber") % 3).cast("string").alias("version"),
        (F.col("l_partkey") % 16).cast("int").alias("shard"),
        *BIG_ORDER,
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as scored utterances: a turn is the reference, the next turn the hypothesis."""
    a, b = spread(read(spark, sf_dir, "conversations")), read(spark, sf_dir, "conversations")
    b = b.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"), F.col("role").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.col("role").alias("config"),
        F.col("text").alias("reference"),
        "hypothesis",
        F.when(F.col("turn") % 4 != 3, F.when(F.col("turn") % 5 == 0, F.col("role")).otherwise(F.col("next"))).alias("language_pred"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as clips with whole-numbered vectors, so that sums are exact."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("vec_id"),
        F.col("label").cast("string").alias("book"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("vector"),
    )


_NAMED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFIGS.items())
VIEWS = {
    "segments": f"""segments AS (SELECT CASE lang {_NAMED} ELSE 'Unknown_und' END AS config, CAST(doc_id AS VARCHAR) AS id,
      doc_id, text, CAST(n_chars AS DOUBLE) AS duration, upper(source) || '.' || (doc_id % 20) || '.' || (doc_id % 3) AS source_file,
      CAST(doc_id % 8 AS INTEGER) AS shard, upper(source) AS book, CAST(doc_id % 20 AS INTEGER) AS chapter,
      CAST(doc_id % 3 AS VARCHAR) AS version FROM documents)""",
    "big": f"""big AS (SELECT l_returnflag || l_linestatus AS config, l_orderkey || '.' || l_linenumber AS id, l_quantity AS duration,
      CAST(l_suppkey AS VARCHAR) AS book, CAST(l_linenumber % 3 AS VARCHAR) AS version, CAST(l_partkey % 16 AS INTEGER) AS shard,
      {", ".join(BIG_ORDER)} FROM lineitem)""",
    "pairs": """pairs AS (SELECT a.conv_id, a.turn, a.role AS config, a.text AS reference, b.text AS hypothesis,
      CASE WHEN a.turn % 4 <> 3 THEN CASE WHEN a.turn % 5 = 0 THEN a.role ELSE b.role END END AS language_pred
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    "clips": """clips AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(label AS VARCHAR) AS book,
      list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS vector FROM embeddings)""",
}
