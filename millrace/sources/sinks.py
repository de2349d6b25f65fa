"""Sinks: resumable partitions, routed outputs, sized shards, documents and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, key: str = "config", force: bool = False) -> None:
    """A part for each key; keys that are there already are skipped, or replaced with force. Other keys' parts stay."""
    spark = df.sparkSession
    if not force:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(jpath) and any(f"{key}=" in s.getPath().getName() for s in fs.listStatus(jpath)):
            df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def merge_parts(spark: SparkSession, path: str, out: str, files: int) -> None:
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(out)


def write_routed(df: DataFrame, path: str, side: str = "side") -> None:
    """One pass over df into a directory for each side."""
    df.write.mode("overwrite").partitionBy(side).parquet(path)


def write_shards(df: DataFrame, path: str, limit_bytes: int, size: str = "size", block_bytes: int | None = None, block_rows: int = 500_000) -> None:
    """A file for each shard: rows run by hash, and a shard ends with the row that brings the sum of `size` to a multiple of
    limit_bytes, so a file holds less than the limit and one row. Sums run within ranges of hashes, on top of the sums of
    those before; there are as many ranges as leave each about block_rows rows, so a task's share doesn't grow with the
    table. A row without a size counts as one of none."""
    weight = F.coalesce(F.col(size).cast("double"), F.lit(0.0))
    total, count = df.agg(F.coalesce(F.sum(weight), F.lit(0.0)), F.count("*")).first()
    bits = max(8, math.ceil(math.log2(max(1, count / block_rows))))
    rows = df.withColumns({"_h": F.xxhash64(*df.columns), "_w": weight}).withColumn("_b", F.shiftright("_h", 64 - bits).cast("long"))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_base"))
    inner = Window.partitionBy("_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, "_b").withColumn("_at", F.col("_base") + F.coalesce(F.sum("_w").over(inner), F.lit(0.0)))
    n = int(total // limit_bytes) + 1
    moved = placed.withColumn("_shard", F.least(F.floor(F.col("_at") / limit_bytes), F.lit(n - 1)).cast("int")).repartitionById(n, "_shard")
    writer = moved.select(*df.columns).write.mode("overwrite").option("compression", "zstd")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(path)


def row_group_bytes(df: DataFrame, column: str, target_mb: float) -> int:
    """Rows of a row group times their mean size, at least one row."""
    mean = df.agg(F.avg(F.octet_length(column))).first()[0] or 1.0
    return int(max(int(target_mb * 1e6 / mean), 1) * mean)


def with_metadata(df: DataFrame, column: str, metadata: dict) -> DataFrame:
    return df.withColumn(column, F.col(column).alias(column, metadata=metadata))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, key: str) -> None:
    """One JSON document {key: {columns}} of a small table (a row for each partition)."""
    rest = F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*[c for c in df.columns if c != key])))))
    df.agg(rest.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame, widths: dict[str, int]) -> list[str]:
    """Fixed-width lines of a small table, headed by its column names."""
    line = F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()])
    return ["".join(c[:w].ljust(w) for c, w in widths.items()).rstrip(), *(r[0].rstrip() for r in df.select(line).collect())]


def split_header(splits: list[str], pattern: str = "data/{split}-*.parquet") -> str:
    """The YAML block that lists a dataset's split files."""
    rows = [f"  - split: {s}\n    path: {pattern.format(split=s)}" for s in splits]
    return "\n".join(["configs:", "- config_name: default", "  data_files:", *rows])


def eval_cut(df: DataFrame, eval_rows: int, order: str, key: str = "config") -> DataFrame:
    """df plus part: the first min(eval_rows, max(n // 20, 1)) rows of each key are 'eval', the rest 'train'."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    n = F.count("*").over(Window.partitionBy(key))
    first = F.least(F.lit(eval_rows), F.greatest(F.floor(n / 20), F.lit(1)))
    return df.withColumn("part", F.when(place <= first, "eval").otherwise("train"))
