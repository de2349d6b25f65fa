"""Scans: partition discovery, projection, shard samples, lookups, text records and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files_by_partition(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(config, path, length) of the files under root/<config>/, found without reading them; an empty root is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    listed = found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("config"), "path", "length")
    if listed.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {root}")
    return listed


def read_partitions(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """root/<config>/*.parquet with a config column; only the wanted columns that exist are read."""
    df = spark.read.parquet(f"{root}/*").withColumn("config", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return df if columns is None else project(df, ["config", *columns])


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


#: Bytes of a table that one scan task may read whole: Spark's own size of a split.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files fit one split, which a single task may read: what follows may cost far more than
    the read. Larger tables come in many splits and stay where they are, so at most SPLIT_BYTES are ever shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPLIT_BYTES else df


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, status, n) of each required column: ok or FAIL, and how many rows have a value there."""
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0).cast("long")).alias(f"n{i}") for i, c in enumerate(required)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit("ok" if c in df.columns else "FAIL").alias("status"), F.col(f"n{i}").alias("n")) for i, c in enumerate(required)]
    return counts.select(F.inline(F.array(*rows)))


def _ordinals(df: DataFrame) -> DataFrame:
    """(config, shard, ordinal, n_shards): a row for each shard."""
    one = df.select("config", "shard").distinct()
    order, all_ = Window.partitionBy("config").orderBy("shard"), Window.partitionBy("config")
    return one.select("config", "shard", (F.row_number().over(order) - 1).alias("ordinal"), F.count("*").over(all_).alias("n_shards"))


def first_shards(df: DataFrame, most: int) -> DataFrame:
    """Rows of each config's first shards, with the factor that scales their sums up to all."""
    chosen = _ordinals(df).where(F.col("ordinal") < most)
    scale = F.col("n_shards") / F.least("n_shards", F.lit(most))
    return df.join(chosen.select("config", "shard", scale.alias("scale")), ["config", "shard"])


def spread_shards(df: DataFrame, most: int) -> DataFrame:
    """Rows of at most `most` evenly spread shards of each config: places floor(i (n - 1) / (most - 1)), each once."""
    at = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n_shards") - 1) / max(most - 1, 1)).cast("int"))
    )
    chosen = _ordinals(df).where((F.col("n_shards") <= most) | F.array_contains(at, F.col("ordinal")))
    return df.join(chosen.select("config", "shard"), ["config", "shard"], "left_semi")


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def not_found(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header; every column is a string."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df if columns is None else project(df, columns)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines or parquet by extension; blank lines are skipped."""
    if path.rstrip("/").endswith((".jsonl", ".json")):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    return spark.read.parquet(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document that spans lines."""
    return spark.read.option("multiLine", True).json(path)


def attach_files(rows: DataFrame, spark: SparkSession, root: str, path_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their file's bytes, rows whose file is missing); path_col is relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    # Listings name files with or without the file system's authority: the part behind the root is the same.
    below = F.length(F.lit(whole)) if "://" in whole else F.length(F.lit(whole)) - F.length(F.lit("file:"))
    plain = F.regexp_replace("path", "^file:/*", "/") if "://" not in whole else F.col("path")
    files = files.select(F.substr(plain, below + 1).alias(path_col), F.col("content").alias("bytes"))
    return rows.join(files, path_col), rows.join(files.select(path_col), path_col, "left_anti")


def directory_size(spark: SparkSession, root: str) -> int:
    """Bytes of all files under root, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return int(files.agg(F.sum("length")).first()[0] or 0)


def read_split(spark: SparkSession, root: str, prefix: str, text_col: str = "text") -> DataFrame:
    """(audio, text, seconds) of the files root/<prefix>-*.parquet; none is an error. Rows without audio or text go; a
    row without a stated length gets that of its bytes (16-bit samples at 16 kHz behind a header of 44 bytes)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{root}/{prefix}-*.parquet")
    except AnalysisException as error:
        raise FileNotFoundError(f"no {prefix}-*.parquet under {root}") from error
    audio = F.col("audio.bytes") if isinstance(df.schema["audio"].dataType, T.StructType) else F.col("audio")
    stated = F.col("duration_ms").cast("string").try_cast("double") / 1000 if "duration_ms" in df.columns else F.lit(None).cast("double")
    guessed = F.greatest(F.length(audio) - 44, F.lit(0)) / 32000
    out = df.select(audio.alias("audio"), F.trim(F.col(text_col)).alias("text"), F.coalesce(stated, guessed).alias("seconds"))
    return out.where((F.length("audio") > 0) & (F.length("text") > 0))


TARGET = T.StructType(
    [
        T.StructField("config", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("duration", T.FloatType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("book", T.StringType()),
        T.StructField("audio", T.BinaryType()),
    ]
)


def to_schema(df: DataFrame, target: T.StructType = TARGET) -> DataFrame:
    """df in a fixed schema: casts, defaults for what is null or absent, audio from its struct or plain, book parsed."""
    from millrace.functions.parse import parse_source

    defaults = {T.StringType(): F.lit(""), T.FloatType(): F.lit(0.0), T.BinaryType(): F.lit(b"")}
    present = dict(df.dtypes)

    def value(f: T.StructField) -> Column:
        if f.name == "audio" and present.get("audio", "").startswith("struct"):
            held = F.col("audio.bytes")
        elif f.name == "book" and "book" not in present and "source_file" in present:
            held = parse_source(F.col("source_file"))["book"]
        elif f.name in present:
            held = F.col(f.name)
        else:
            held = F.lit(None)
        return F.coalesce(held.cast(f.dataType), defaults[f.dataType].cast(f.dataType)).alias(f.name)

    return df.select(*[value(f) for f in target])
