"""Intermediate tables, written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of
    its own and any other is refused, since its executors may share none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    where, fs = _filesystem(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing,
    and the planner knows the table's true size. discard() frees a table before its application ends. options: the
    writer's."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and no later plan reads."""
    for t in tables:
        where, fs = _filesystem(t.sparkSession, t._millrace_path)
        fs.delete(where, True)
