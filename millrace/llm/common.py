"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to a Python worker: with long texts, a few MB.
BATCH_ROWS = 2048
#: Bytes of one in the pipeline.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size for Python workers to BATCH_ROWS and leaves it so: plans read it when they run,
    which is after an operator has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bound_bytes(spark: SparkSession) -> None:
    """Bounds the session's batches for Python workers at BATCH_BYTES as well and leaves it so: a JVM keeps the buffers
    of its largest batches outside its heap, for every thread that had one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _filesystem(spark, path)
    return fs.exists(where)


#: Makes Spark delete a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, writes leave no shuffle files; the caller's session gets its setting back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing,
    and the planner knows the table's true size. Its shuffle files go at once, so disk holds those of one step at a time.
    The application's folder goes when its driver ends; discard() frees a table earlier."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    where, fs = _filesystem(spark, folder)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and no later plan reads."""
    for t in tables:
        where, fs = _filesystem(t.sparkSession, t._millrace_path)
        fs.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no column of it in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_of(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: What a Python worker keeps from task to task, by the module that keeps it.
_KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    """A worker's own store for a module's tasks, emptied as soon as a task of another module runs there."""
    return _KEPT.setdefault(module, {})


def trim() -> None:
    """Gives what allocators keep back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def _give_back() -> None:
    import gc

    gc.collect()
    trim()


def _begin(module: str) -> None:
    others = [held for name, held in _KEPT.items() if name != module and held]
    for held in others:
        held.clear()
    if others:
        _give_back()
    else:
        trim()


def tidy(run):
    """A batch function that gives freed memory back to the system when its task ends: workers live on, and with them
    what allocators keep. What a task left that ended otherwise, and what tasks of other modules keep in the worker,
    goes before it begins."""

    def tidied(batches):
        _begin(run.__module__)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied
