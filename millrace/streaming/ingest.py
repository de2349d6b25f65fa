"""Incremental ingest: every new file of a folder once, into partitions, and only when it is no longer being written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.profile import merged_states, profile_state


def ingest_new_files(
    spark: SparkSession, source: str, schema: T.StructType | str, out: str, checkpoint: str, transform=lambda df: df, key: str = "config"
) -> None:
    """Runs until all files present are taken, then ends; the checkpoint remembers them. A batch that is run again
    after a failure writes to the folder of its number and so replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy(key).parquet(f"{out}/batch={number}")

    query = (
        spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def look(spark: SparkSession, source: str, listings: str, number: int, pattern: str = "*.parquet") -> None:
    """One look at a folder: its files and their sizes as a small file of their own in `listings`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    told = files.select(F.lit(number).cast("long").alias("look"), "path", "length")
    told.coalesce(1).write.mode("append").parquet(listings)


def steady(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The file of a group's listings once two looks in a row have told the same size above 0; never again then."""
    size, taken = state.get if state.exists else (-1, False)
    for length in pd.concat(list(frames)).sort_values("look")["length"]:
        if length == size and length > 0 and not taken:
            taken = True
            yield pd.DataFrame({"path": [key[0]], "length": [int(length)]})
        size = int(length)
    state.update((size, taken))


def ingest_stable(
    spark: SparkSession, source: str, listings: str, checkpoint: str, number: int, take: Callable[[list[str], int], None], pattern: str = "*.parquet"
) -> None:
    """Looks at `source` (the number-th look) and hands the files that have settled since the one before to take(paths,
    batch). The state store holds a size and a flag for each file; a batch that is run again after a failure hands the
    same files on under the same number."""
    look(spark, source, listings, number, pattern)
    seen = spark.readStream.schema("look long, path string, length long").parquet(listings)
    settled = seen.groupBy("path").applyInPandasWithState(steady, "path string, length long", "size long, taken boolean", "append", GroupStateTimeout.NoTimeout)

    def batch(ready: DataFrame, k: int) -> None:
        paths = sorted(r["path"] for r in ready.select("path").collect())  # names of files that came in one look
        if paths:
            take(paths, k)

    settled.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ProfileStream:
    """A profile of all files that have settled in a folder, carried on from batch to batch. Each batch writes the state
    that its files add to that of the batch before, so one that is run again replaces its own."""

    def __init__(self, spark: SparkSession, source: str, root: str, schema: T.StructType | str) -> None:
        self.spark, self.source, self.root, self.schema, self.looks = spark, source, root, schema, 0

    def _states(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/states")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []

    def _take(self, paths: list[str], number: int) -> None:
        state = profile_state(self.spark.read.schema(self.schema).parquet(*paths))
        before = [k for k in self._states() if k < number]
        if before:
            state = merged_states(state.unionByName(self.spark.read.parquet(f"{self.root}/states/{before[-1]}"), allowMissingColumns=True))
        state.write.mode("overwrite").parquet(f"{self.root}/states/{number}")

    def step(self) -> None:
        """One look at the folder and, for what has settled, one batch."""
        self.looks += 1
        ingest_stable(self.spark, self.source, f"{self.root}/listings", f"{self.root}/checkpoint", self.looks, self._take)

    def state(self) -> DataFrame | None:
        held = self._states()
        return self.spark.read.parquet(f"{self.root}/states/{held[-1]}") if held else None


def apply_model(df: DataFrame, model, schema: T.StructType | str) -> DataFrame:
    """The hook for a model's inference: `model` maps an iterator of pandas frames to frames of `schema`."""
    return df.mapInPandas(model, schema)
