"""Packed splits: a Parquet sink with files {split}-00000-of-00007.parquet of a stated size, row groups of a stated size, a
page index and values of its own in the footer.

The sink is a Python data source. A task writes each of its shards under a temporary name and states it in its commit
message; when all tasks are through, the driver moves the files to their names. If one fails, the driver removes what
there is, and no shard appears. Paths must be ones that pyarrow's file systems reach.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from millrace.operators.batching import size_shards

from .interim import materialise

FORMAT = "millrace_packs"
_SPLIT, _SHARD, _SHARDS, _ROWS, _FILE = "_pack_split", "_pack_shard", "_pack_shards", "_pack_rows", "_pack_file"
_CONTROL = [_SPLIT, _SHARD, _SHARDS, _ROWS, _FILE]


def file_system(path: str):
    """(file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final names of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, footer: dict[str, str], replace: bool) -> None:
        self.path, self.footer, self.replace, self.job = path.rstrip("/"), footer, replace, uuid.uuid4().hex

    def _temporary(self) -> str:
        return f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        system, within = file_system(self._temporary())
        system.create_dir(within, recursive=True)
        out, name, writer, sink, held, rows, most = Written(), None, None, None, [], 0, 1

        def flush(last: bool) -> None:
            nonlocal held, rows
            table = pa.Table.from_batches(held) if held else None
            at = 0
            while table is not None and (rows - at >= most or (last and at < rows)):
                writer.write_table(table.slice(at, most), row_group_size=most)
                at += most
            held = table.slice(at).to_batches() if table is not None and at < rows else []
            rows = max(0, rows - at)

        def close() -> None:
            if writer is not None:
                flush(True)
                writer.close()
                sink.close()

        try:
            for batch in iterator:
                control = pa.Table.from_batches([batch]).select(_CONTROL).to_pandas()
                # A task's rows come in order of files.
                edges = [0, *(control.index[1:][control[_FILE].to_numpy()[1:] != control[_FILE].to_numpy()[:-1]]), batch.num_rows]
                for lo, hi in zip(edges, edges[1:]):
                    if hi <= lo:
                        continue
                    split, shard, shards, most_rows = control.loc[lo, [_SPLIT, _SHARD, _SHARDS, _ROWS]]
                    part = batch.slice(lo, hi - lo)
                    part = part.select([c for c in part.schema.names if c not in _CONTROL])
                    final = f"{split}-{int(shard):05d}-of-{int(shards):05d}.parquet"
                    if final != name:
                        close()
                        name, most = final, int(most_rows)
                        temporary = f"{within}/{uuid.uuid4().hex}.parquet"
                        out.files.append((temporary, final))
                        schema = part.schema.with_metadata({**(part.schema.metadata or {}), **self.footer})
                        sink = system.open_output_stream(temporary)
                        writer = pq.ParquetWriter(sink, schema, compression="zstd", write_page_index=True)
                    held.append(part)
                    rows += part.num_rows
                    flush(False)
            close()
        except BaseException:
            with contextlib.suppress(Exception):  # the file goes in any case
                if writer is not None:
                    writer.close()
                    sink.close()
            for temporary, _ in out.files:
                if system.get_file_info(temporary).is_file:
                    system.delete_file(temporary)
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, within = file_system(self.path)
        if self.replace:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(within)):
                if old.is_file and old.path.endswith(".parquet"):
                    system.delete_file(old.path)
        for message in messages:
            for temporary, final in message.files if message else ():
                system.move(temporary, f"{within}/{final}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, within = file_system(self._temporary())
        for path in (within, within.rsplit("/", 1)[0]):  # the job's folder, then that of all jobs if it is empty
            info = system.get_file_info(path)
            if info.type.name == "Directory":
                from pyarrow import fs

                if path == within or not system.get_file_info(fs.FileSelector(path)):
                    system.delete_dir(path)


class Packs(DataSource):
    """The sink: options path and footer (JSON of the footer's own keys and values)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], json.loads(self.options.get("footer", "{}")), overwrite)


def pack(
    df: DataFrame, path: str, blob: str, split: str = "split", order: str = "pos", shard_mb: float = 400.0, row_group_mb: float = 24.0, footer: dict[str, str] | None = None
) -> None:
    """Writes df, without `split`, in shards of each split: rows run by `order`, a shard ends with the row that brings the
    bytes of `blob` to shard_mb, and has row groups of row_group_mb over the shard's mean bytes, of one row at least. A
    row without a split is of `train`. Files of an earlier run go when the new ones are all written."""
    df.sparkSession.dataSource.register(Packs)
    rows = df.withColumn(_SPLIT, F.when(F.col(split) != "", F.col(split)).otherwise("train")).withColumn("_pack_size", F.octet_length(blob))
    cut = size_shards(rows, shard_mb * 1e6, key=_SPLIT, order=order, size="_pack_size").withColumnRenamed("shard_id", _SHARD)
    cut = materialise(cut, "packs")
    mean = F.greatest(F.coalesce(F.avg("_pack_size"), F.lit(0.0)), F.lit(1.0))
    shards = cut.groupBy(_SPLIT, _SHARD).agg(F.greatest(F.floor(row_group_mb * 1e6 / mean), F.lit(1)).alias(_ROWS))
    place = F.row_number().over(Window.orderBy(_SPLIT, _SHARD)) - 1  # a row a shard
    shards = materialise(shards.select("*", F.count("*").over(Window.partitionBy(_SPLIT)).alias(_SHARDS), place.alias(_FILE)), "pack-shards")
    moved = cut.join(F.broadcast(shards), [_SPLIT, _SHARD]).repartitionById(max(1, shards.count()), _FILE).sortWithinPartitions(_FILE, order)
    kept = [c for c in df.columns if c != split]
    writer = moved.select(*kept, *_CONTROL).write.format(FORMAT).mode("overwrite").option("footer", json.dumps(footer or {}))
    writer.save(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, n_groups, group_rows, footer): what the footers of a pack's files say; footer as JSON."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in parts:
            out = []
            for name in pdf["path"]:
                system, within = file_system(name.replace("file:///", "/").replace("file:/", "/"))
                with system.open_input_file(within) as f:
                    told = pq.ParquetFile(f).metadata
                    own = {k.decode(): v.decode("utf-8", "replace") for k, v in (told.metadata or {}).items() if k != b"ARROW:schema"}
                    out.append((within.rsplit("/", 1)[1], told.num_rows, told.num_row_groups, told.row_group(0).num_rows if told.num_row_groups else 0, json.dumps(own)))
            yield pd.DataFrame(out, columns=["file", "n_rows", "n_groups", "group_rows", "footer"])

    return files.mapInPandas(run, "file string, n_rows long, n_groups long, group_rows long, footer string")
