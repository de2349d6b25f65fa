"""Lookups of rows by id that read little: a layout in order of ids whose row groups Parquet can pass over, and a search
through shards that begins with the likely ones and ends with the last row found."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .interim import folder, materialise

#: Rows of a row group and of a page, and false matches that a row group's bloom filter may give.
GROUP_ROWS, PAGE_ROWS, FALSE_MATCHES = 20_000, 1_000, 0.01
#: Ids up to which a lookup names them in its filter; more are joined, and then all row groups are read.
NAMED_IDS = 10_000


def write_by_id(df: DataFrame, path: str, key: str = "id", files: int | None = None, group_rows: int = GROUP_ROWS, page_rows: int = PAGE_ROWS) -> None:
    """df as Parquet files that follow each other in order of `key`. Their row groups and pages are short and hold
    their least and largest ids; each row group has a bloom filter of its ids."""
    spread = df.repartitionByRange(key) if files is None else df.repartitionByRange(files, key)
    writer = spread.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd")
    for name, value in {
        "parquet.block.row.count.limit": group_rows,
        "parquet.page.row.count.limit": page_rows,
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.expected.ndv#{key}": group_rows,
        f"parquet.bloom.filter.fpp#{key}": FALSE_MATCHES,
    }.items():
        writer = writer.option(name, str(value))
    writer.parquet(path)


def lookup_by_id(spark: SparkSession, path: str, ids: DataFrame, key: str = "id", columns: list[str] | None = None, named: int = NAMED_IDS) -> DataFrame:
    """The rows of a table that write_by_id wrote whose `key` is among ids. Up to `named` ids go into the scan's filter,
    where row groups and pages that can't hold any are not read; more are joined. The session's limit of values in a
    filter is raised to their number."""
    table = spark.read.parquet(path)
    table = table if columns is None else table.select(*dict.fromkeys([key, *columns]))
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    first = [r[0] for r in wanted.limit(named + 1).collect()]
    if len(first) > named:
        return table.join(wanted, key, "left_semi")
    limit = "spark.sql.parquet.pushdown.inFilterThreshold"
    if int(spark.conf.get(limit)) < len(first):
        spark.conf.set(limit, str(len(first)))
    return table.where(F.col(key).isin(*first))


def rows_scanned(df: DataFrame) -> int:
    """Runs a plan that is one scan and filters and returns the rows that came out of its files."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    execution.toRdd().count()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if not children.size() and node.metrics().contains("numFiles"):
            total += node.metrics().apply("numOutputRows").value()
    return int(total)


def write_shards_apart(df: DataFrame, path: str, keys: tuple[str, str] = ("config", "shard")) -> None:
    """A folder for each shard of each partition, so a scan opens those that it names."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


@dataclass
class Search:
    """found: each wanted row once, from the first shard in order that holds it; missing: what no shard holds; read: the
    shards that were opened, with the wave that did."""

    found: DataFrame
    missing: DataFrame
    read: DataFrame


def waves(places: DataFrame, first: int) -> DataFrame:
    """places (config, shard, place from 0) with their wave: of `first` shards, then twice as many, and so on."""
    return places.withColumn("wave", F.floor(F.log2(F.col("place") / first + 1)).cast("int"))


def find_in_waves(
    spark: SparkSession, root: str, wanted: DataFrame, hints: DataFrame, first: int = 2, order: tuple[str, ...] = (), key: str = "id"
) -> Search:
    """Rows of root/config=*/shard=* with a wanted (config, id). Each partition's hinted shards are searched first, then
    the rest, in waves; a partition whose ids are all found is left alone. `order` names columns that choose among rows
    of one id in one shard. What is still wanted is a written table that shrinks; the driver knows shards only."""
    every = _shards(spark, root)
    told = every.join(hints.select("config", "shard", F.lit(0).alias("late")).distinct(), ["config", "shard"], "left")
    place = Window.partitionBy("config").orderBy(F.coalesce("late", F.lit(1)), "shard")  # a row a shard
    placed = waves(told.withColumn("place", F.row_number().over(place) - 1), first)
    placed = materialise(placed.select("config", "shard", "place", "wave"), "places")
    todo = materialise(wanted.select("config", key).distinct(), "wanted")
    found, read, wave = [], [], 0
    last = placed.agg(F.max("wave")).first()[0]
    while last is not None and wave <= last:
        shards = placed.where(F.col("wave") == wave).join(todo.select("config").distinct(), "config", "left_semi").collect()
        if shards:
            paths = [f"{root}/config={r['config']}/shard={r['shard']}" for r in shards]
            rows = spark.read.option("basePath", root).parquet(*paths)
            read += [(r["config"], r["shard"], r["place"], r["wave"]) for r in shards]
            met = rows.join(todo, ["config", key], "left_semi").join(F.broadcast(placed.select("config", "shard", "place")), ["config", "shard"])
            best = Window.partitionBy("config", key).orderBy("place", *order)
            met = met.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "place")
            found.append(materialise(met, "found"))
            todo = materialise(todo.join(found[-1].select("config", key), ["config", key], "left_anti"), "wanted")
        if todo.isEmpty():
            break
        wave += 1
    met = _all(found) if found else spark.read.parquet(root).limit(0)
    return Search(met, todo, spark.createDataFrame(read, "config string, shard int, place int, wave int"))


def _shards(spark: SparkSession, root: str) -> DataFrame:
    """(config, shard) of the folders under root, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    return files.select(part("config").alias("config"), part("shard").cast("int").alias("shard")).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own among the application's intermediate tables."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
