"""Batches by padded cost, and shards by size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.interim import materialise

from .splits import SEED, shuffled


_UNBOUNDED = 1 << 62
#: Bits of a row's number within a block: a block holds 2^16 rows at most, however many a partition has.
BLOCK_BITS = 16


def _rooms(values: np.ndarray, budget: float, most: int | None) -> np.ndarray:
    """How many rows may be together where each of these ascending values is the longest."""
    positive = values > 0
    room = np.full(len(values), _UNBOUNDED, np.int64)
    held = values[positive]
    n = np.floor(np.minimum(budget / held, float(_UNBOUNDED // 2))).astype(np.int64)
    for _ in range(2):  # quotients are rounded: what counts is the product
        n += (n + 1) * held <= budget
        n -= (n > 0) & (n * held > budget)
    room[positive] = n
    return np.minimum(room, most) if most else room


def _ends(room: np.ndarray) -> np.ndarray:
    """The last row of the batch that starts at each row: one row at least, then as many as each row's room allows."""
    at = np.arange(len(room))
    return np.maximum(np.searchsorted(np.maximum.accumulate(at + 1 - room), at, "right"), at + 1) - 1


def batch_rule(values: np.ndarray, budget: float, most: int | None = None) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of ascending values does to the batch that is open before it: (batches begun after the first, rows in
    the last) if none is; then, for an open one, `spare`, falling: the first place k with more rows in it than spare[k]
    names how many batches are begun and how many rows the last one has. If there is none, all rows join it. Places of
    equal outcomes are one entry."""
    n = len(values)
    room = _rooms(values, budget, most)
    ends = _ends(room)
    begun, last = [0] * (n + 1), [0] * (n + 1)
    for at in range(n - 1, -1, -1):
        end = int(ends[at])
        begun[at], last[at] = (begun[end + 1] + 1, last[end + 1]) if end < n - 1 else (0, n - at)
    least = np.minimum.accumulate(room - np.arange(n) - 1)
    falls = np.flatnonzero(np.diff(least, prepend=_UNBOUNDED) < 0)
    spare, count, rest = [], [], []
    for at in falls:
        # With more rows held than this, the batch ends before this row, if not before an earlier one.
        if not count or (count[-1], rest[-1]) != (begun[at] + 1, last[at]):
            spare.append(int(least[at]))
            count.append(begun[at] + 1)
            rest.append(last[at])
        elif count:
            spare[-1] = int(least[at])
        if least[at] < 1:
            break
    return begun[0], last[0], np.array(spare, np.int64), np.array(count, np.int64), np.array(rest, np.int64)


def batch_starts(rules: list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(rows held, batch) before each block, from (rows, *batch_rule) of all blocks in order."""
    out, held, batch = [], 0, 0
    for n, begun, last, spare, count, rest in rules:
        out.append((held, batch))
        if not held:
            held, batch = last, batch + begun
            continue
        at = int(np.searchsorted(-np.asarray(spare), -held, "right"))
        if at < len(spare):
            held, batch = int(rest[at]), batch + int(count[at])
        else:
            held += n
    return out


def block_batches(values: np.ndarray, budget: float, most: int | None, held: int, batch: int) -> np.ndarray:
    """The batch of each row of a block that starts with so many rows held in this batch."""
    n = len(values)
    room = _rooms(values, budget, most)
    ends = _ends(room)
    out, at = np.empty(n, np.int64), 0
    if held:
        late = np.flatnonzero(room - np.arange(n) - 1 < held)
        at = int(late[0]) if len(late) else n
        out[:at] = batch
        batch += 1
    while at < n:
        end = int(ends[at])
        out[at : end + 1] = batch
        at, batch = end + 1, batch + 1
    return out


def length_buckets(df: DataFrame, budget: float, most: int | None = None, keys: tuple[str, ...] = ("config",), order: tuple[str, ...] = ("id",)) -> DataFrame:
    """df plus its batch: ascending durations, a new batch where longest x (rows + 1) would exceed the budget.

    Whether a row joins depends on all before it. So rows are sorted by range into blocks, a block's task tells what the
    block does to any batch that is open before it, these short rules are folded in order for each key, and each block
    then deals its rows from where it starts: no task holds more of a key than a block. What is sorted and written once
    are keys, durations and `order`, without the rest of the rows. A row without a duration counts as one of none; rows
    of one duration go by `order`, and equal ones by a number."""
    places = [f"_o{i}" for i in range(len(order))]
    held = df.withColumns({"_g": F.to_json(F.struct(*keys)), "_d": F.coalesce(F.nanvl(F.col("duration").cast("double"), F.lit(0.0)), F.lit(0.0)), **{p: F.col(c) for p, c in zip(places, order)}})
    line = ["_g", "_d", *places, "_n"]
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy("_g", "_d", *places).orderBy(F.lit(0))))
    rows = held.select(*line).repartitionByRange(*line).sortWithinPartitions(*line)
    # The number holds the partition above bit 33, and so the block above BLOCK_BITS; the table is written, so it stays.
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "by-length")
    rows = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("row")["_d"].to_numpy(np.float64)
        begun, last, spare, count, rest = batch_rule(values, budget, most)
        told = {"n": len(values), "begun": begun, "last": last, "spare": [spare], "count": [count], "rest": [rest]}
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1].tolist(), "block": int(pdf["block"].iloc[0]), **told})

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        told = batch_starts(list(zip(*(pdf[c] for c in ("n", "begun", "last", "spare", "count", "rest")))))
        return pd.DataFrame({"_g": pdf["_g"], "block": pdf["block"], "held": [t[0] for t in told], "first": [t[1] for t in told]})

    def deal(part: pa.Table, begin: pa.Table) -> pa.Table:
        part, begin = part.sort_by("row"), begin.slice(0, 1).to_pydict()
        batches = block_batches(part["_d"].to_numpy(), budget, most, begin["held"][0], begin["first"][0])
        return part.select(line).append_column("batch", pa.array(batches, pa.int64()))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in line)
    rules = rows.select("_g", "block", "row", "_d").groupBy("_g", "block").applyInPandas(tell, "_g string, block long, n long, begun long, last long, spare array<long>, count array<long>, rest array<long>")
    starts = rules.groupBy("_g").applyInPandas(start, "_g string, block long, held long, first long")
    cut = rows.groupBy("_g", "block").cogroup(starts.groupBy("_g", "block")).applyInArrow(deal, f"{kinds}, batch long")
    same = (held["_g"] == cut["_g"]) & (held["_d"] == cut["_d"]) & (held["_n"] == cut["_n"])
    for p in places:
        same = same & held[p].eqNullSafe(cut[p])
    return held.join(cut, same).select(*[held[c] for c in df.columns], "batch")


def shuffle_batches(batches: DataFrame, epoch: int, seed: int = SEED, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """(keys, batch, place): batches of an epoch in shuffled order."""
    one = batches.select(*keys, "batch").distinct()
    order = Window.partitionBy(*keys).orderBy(shuffled(seed + epoch, F.col("batch").cast("string")), "batch")
    return one.withColumn("place", F.row_number().over(order).cast("long"))


def _cuts(sizes: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first n sizes (0 <= size <= limit), and for each start the row that ends its shard (len if none)."""
    sums = np.concatenate([[0.0], np.cumsum(sizes)])
    ends = np.searchsorted(sums[1:], sums[:-1] + limit, "left")
    return sums, np.maximum(ends, np.arange(len(sizes)))


def block_rule(sizes: np.ndarray, limit: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of rows does to the size held before it: (whole, upto, shards, left).

    A shard ends in the block if held + whole reaches the limit. The first of `upto` that held brings to the limit names how
    many shards end in the block and what is held after it. Only the first shard's worth of rows can be such a first
    end, and ends with equal outcomes are one entry, so the rule stays small however long the block is."""
    sums, ends = _cuts(sizes, limit)
    n = len(sizes)
    shards, left = [0] * (n + 1), [0.0] * (n + 1)
    for at in range(n - 1, -1, -1):
        end = int(ends[at])
        shards[at] = shards[end + 1] + 1 if end < n else 0
        left[at] = left[end + 1] if end < n else float(sums[n] - sums[at])
    upto, count, rest = [], [], []
    for end in range(min(n, int(ends[0]) + 1) if n else 0):
        reach = float(sums[end + 1])
        if upto and reach == upto[-1]:
            continue
        if upto and (count[-1], rest[-1]) == (shards[end + 1] + 1, left[end + 1]):
            upto[-1] = reach
        else:
            upto.append(reach)
            count.append(shards[end + 1] + 1)
            rest.append(left[end + 1])
    return float(sums[n]), np.array(upto, np.float64), np.array(count, np.int64), np.array(rest, np.float64)


def block_starts(rules: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]], limit: float) -> list[tuple[float, int]]:
    """(size held, shard) before each block, from the rules of all blocks in order."""
    out, held, shard = [], 0.0, 0
    for whole, upto, count, rest in rules:
        out.append((held, shard))
        first = int(np.searchsorted(upto, limit - held, "left"))
        if first < len(upto):
            held, shard = float(rest[first]), shard + int(count[first])
        else:
            held += whole
    return out


def block_shards(sizes: np.ndarray, limit: float, held: float, shard: int) -> np.ndarray:
    """The shard of each row of a block that starts with this size held in this shard."""
    sums, ends = _cuts(sizes, limit)
    out, at = np.empty(len(sizes), np.int64), 0
    end = int(np.searchsorted(sums[1:], limit - held, "left"))
    while at < len(sizes):
        out[at : end + 1] = shard
        at, shard = end + 1, shard + 1
        end = int(ends[at]) if at < len(sizes) else at
    return out


def size_shards(df: DataFrame, limit: float, key: str = "config", order: str = "pos", size: str = "size") -> DataFrame:
    """df plus its shard: a shard ends with the row that brings it to the limit.

    The rule looks back to the last cut. So a key's rows are sorted by range into blocks, a block's task tells what the
    block does to any size held before it, these short rules are folded in order for each key, and each block then deals
    its rows from where it starts: no task holds more of a key than a block. The sorted (key, place, size) rows are
    written once. Rows of one place go by size, those without a place come first; a row without a size, or with one
    below nothing, has none. Sums are exact for whole sizes, and within a block sums of others are rounded once a row."""
    limit = max(float(limit), 0.0)
    kind, at_kind = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    # A row of more than the limit ends its shard like one of the limit. The number of a row among those of its place:
    # rows of one place and size may stand for each other.
    sized = df.withColumn("_s", F.least(F.greatest(F.coalesce(F.nanvl(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(limit)))
    sized = sized.withColumn("_n", F.row_number().over(Window.partitionBy(key, order).orderBy("_s")).cast("long"))
    narrow = sized.select(F.col(key).alias("k"), F.col(order).alias("at"), F.col("_n").alias("nth"), F.col("_s").alias("size"))
    sorted_rows = narrow.repartitionByRange("k", "at", "nth").sortWithinPartitions("k", "at", "nth")
    # The number holds the partition above bit 33, and so the block above BLOCK_BITS; the table is written, so it stays.
    rows = materialise(sorted_rows.withColumn("row", F.monotonically_increasing_id()), "by-place")
    rows = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, upto, count, rest = block_rule(pdf.sort_values("row")["size"].to_numpy(np.float64), limit)
        return pd.DataFrame({"k": pdf["k"].iloc[:1].tolist(), "block": int(pdf["block"].iloc[0]), "whole": whole, "upto": [upto], "count": [count], "rest": [rest]})

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        told = block_starts(list(zip(pdf["whole"], pdf["upto"], pdf["count"], pdf["rest"])), limit)
        return pd.DataFrame({"k": pdf["k"], "block": pdf["block"], "held": [t[0] for t in told], "shard": [t[1] for t in told]})

    def deal(part: pa.Table, begin: pa.Table) -> pa.Table:
        part, begin = part.sort_by("row"), begin.slice(0, 1).to_pydict()
        shards = block_shards(part["size"].to_numpy(), limit, begin["held"][0], begin["shard"][0])
        return part.select(["k", "at", "nth"]).append_column("shard_id", pa.array(shards, pa.int64()))

    rules = rows.select("k", "block", "row", "size").groupBy("k", "block").applyInPandas(tell, f"k {kind}, block long, whole double, upto array<double>, count array<long>, rest array<double>")
    starts = rules.groupBy("k").applyInPandas(start, f"k {kind}, block long, held double, shard long")
    cut = rows.groupBy("k", "block").cogroup(starts.groupBy("k", "block")).applyInArrow(deal, f"k {kind}, at {at_kind}, nth long, shard_id long")
    same = sized[key].eqNullSafe(cut["k"]) & sized[order].eqNullSafe(cut["at"]) & (sized["_n"] == cut["nth"])
    return sized.join(cut, same).select(*[sized[c] for c in df.columns], "shard_id")
