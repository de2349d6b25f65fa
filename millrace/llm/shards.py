"""Sharding by histogram sort.

Rows are ordered by (xxhash64 of the text, doc_id), so equal texts lie side by side. Splitters come from exact byte
counts below candidate key boundaries: each round counts the bytes of the sub-ranges of the ranges that still hold a
splitter, until every splitter is within the tolerance. Each shard has as many splitters within it as there are tasks
to share its rows, and rows move once, each to the task that the splitters name.

A group of equal texts is cut only where its bytes exceed the tolerance, and then along doc_id, and rows of equal text
and id along a number that tells repeated rows apart. A null text has no bytes (size 1) and sorts as an empty one, a
null doc_id sorts first; repeated rows are kept. An empty table gives no rows. Columns listed in `keep` are carried
along; one whose name a result column has comes back as kept_<name>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_of

#: Key bits that one round resolves, and the share of a shard's mean bytes by which a splitter may miss its target.
BITS, TOLERANCE = 10, 0.01
#: The same for the splitters within a shard, of the mean of what they part; there they only spread work.
WITHIN = 0.25
_LOW = -(1 << 63)


def _ranges(rows: DataFrame, key: str, bits: int, inside: list[int], cond: Column | None) -> dict[int, int]:
    """Exact bytes of each range of the leading `bits` of a signed key, within the parent ranges `inside`."""
    parent = F.shiftright(key, 64 - bits + BITS) if bits > BITS else F.lit(0)
    chosen = rows.where(cond) if cond is not None else rows
    if bits > BITS:
        chosen = chosen.where(parent.isin(*inside))
    got = chosen.groupBy(F.shiftright(key, 64 - bits).alias("r")).agg(F.sum("size").alias("b")).collect()
    return {r["r"]: r["b"] for r in got}


def _refine(rows: DataFrame, key: str, targets: dict[int, float], base: float, tolerance: float, cond: Column | None) -> dict:
    """For each splitter: ('cut', key value), or ('inside', key value, bytes below it) where one value holds too much."""
    found: dict[int, tuple] = {}
    #: splitter -> (range, bytes below the range) at the current depth
    open_ = {j: (0, base) for j in targets}
    for bits in [*range(BITS, 64, BITS), 64]:
        step = bits % BITS or BITS
        parents = sorted({r for r, _ in open_.values()})
        if bits == 64 and step != BITS:
            parent = F.shiftright(key, 64 - (64 - step))
            chosen = (rows.where(cond) if cond is not None else rows).where(parent.isin(*parents))
            got = {r["r"]: r["b"] for r in chosen.groupBy(F.col(key).alias("r")).agg(F.sum("size").alias("b")).collect()}
        else:
            got = _ranges(rows, key, bits, parents, cond)
        nxt = {}
        under: dict[int, list[int]] = {}
        for c in sorted(got):
            under.setdefault(c >> step if bits > BITS else 0, []).append(c)
        for j, (r, below) in open_.items():
            for c in under.get(r, ()):
                if below + got[c] >= targets[j]:
                    break
                below += got[c]
            else:
                found[j] = ("cut", None)
                continue
            if targets[j] - below <= tolerance:
                found[j] = ("cut", c << (64 - bits))
            elif below + got[c] - targets[j] <= tolerance:
                found[j] = ("cut", (c + 1) << (64 - bits) if (c + 1) << (64 - bits) < 1 << 63 else None)
            elif bits == 64:
                found[j] = ("inside", c, below)
            else:
                nxt[j] = (c, below)
        open_ = nxt
        if not open_:
            break
    return found


_KEYS = ("hash", "doc", "row")


def find_splitters(rows: DataFrame, n: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...] | None]:
    """Keys (hash, doc, row) at which parts 1 to n-1 begin; None: beyond all rows. rows: hash, doc, row, size. The
    histograms that come here have at most 1024 rows for each splitter."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [None] * (n - 1)
    allowed = max(1.0, tolerance * total / n)
    out: dict[int, tuple[int, ...] | None] = {}

    def settle(targets: dict[int, float], depth: int, prefix: tuple[int, ...], base: float) -> None:
        cond = None
        for key, value in zip(_KEYS, prefix):
            cond = F.col(key) == F.lit(value) if cond is None else cond & (F.col(key) == F.lit(value))
        found = _refine(rows, _KEYS[depth], targets, base, allowed, cond)
        rest = (_LOW,) * (len(_KEYS) - depth - 1)
        groups: dict[int, list[int]] = {}
        for j, f in found.items():
            if f[0] == "cut" and f[1] is not None:
                out[j] = (*prefix, f[1], *rest)
            elif f[0] == "cut" and not depth:
                out[j] = None
            elif f[0] == "cut":  # beyond the group: where the next key begins
                out[j] = (*prefix[:-1], prefix[-1] + 1, *rest, _LOW) if prefix[-1] + 1 < 1 << 63 else None
            elif depth + 1 < len(_KEYS):
                groups.setdefault(f[1], []).append(j)
            else:
                out[j] = (*prefix, f[1], *rest)
        for value, js in groups.items():  # at most n - 1 groups are too large to move whole
            settle({j: targets[j] for j in js}, depth + 1, (*prefix, value), found[js[0]][2])

    settle({j: total * j / n for j in range(1, n)}, 0, (), 0.0)
    return [out[j] for j in range(1, n)]


def _beyond(cut: tuple[int, ...]) -> Column:
    """Whether a row's key is the cut's or above."""
    told = F.col(_KEYS[-1]) >= F.lit(cut[-1])
    for key, value in list(zip(_KEYS, cut))[-2::-1]:
        told = (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & told)
    return told


def shard_documents(
    df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, doc, hash, row, size, shard, slot, *keep): each row's shard and its gapless place within it, in key order."""
    spark = df.sparkSession
    own = ("doc_id", "doc", "hash", "row", "size", "shard", "slot", "part", "place", "first", "before")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col), F.lit(_LOW)).alias("doc"),
        F.xxhash64(text_of(text_col)).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long").alias("size"),
        *[F.col(c).alias(f"kept_{c}" if c.lower() in own else c) for c in keep],
    )
    rows = materialise(rows, "shard-keys")
    cuts = [c for c in find_splitters(rows, n_shards) if c is not None]
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    inner = find_splitters(rows, n_shards * each, WITHIN) if each > 1 else []
    every = sorted({*cuts, *(c for j, c in enumerate(inner, 1) if j % each and c is not None)})

    def placed(cuts: list, lo: int, hi: int) -> Column:
        """How many of cuts[:hi] a row reaches, knowing that it reaches cuts[:lo]: told by halves."""
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(_beyond(cuts[middle]), placed(cuts, middle + 1, hi)).otherwise(placed(cuts, lo, middle))

    told = {"part": placed(every, 0, len(every)).cast("int"), "shard": placed(cuts, 0, len(cuts)).cast("int")}
    moved = rows.withColumns(told).repartitionById(len(every) + 1, "part")
    moved = moved.sortWithinPartitions("part", *_KEYS).withColumn("place", F.monotonically_increasing_id())
    moved = materialise(moved, "shard-rows")
    # One row for each part.
    runs = moved.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = moved.join(F.broadcast(runs), "part")
    return out.withColumn("slot", F.col("place") - F.col("first") + F.col("before")).drop("place", "first", "before", "part")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(text_of("text").cast("binary")).alias("text_crc32")
    )
    return shard_documents(docs, 16, keep=("text_crc32",)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
