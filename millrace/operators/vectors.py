"""Similarity and clustering of clip embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import bound, norm
from millrace.sources.interim import materialise


def l2_normalize(df: DataFrame, column: str = "vector", least: float = 1e-6) -> DataFrame:
    """Rows with a vector of some length, scaled to one."""
    kept = df.withColumn("_n", norm(F.col(column))).where(F.col("_n") > least)
    return kept.withColumn(column, F.transform(column, lambda x: x / F.col("_n"))).drop("_n")


def _meetings(df: DataFrame, rows_per_block: int, by_book: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys): clips dealt to blocks; each pair of blocks meets in one equi-join key, so that no side is
    broadcast and every task holds two blocks. By book, blocks are those of a book and only they meet. Clips without an
    id or a length meet nothing, nor do vectors of different sizes."""
    held = ("vec_id", "book", "vector", "n")
    lengthy = df.select("vec_id", "book", "vector", F.size("vector").alias("dims"), norm(F.col("vector")).alias("n"))
    lengthy = lengthy.where("n > 1e-6 AND vec_id IS NOT NULL")
    keys = ["dims", "i", "j"]
    if by_book:
        lengthy = lengthy.where("book IS NOT NULL").withColumn("of", F.col("book"))
        sizes = df.where("book IS NOT NULL").groupBy(F.col("book").alias("of")).agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"))
        dealt, keys = lengthy.join(sizes, "of"), ["of", *keys]
    else:
        dealt = lengthy.withColumn("blocks", F.lit(max(1, -(-df.count() // rows_per_block))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    fresh = lambda: dealt.select([F.col(c).alias(c) for c in dealt.columns])
    left = fresh().withColumn("i", F.col("block")).withColumn("j", F.explode(F.filter(every, lambda j: j >= F.col("block"))))
    right = fresh().withColumn("j", F.col("block")).withColumn("i", F.explode(F.filter(every, lambda i: i <= F.col("block"))))
    return left.select(*keys, *held), right.select(*keys, *held), keys


def _unit(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["vector"].tolist(), float) / rows["n"].to_numpy()[:, None]


def similarity_pairs(df: DataFrame, rows_per_block: int = 8192, stripe: int = 64) -> DataFrame:
    """(a, b, book_a, book_b, cosine) of all pairs a < b of one partition's clips; each pair of clips meets once. Blocks
    are written once, a row and a file each, and tasks read the two that they compare (a Cartesian product of rows), so
    no copies of clips are shuffled. A task holds two blocks in Python and returns the pairs of a stripe of one with the other at a
    time. Batches for Python workers are bounded in the caller's session, which keeps the setting: a pair of rows each."""
    spark = df.sparkSession
    ids, books = (df.schema[c].dataType.simpleString() for c in ("vec_id", "book"))
    lengthy = df.select("vec_id", "book", "vector", F.size("vector").alias("dims"), norm(F.col("vector")).alias("n"))
    lengthy = lengthy.where("n > 1e-6 AND vec_id IS NOT NULL")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-df.count() // rows_per_block)))).cast("int")
    rows = lengthy.groupBy("dims", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "book", "n", "vector")).alias("clips"))
    rows = materialise(rows, "blocks", maxRecordsPerFile=1)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))

    def side(column: pa.ListArray, row: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        first, last = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
        named, book, n, vector = column.values.slice(first, last - first).flatten()
        return named, book, n.to_numpy(), np.asarray(vector.flatten().to_numpy(), float).reshape(len(named), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (left, book_a, m, x), (right, book_b, n, y) = side(batch.column(1), row), side(batch.column(2), row)
                alone = batch.column(0)[row].as_py()  # within a block each pair occurs twice, across blocks once
                first, second = (v.to_numpy(zero_copy_only=False) for v in (left, right))
                named, book = pa.concat_arrays([left, right]), pa.concat_arrays([book_a, book_b])
                for lo in range(0, len(x), stripe):
                    at = slice(lo, lo + stripe)
                    cosine = x[at] @ y.T / (m[at, None] * n[None])
                    i, j = np.nonzero(first[at, None] < second[None] if alone else np.ones(cosine.shape, bool))
                    ordered = first[at][i] < second[j]
                    p, q = lo + i, len(x) + j
                    a, b = pa.array(np.where(ordered, p, q)), pa.array(np.where(ordered, q, p))
                    columns = [named.take(a), named.take(b), book.take(a), book.take(b), pa.array(cosine[i, j])]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "book_a", "book_b", "cosine"])

    left = rows.select("dims", F.col("block").alias("i"), F.col("clips").alias("left"))
    right = rows.select(F.col("dims").alias("of"), F.col("block").alias("j"), F.col("clips").alias("right"))
    both = left.hint("shuffle_replicate_nl").join(right, (F.col("dims") == F.col("of")) & (F.col("i") <= F.col("j")))
    told = both.select((F.col("i") == F.col("j")).alias("alone"), "left", "right")
    return told.mapInArrow(run, f"a {ids}, b {ids}, book_a {books}, book_b {books}, cosine double")


#: Bins of a round, values that are gathered once a bin holds no more, clips of a block, and those of one whose cosines
#: with the other are held at once (2 MB, which a core's cache holds).
BINS, SMALL, BLOCK, NARROW = 8192, 65536, 8192, 32
_PART = "target int, bins array<int>, vals array<double>, counts array<long>, total double, low double, high double"


def _stripes(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of x, their products with y) a stripe at a time, all in the same memory."""
    turned, buffer = np.ascontiguousarray(y.T), np.empty((NARROW, len(y)))
    for lo in range(0, len(x), NARROW):
        part = x[lo : lo + NARROW]
        yield slice(lo, lo + len(part)), np.matmul(part, turned, out=buffer[: len(part)])


def _places(values: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """The bin of each value from low to high."""
    at = values - low
    at /= high - low
    at *= bins
    return at.astype(np.int32)


def _inside(values: np.ndarray, chain: list[tuple[float, float, int]], bins: int) -> np.ndarray:
    """Which values fell into each chosen bin (low, high, bin) of the rounds so far."""
    out = np.ones(len(values), bool)
    for low, high, chosen in chain:
        out &= np.clip(_places(values, low, high, bins), 0, bins - 1) == chosen
    return out


def _sifted(df: DataFrame, targets: list[tuple[str, list, bool]], bins: int, rows_per_block: int, by_book: bool) -> DataFrame:
    """Counts of the cosines of all pairs, without pair rows: for each target (kind, chain, whether values are wanted) a
    row of bin -1 with number, sum, least and largest of the values that its chain leaves (in the first round, -1 and 1
    for the last two), and a row for each bin of the next round or for each distinct value. A task holds two blocks and
    the cosines of a stripe of one with the other."""
    left, right, keys = _meetings(df, rows_per_block, by_book)
    first = not targets[0][1]  # no target has a chain in the first round, all have later

    def of_all(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, earlier) -> Iterator[tuple]:
        tally, total = np.zeros(2 * bins + 1, np.int64), np.zeros(2)
        for at, cosine in _stripes(x, y):
            places = _places(cosine, *_range([], bins), bins)
            same = (a[at, None] == b[None]) & (a[at, None] >= 0)
            np.add(places, bins, out=places, where=same)
            if earlier is not None:
                counts = earlier(at)
                places[~counts] = 2 * bins
                within = cosine[counts & same].sum()
                total += within, cosine[counts].sum() - within
            tally += np.bincount(places.reshape(-1), minlength=2 * bins + 1)
        if earlier is None:  # each sum of cosines is a product of the sums of unit vectors
            sums = [np.zeros((max(a.max(), b.max()) + 1, x.shape[1])) for _ in range(2)]
            for held, side, codes in zip(sums, (x, y), (a, b)):
                np.add.at(held, codes[codes >= 0], side[codes >= 0])
            within = (sums[0] * sums[1]).sum()
            total += within, x.sum(axis=0) @ y.sum(axis=0) - within
        for t, (kind, _, _) in enumerate(targets):
            i = int(kind == "within")
            n = tally[i * bins : (i + 1) * bins]
            if n.any():
                yield t, [-1], [], [n.sum()], total[1 - i], -1.0, 1.0
                yield t, np.flatnonzero(n), [], n[n > 0], 0.0, None, None

    def of_bins(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, earlier) -> Iterator[tuple]:
        found: list[list[np.ndarray]] = [[] for _ in targets]
        for at, cosine in _stripes(x, y):
            cosine = cosine.reshape(-1)
            seen = None if earlier is None else earlier(at).reshape(-1)
            for held, (kind, chain, _) in zip(found, targets):
                low, high = _range(chain, bins)
                slack = (high - low) * 1e-3 + 1e-15
                near = (cosine >= low - slack) & (cosine <= high + slack)
                if seen is not None:
                    near &= seen
                near = np.flatnonzero(near)
                own = a[at.start + near // len(y)]
                same = (own == b[near % len(y)]) & (own >= 0)
                values = cosine[near[same == (kind == "within")]]
                held.append(values[_inside(values, chain, bins)])
        for t, (held, (_, chain, listed)) in enumerate(zip(found, targets)):
            values = np.concatenate(held)
            if len(values):
                yield t, [-1], [], [len(values)], values.sum(), values.min(), values.max()
                if listed:
                    values, n = np.unique(values, return_counts=True)
                    yield t, np.zeros(len(n), int), values, n, 0.0, None, None
                else:
                    n = np.bincount(np.clip(_places(values, *_range(chain, bins), bins), 0, bins - 1), minlength=bins)
                    yield t, np.flatnonzero(n), [], n[n > 0], 0.0, None, None

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = left["book"].to_numpy(object), right["book"].to_numpy(object)
            codes = {x: i for i, x in enumerate({*a, *b} - {None})}
            a, b = (np.array([codes.get(x, -1) for x in side]) for side in (a, b))
            one, two = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            alone = left["i"].iloc[0] == right["j"].iloc[0]  # within a block each pair occurs twice, across blocks once
            earlier = (lambda at: one[at, None] < two[None]) if alone else None
            out = list((of_all if first else of_bins)(_unit(left), _unit(right), a, b, earlier))
        return pd.DataFrame(out, columns=["target", "bins", "vals", "counts", "total", "low", "high"])

    told = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _PART)
    each = told.select("target", "total", "low", "high", F.explode(F.arrays_zip("bins", "vals", "counts")).alias("z"))
    each = each.select("target", "total", "low", "high", F.col("z.bins").alias("bin"), F.col("z.vals").alias("value"), F.col("z.counts").alias("n"))
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    return each.groupBy("target", "bin", "value").agg(*sums)


def _range(chain: list[tuple[float, float, int]], bins: int) -> tuple[float, float]:
    """The stretch that the next round cuts into bins."""
    if not chain:
        return -1.0 - 1e-9, 1.0 + 1e-9
    low, high, chosen = chain[-1]
    return low + (high - low) * chosen / bins, low + (high - low) * (chosen + 1) / bins


def _selected(df: DataFrame, kinds: list[str], q: float, by_book: bool, bins: int, small: int, rows_per_block: int) -> dict[str, tuple[int, float, float]]:
    """kind -> (pairs, mean of the cosines, their q-quantile with interpolation), exact, by rounds of histograms of at most
    `bins` rows for each wanted rank."""
    sizes: dict[str, tuple[int, float]] = {}
    todo: list[tuple[str, int, int, list]] = [(k, -1, 0, []) for k in kinds]  # kind, rank (not known at first), values below, chain
    ranked: dict[tuple[str, int], float] = {}
    listed: list[bool] = [False] * len(todo)
    while todo:
        targets = [(kind, chain, whole) for (kind, _, _, chain), whole in zip(todo, listed)]
        rows: dict[int, list] = {}
        for r in _sifted(df, targets, bins, rows_per_block, by_book).collect():
            rows.setdefault(r["target"], []).append(r)
        after, lists = [], []
        for t, (kind, rank, below, chain) in enumerate(todo):
            if t not in rows:
                continue
            head = next(r for r in rows[t] if r["bin"] < 0)
            if kind not in sizes:
                sizes[kind] = head["n"], head["total"] / head["n"]
            wanted = [rank] if rank >= 0 else sorted({int(np.floor(q * (head["n"] - 1))), int(np.ceil(q * (head["n"] - 1)))})
            for place in wanted:
                if head["low"] == head["high"]:
                    ranked[kind, place] = head["low"]
                    continue
                seen = below
                for r in sorted((r for r in rows[t] if r["bin"] >= 0), key=lambda r: (r["bin"], r["value"] or 0.0)):
                    if place < seen + r["n"]:
                        break
                    seen += r["n"]
                if listed[t]:
                    ranked[kind, place] = r["value"]
                else:
                    after.append((kind, place, seen, [*chain, (*_range(chain, bins), r["bin"])]))
                    # After five rounds a bin is as narrow as two neighbouring numbers and has few distinct values.
                    lists.append(r["n"] <= small or len(chain) >= 4)
        todo, listed = after, lists
    out = {}
    for kind, (n, mean) in sizes.items():
        at = q * (n - 1)
        low, high = ranked[kind, int(np.floor(at))], ranked[kind, int(np.ceil(at))]
        out[kind] = n, mean, low + (high - low) * (at - np.floor(at))
    return out


def similarity_stats(df: DataFrame, q: float = 0.05, bins: int = BINS, small: int = SMALL, rows_per_block: int = BLOCK) -> DataFrame:
    """(kind, n, mean, p5): ordered pairs, mean and 5th percentile of similarities within a book and across books. Pairs
    are counted where they arise: no row for a pair is made or moved."""
    found = _selected(df, ["within", "across"], q, False, bins, small, rows_per_block)
    rows = [(kind, 2 * n, round(float(mean), 6), round(float(p), 6)) for kind, (n, mean, p) in found.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, n long, mean double, p5 double")


def auto_threshold(df: DataFrame, q: float = 0.05, bins: int = BINS, small: int = SMALL, rows_per_block: int = BLOCK) -> DataFrame:
    """One less the 5th percentile of similarities within a book; null without such pairs."""
    found = _selected(df, ["within"], q, True, bins, small, rows_per_block)
    told = round(float(1 - found["within"][2]), 6) if found else None
    return df.sparkSession.createDataFrame([(told,)], "threshold double")


def standardize(df: DataFrame, column: str = "vector") -> DataFrame:
    """Every component less its mean over the rows, by its population deviation + 1e-8."""
    parts = df.select("vec_id", F.posexplode(column).alias("i", "x"))
    stats = parts.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return parts.join(F.broadcast(stats), "i").select("vec_id", "i", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-8)).alias("z"))


def upgma(x: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters by cosine distance, of merges nearer than the threshold, numbered by their first member.

    A chain of nearest neighbours ends where two are each other's nearest; those merge. For average linkage this gives
    the merges of the closest-first rule in time n^2, in another order, so that the threshold is applied at the end."""
    return np.unique(_merged(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8), np.ones(len(x)), threshold), return_inverse=True)[1]


def _merged(unit: np.ndarray, size: np.ndarray, threshold: float) -> list[int]:
    """The first member of each row's cluster; a row is the mean of `size` unit vectors."""
    n = len(unit)
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, np.inf)
    size, alive, root = size.astype(float), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    left = n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while left > 1:
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        b = int(distance[a].argmin())
        if len(chain) > 1 and distance[a, chain[-2]] <= distance[a, b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        if distance[a, b] < threshold:
            a_root, b_root = sorted((find(a), find(b)))
            root[b_root] = a_root
        keep, gone = sorted((a, b))
        merged = (size[a] * distance[a] + size[b] * distance[b]) / (size[a] + size[b])
        merged[[keep, gone]] = np.inf
        distance[keep], distance[:, keep] = merged, merged
        distance[gone], distance[:, gone] = np.inf, np.inf
        size[keep] += size[gone]
        alive[gone] = False
        left -= 1
    return [find(i) for i in range(n)]


#: Clips of a key that one task may merge (their distances take 8 bytes a pair), clips of a block, and rows of a block
#: whose distances are held at once.
ALONE, MEET, STRIPE = 4096, 8192, 256


def _nearest(state: DataFrame, key: str, per_block: int) -> DataFrame:
    """(label, d, lo, hi) of each row's nearest other of its key, by distance and labels. Blocks of a key meet once, and
    tell the nearest of both sides; distances are held in stripes."""
    sizes = state.groupBy(F.col(key).alias("of")).agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))
    dealt = state.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    fresh = lambda: dealt.select([F.col(c).alias(c) for c in dealt.columns])
    left = fresh().withColumn("i", F.col("block")).withColumn("j", F.explode(F.filter(every, lambda j: j >= F.col("block"))))
    right = fresh().withColumn("j", F.col("block")).withColumn("i", F.explode(F.filter(every, lambda i: i <= F.col("block"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left, right = left.sort_values("label"), right.sort_values("label")  # the first of equals has the lower label
            a, b = left["label"].to_numpy(), right["label"].to_numpy()
            x, y = (np.array(side["mean"].tolist(), float) for side in (left, right))
            best, at = np.full(len(b), np.inf), np.zeros(len(b), np.int64)
            for lo in range(0, len(a), STRIPE):
                d = 1 - x[lo : lo + STRIPE] @ y.T
                d[a[lo : lo + STRIPE, None] == b[None]] = np.inf
                near = d.argmin(axis=1)
                out.append(pd.DataFrame({"label": a[lo : lo + STRIPE], "d": d[np.arange(len(d)), near], "other": b[near]}))
                up = d.argmin(axis=0)
                least = d[up, np.arange(len(b))]
                better = least < best
                best[better], at[better] = least[better], up[better] + lo
            if left["i"].iloc[0] != right["j"].iloc[0]:
                out.append(pd.DataFrame({"label": b, "d": best, "other": a[at]}))
        return pd.concat(out) if out else pd.DataFrame({"label": [], "d": [], "other": []})

    told = left.select(key, "i", "j", "label", "mean").groupBy(key, "i", "j").cogroup(right.select(key, "i", "j", "label", "mean").groupBy(key, "i", "j"))
    met = told.applyInPandas(run, "label long, d double, other long").where("d < double('inf')")
    ranked = F.struct("d", F.least("label", "other").alias("lo"), F.greatest("label", "other").alias("hi"))
    return met.groupBy("label").agg(F.min(ranked).alias("m")).select("label", "m.d", "m.lo", "m.hi")


def cluster_clips(df: DataFrame, threshold: float, key: str = "config", alone: int = ALONE, per_block: int = MEET) -> DataFrame:
    """(key, vec_id, cluster): average-linkage clusters of each key's clips, numbered by their first member.

    The mean distance of two clusters is that of their mean unit vectors, so clusters move as one row each. While a key
    has more than `alone` of them, all that are each other's nearest merge at once, which for average linkage are merges
    of the closest-first rule; those without one nearer than the threshold never merge and rest. What is left of a key
    is merged in one task. Memory is that of two blocks; a round costs the square of a key's clusters, spread over tasks."""
    kind = df.schema[key].dataType.simpleString()
    lined = df.select(key, "vec_id", "vector").repartitionByRange(key, "vec_id").sortWithinPartitions(key, "vec_id")
    rows = materialise(lined.withColumn("label", F.monotonically_increasing_id()), "clips")
    members = rows.select(key, "vec_id", "label")
    state = rows.select(key, "label", bound(norm(F.col("vector")) + 1e-8, lambda n: F.transform("vector", lambda x: x / n)).alias("mean"), F.lit(1.0).alias("size"))
    state = materialise(state, "clusters")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        names = pdf["label"].to_numpy()
        first = _merged(np.array(pdf["mean"].tolist(), float), pdf["size"].to_numpy(), threshold)
        return pd.DataFrame({"hi": names, "lo": names[first]}).query("hi != lo")

    def relabelled(merges: DataFrame) -> DataFrame:
        held = members.join(merges.select(F.col("hi").alias("label"), "lo"), "label", "left")
        return materialise(held.select(key, "vec_id", F.coalesce("lo", "label").alias("label")), "members")

    while True:
        counts = state.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("n"))
        many = materialise(counts.where(F.col("n") > alone).select("of"), "large-keys")
        same = F.col(key).eqNullSafe(F.col("of"))
        members = relabelled(state.join(F.broadcast(many), same, "left_anti").groupBy(key).applyInPandas(finish, "hi long, lo long"))
        if many.isEmpty():
            break
        state = materialise(state.join(F.broadcast(many), same, "left_semi"), "clusters")
        near = materialise(_nearest(state, key, per_block).where(F.col("d") < threshold), "nearest")
        merges = materialise(near.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n = 2").select("lo", "hi"), "merges")
        members = relabelled(merges)
        live = state.join(near.select("label"), "label", "left_semi")
        gone = live.join(merges.withColumnRenamed("hi", "label"), "label").select("lo", F.col("mean").alias("theirs"), F.col("size").alias("more"))
        held = live.join(merges.select(F.col("hi").alias("label")), "label", "left_anti").join(gone.withColumnRenamed("lo", "label"), "label", "left")
        total = F.col("size") + F.coalesce("more", F.lit(0.0))
        mean = F.when(F.col("more").isNull(), F.col("mean")).otherwise(F.zip_with("mean", "theirs", lambda a, b: (a * F.col("size") + b * F.col("more")) / total))
        state = materialise(held.select(key, "label", mean.alias("mean"), total.alias("size")), "clusters")
    order = F.row_number().over(Window.partitionBy(key).orderBy("label")) - 1
    numbered = members.select(key, "label").distinct().select("label", order.cast("long").alias("cluster"))
    return members.join(numbered, "label").select(F.col(key).cast(kind), "vec_id", "cluster")


def majority_vote(df: DataFrame, key: str = "book", label: str = "cluster") -> DataFrame:
    """The most frequent label of each key, the lowest among equals."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return counts.withColumn("o", order).where("o = 1").select(key, label, "n")


def cluster_hours(votes: DataFrame, hours: DataFrame) -> DataFrame:
    """Hours of each cluster's books; books without hours count as none."""
    told = votes.join(hours.select("book", "hours"), "book", "left")
    return told.groupBy("cluster").agg(F.count("*").alias("n_books"), F.sum(F.coalesce("hours", F.lit(0.0))).alias("hours"))


def rank_clusters(per_cluster: DataFrame) -> DataFrame:
    """The largest cluster, its hours and its share of all."""
    return per_cluster.agg(
        F.count("*").alias("n_clusters"),
        F.max_by("cluster", F.struct(F.col("hours"), -F.col("cluster"))).alias("largest"),
        F.max("hours").alias("largest_hours"),
        (F.max("hours") / F.greatest(F.sum("hours"), F.lit(1e-9))).alias("share"),
    )
