"""N-gram Jaccard join with a token-group matrix.

Every text is a set of word shingles. Texts with equal sets are one class. Classes are partitioned into groups of
similar ones, each group stores its token union as rows of a matrix (token -> groups), a class's overlap with a union
bounds its overlap with every member, and only groups whose bound reaches the threshold are opened and compared
member by member.

Groups are proposed so that no link can leave them: the shingles' hash range is cut into more segments than two linked
sets can differ in, so linked sets agree on at least one whole segment. Ties of classes that agree on one
have connected components, which are the partition. There are SPARE times as many segments as
needed, so linked sets agree on several, and a class leaves out as many weak ones (of fewest rare shingles). Classes
that agree on a segment are tied to the smallest of them where sketches, a byte of every segment, agree on as many segments
as linked sets must; those that don't are compared with all others of the segment, those tied to the smallest among
them, or are tied unsifted where that is too many pairs. Which shingles are rare is told by a bounded sample of texts; it changes what is compared, never what is found. Segments are counted by size class,
each of which covers all pairs whose smaller set lies in it.

Components of up to CAP shingles are handled by one task each. Larger ones are first thinned: every class is compared
with the centres of its ties, and components of these links are found; only classes outside a component's largest
part are then compared with all others of it, in blocks of at most CAP shingles.

A text without words (or null) is linked with nothing. A null doc_id takes part like any other and never names a
component of others; repeated rows give repeated result rows. Columns besides id and text are ignored. An empty table
gives no rows. Shingles and sets are compared by 64-bit hashes (see words).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import discard, materialise, table, text_of, tidy, trim, unused
from .graph import components

#: Shingles that a task may hold at once; growth of the size classes; segments to spare.
CAP, GROWTH, SPARE = 200_000, 1.5, 0.3
#: Classes of a segment unlike its smallest, at most, that are compared with all of it pair by pair: pairs grow with a
#: segment's classes, not with their square.
PAIRED = 8
#: Classes that a batch states of one segment; of more, those like the smallest leave it to that one.
FOLD = 8
#: Segments stated, about, after which a batch is stated in a further part: a batch of long texts has many.
STATED = 500_000
#: Rounds in which keep_one has segments stated, each a share of their hashes: of sets that are linked from a lower
#: similarity on there are so many segments that those of all texts at once take twice the texts' bytes of disk.
ROUNDS = 2
#: Rows of three numbers at most that are broadcast (under 100 MB in memory); larger tables are joined by shuffles.
BROADCAST_ROWS = 2_000_000
#: Shingles of a group after which a worker gives freed memory back.
TRIMMED = 1 << 16
#: Texts sampled for frequent shingles, and in how many of them a shingle counts as frequent.
SAMPLE_DOCS, FREQUENT = 8192, 3
#: Bytes of the longest text in that sample.
SAMPLE_BYTES = 1 << 17


def schemes(size: int, p: int, q: int) -> list[tuple[int, int, int]]:
    """(scheme, segments, segments that may be left out) of the size classes in which a set of `size` states its
    segments; links need |A and B| / |A or B| >= p / q."""
    out = []
    low, number = ceil(p / (q - p)), 0
    while low <= size:
        after = max(low + 1, int(low * GROWTH))
        if size * p <= (after - 1) * q:
            need = (after - 1) * (q - p) // p + 1
            spare = ceil(SPARE * need)
            out.append((number, need + spare, spare))
        low, number = after, number + 1
    return out


def segments(tokens: np.ndarray, p: int, q: int, frequent: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segments that may be left out, hash of each segment, its rare shingles) for each size class of one set (sorted
    distinct 64-bit shingles)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(tokens ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    rare = np.ones(len(tokens), np.int64)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rare[frequent[at] == tokens] = 0
    rare = np.concatenate([[0], np.cumsum(rare)])
    for number, k, spare in schemes(len(tokens), p, q):
        edges = (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
        sig = W.mix(sums[cut[1:]] - sums[cut[:-1]] + np.arange(k, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        yield spare, W.mix(sig ^ np.uint64(number * 2654435761 + 1)), rare[cut[1:]] - rare[cut[:-1]]


def signatures(tokens: np.ndarray, p: int, q: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the segments that a set states: all but those of fewest rare shingles, as many fewest as it may leave
    out, all ties of the count that is kept staying. Two linked sets agree on more segments than either leaves out, and
    the one with the higher bar states one of them, which clears the other's bar too."""
    out = [sig[held >= np.partition(held, spare)[spare]] for spare, sig, held in segments(tokens, p, q, frequent)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(tokens: np.ndarray, p: int, q: int) -> bytes:
    """A byte of every segment's hash."""
    return b"".join(sig.astype(np.uint8).tobytes() for _, sig, _ in segments(tokens, p, q))


@lru_cache(maxsize=65536)
def _layout(size: int, p: int, q: int) -> dict[int, tuple[int, int, int]]:
    out, at = {}, 0
    for number, k, spare in schemes(size, p, q):
        out[number] = (at, at + k, spare)
        at += k
    return out


def may_link(size_a: int, a: bytes, size_b: int, b: bytes, p: int, q: int) -> bool:
    """Whether two sets' sketches agree on as many segments as linked sets must; never false for linked ones."""
    if min(size_a, size_b) * q < max(size_a, size_b) * p:
        return False
    left, right = _layout(size_a, p, q), _layout(size_b, p, q)
    for number, (lo, hi, spare) in left.items():
        if number in right:
            x, y = np.frombuffer(a, np.uint8)[lo:hi], np.frombuffer(b, np.uint8)[right[number][0] : right[number][1]]
            if np.count_nonzero(x == y) > spare:
                return True
    return False


def frequent_shingles(df: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Shingles of at least FREQUENT of about SAMPLE_DOCS texts of SAMPLE_BYTES at most, sorted. They decide what is
    compared, never what is found."""
    total = df.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    key = F.pmod(F.xxhash64(text_col, F.lit("sample")), F.lit(1 << 30))
    short = F.octet_length(text_col) <= SAMPLE_BYTES
    chosen = df.where(short & (key < int(share * (1 << 30)))).select(F.col(text_col).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["s"])

    counts = chosen.mapInArrow(tidy(run), "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(counts.select("s").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _sets(batch_texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, words in W.chunks(batch_texts):
        tokens, _, ptr = words.shingles(n)
        for i in range(len(ptr) - 1):
            x = np.sort(tokens[ptr[i] : ptr[i + 1]])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _set_id(x: np.ndarray) -> int | None:
    if not len(x):
        return None
    total = np.uint64(np.sum(W.mix(x), dtype=np.uint64))
    return int(W.mix(np.array([total], np.uint64) ^ np.uint64(len(x))).view(np.int64)[0])


def _classes(df: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch, hash) of (doc_id, text, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(x), _set_id(x), sketch(x, p, q)) for x in _sets(batch.column(1), n)]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            columns = [batch.column(0), *[pa.array([t[i] for t in told], k) for i, k in enumerate(kinds)], batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "sketch", "hash"])

    return df.select("doc_id", "text", "hash").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_id long, sketch binary, hash long")


def _statements(df: DataFrame, n: int, p: int, q: int, frequent: np.ndarray, rounds: int = 1, turn: int = 0) -> DataFrame:
    """(sig, set_id, folded): the segments that classes state, of several rounds those whose turn it is. Where more than FOLD classes agree on one within a batch
    (or within a part of it, of about STATED segments),
    those that may link with the smallest leave it to that one, which states it as folded, and are tied to it by a
    segment made for the two, so a segment that a third of all texts share in near copies leaves each batch once."""

    def parts(batch: pa.RecordBatch) -> Iterator[dict[int, tuple[np.ndarray, int, bytes]]]:
        own: dict[int, tuple[np.ndarray, int, bytes]] = {}
        held = 0
        for x in _sets(batch.column(0), n):
            key = _set_id(x)
            if key is not None and key not in own:
                sigs = signatures(x, p, q, frequent)
                own[key] = (sigs[sigs % np.uint64(rounds) == np.uint64(turn)] if rounds > 1 else sigs, len(x), sketch(x, p, q))
                held += len(own[key][0])
                if held >= STATED:
                    yield own
                    own, held = {}, 0
        if own:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (part for batch in batches for part in parts(batch)):
            sets = np.repeat(np.array(list(own), np.int64), [len(s[0]) for s in own.values()])
            sigs = np.concatenate([s[0] for s in own.values()])
            order = np.lexsort((sets, sigs))
            sets, sigs = sets[order], sigs[order]
            first = np.ones(len(sigs), bool)
            first[1:] = sigs[1:] != sigs[:-1]
            group = np.cumsum(first) - 1
            center = sets[first][group]
            asked = ~first & (np.bincount(group)[group] > FOLD)
            pairs, which = np.unique(np.stack([sets[asked], center[asked]], axis=1), axis=0, return_inverse=True)
            alike = np.array([may_link(*own[a][1:], *own[c][1:], p, q) for a, c in pairs.tolist()], bool)
            stated = np.ones(len(sigs), bool)
            stated[asked] = ~alike[which.reshape(-1)] if len(pairs) else False
            folded = first & (np.bincount(group, weights=~stated)[group] > 0)
            a, c = (np.ascontiguousarray(pairs[alike, i]) for i in (0, 1)) if len(pairs) else (sets[:0], sets[:0])
            made = W.mix(a.view(np.uint64) ^ W.mix(c.view(np.uint64)))
            sig = np.concatenate([sigs[stated], made, made]).view(np.int64)
            flags = np.concatenate([folded[stated], np.zeros(2 * len(a), bool)])
            columns = [pa.array(sig), pa.array(np.concatenate([sets[stated], a, c])), pa.array(flags)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "set_id", "folded"])

    return df.select("text").mapInArrow(tidy(run), "sig long, set_id long, folded boolean")


def _sifted(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (set_id, center) whose sketches may link; sketches: set_id, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("size", "sketch", "other_size", "other_sketch")))
            keep = [may_link(a, x, b, y, p, q) for a, x, b, y in rows]
            yield batch.select(["set_id", "center"]).filter(pa.array(keep, pa.bool_()))

    other = sketches.select(F.col("set_id").alias("center"), F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch"))
    joined = pairs.join(sketches, "set_id").join(other, "center")
    return joined.select("set_id", "center", "size", "sketch", "other_size", "other_sketch").mapInArrow(tidy(run), "set_id long, center long")


def _ties(stated: list[DataFrame], sketches: DataFrame, p: int, q: int) -> DataFrame:
    """(set_id, center) pairs whose connected components hold all links. stated: the statements of each round, which are
    written one after the other; all of a segment's are of one round.

    A segment's classes are tied to its smallest one where sketches allow. Each of the others is compared with all of
    the segment's classes, tied ones too: that two may link with the smallest, or may not, tells nothing of the two. If
    there are more than PAIRED of them, or a batch has folded classes of the segment, they are tied unsifted."""
    over = Window.partitionBy("sig")
    told = [rows.withColumns({"center": F.min("set_id").over(over), "folded": F.max("folded").over(over)}) for rows in stated]
    parts = [materialise(rows.where("set_id <> center"), "met") for rows in told]
    met = reduce(DataFrame.unionByName, parts)
    ties = materialise(_sifted(met.select("set_id", "center").distinct(), sketches, p, q), "ties")
    rest = materialise(met.join(ties, ["set_id", "center"], "left_anti").distinct(), "rest")
    mixed = rest.groupBy("sig").agg(F.count("*").alias("unlike"), F.max("folded").alias("hidden"))
    held = materialise(met.select("sig", "set_id").join(mixed.select("sig"), "sig", "left_semi").distinct(), "mixed")
    sizes = held.groupBy("sig").agg(F.count("*").alias("n")).join(mixed, "sig")
    paired = ~F.col("hidden") & (F.col("unlike") <= PAIRED)
    judged = materialise(sizes.select("sig", paired.alias("paired")).join(rest, "sig"), "judged")
    few = judged.where("paired").select("sig", "set_id")
    pairs = few.join(held.withColumnRenamed("set_id", "center"), "sig").where("set_id <> center")
    pairs = pairs.select(F.greatest("set_id", "center").alias("set_id"), F.least("set_id", "center").alias("center"))
    more = _sifted(pairs.distinct(), sketches, p, q)
    many = judged.where("NOT paired").select("set_id", "center").distinct()
    out = materialise(ties.unionByName(more).unionByName(many), "ties")
    discard(*parts, ties, rest, held, judged)
    return out


def _tokens(df: DataFrame, n: int) -> DataFrame:
    """(component, set_id, tokens) of (component, text); texts of a component are classes' first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), n))
            columns = [
                batch.column(0),
                pa.array([_set_id(x) for x in sets], pa.int64()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["component", "set_id", "tokens"])

    return df.select("component", "text").mapInArrow(tidy(run), "component long, set_id long, tokens binary")


def _bounded(df: DataFrame) -> DataFrame:
    """df, a written table of few narrow columns, with a hint to broadcast it if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class TokenGroups:
    """The token-group matrix of the sets seen so far, smallest first, and the links' components. Tokens are numbers
    below n_tokens; a token's row holds its group, or a list of its groups once there are several."""

    def __init__(self, n_tokens: int, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.root: list[int] = []
        self.members: list[list[tuple[int, np.ndarray]]] = []
        self.matrix: list[int | list[int] | None] = [None] * n_tokens

    def find(self, g: int) -> int:
        while self.root[g] != g:
            self.root[g] = self.root[self.root[g]]
            g = self.root[g]
        return g

    def linked(self, size_x: int, size_y: int, common: int) -> bool:
        return self.q * common >= self.p * (size_x + size_y - common)

    def bounds(self, tokens: list[int]) -> dict[int, int]:
        """How many of the tokens each group's union holds; parts of a merged group may count a token twice, which
        leaves a bound."""
        held: dict[int, int] = {}
        for t in tokens:
            row = self.matrix[t]
            if row is None:
                continue
            for g in row if isinstance(row, list) else (row,):
                held[g] = held.get(g, 0) + 1
        joined: dict[int, int] = {}
        for g, n in held.items():
            g = self.find(g)
            joined[g] = joined.get(g, 0) + n
        return joined

    def add(self, key: int, tokens: np.ndarray) -> list[int]:
        """Adds a set; returns a member's key for each group with which it is linked. A group stays closed unless the
        part of the set in the group's token union could make a link."""
        listed = tokens.tolist()
        need = -(-self.p * len(tokens) // self.q)
        found, mine = [], None
        for g, most in self.bounds(listed).items():
            if most < need:
                continue
            for other, theirs in reversed(self.members[g]):
                if self.p * len(tokens) > self.q * len(theirs):
                    break
                common = len(np.intersect1d(tokens, theirs, assume_unique=True))
                if self.linked(len(tokens), len(theirs), common):
                    found.append(other)
                    if mine is None:
                        mine = g
                    else:
                        self.root[g] = mine
                        self.members[mine] = sorted(self.members[mine] + self.members[g], key=lambda m: len(m[1]))
                        self.members[g] = []
                    break
        self.place(len(self.root) if mine is None else mine, key, tokens)
        return found

    def place(self, group: int, key: int, tokens: np.ndarray) -> None:
        """Adds a set to a group, which may be the next new one."""
        if group == len(self.root):
            self.root.append(group)
            self.members.append([])
        self.members[group].append((key, tokens))
        matrix = self.matrix
        for t in tokens.tolist():
            row = matrix[t]
            if row is None:
                matrix[t] = group
            elif isinstance(row, list):
                if group not in row:
                    row.append(group)
            elif row != group:
                matrix[t] = [row, group]


def group_links(keys: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that join every component of the sets (distinct keys), not all links."""
    if not keys:
        return []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([0, *map(len, sets)])
    dense = [flat[a:b].astype(np.int32) for a, b in zip(ends, ends[1:])]
    groups = TokenGroups(len(names), p, q)
    out = []
    for i in sorted(range(len(keys)), key=lambda i: (len(dense[i]), keys[i])):
        out += [(keys[i], other) for other in groups.add(keys[i], dense[i])]
    return out


_LINK = "a long, b long"


def _unpacked(pdf: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    pdf = pdf.drop_duplicates("set_id")
    return [int(k) for k in pdf["set_id"]], [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]


def _small_groups(rows: DataFrame, p: int, q: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sets = _unpacked(pdf)
        out = pd.DataFrame(group_links(keys, sets, p, q), columns=["a", "b"], dtype="int64")
        if sum(map(len, sets)) > TRIMMED:
            trim()
        return out

    return rows.groupBy("component").applyInPandas(run, _LINK)


def _large_groups(rows: DataFrame, ties: DataFrame, sizes: DataFrame, p: int, q: int, cap: int) -> DataFrame:
    """Links of components beyond the cap. rows: component, set_id, size, tokens; ties: set_id, center."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(q * common >= p * (len(x) + len(y) - common))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    own = rows.select(F.col("set_id").alias("a"), F.col("tokens").alias("x"))
    centre = rows.select(F.col("set_id").alias("b"), F.col("tokens").alias("y"))
    pairs = ties.select(F.col("set_id").alias("a"), F.col("center").alias("b"))
    links = materialise(pairs.join(own, "a").join(centre, "b").mapInPandas(verify, _LINK), "star-links")
    parts = components(links).select(F.col("node").alias("set_id"), F.col("component").alias("part"))
    told = rows.join(parts, "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    told = materialise(told, "parts")
    largest = told.groupBy("component", "part").agg(F.count("*").alias("n"))
    largest = largest.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    told = told.join(largest, "component").join(sizes, "component")
    blocks = F.ceil(F.col("total") / cap).cast("int")
    block = lambda: F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    columns = ["component", "target", "query", "asks", "set_id", "part", "tokens"]
    targets = told.select("*", block().alias("target"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("query"))
    queries = told.where("part <> largest").select(
        "*", block().alias("query"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("target")
    )
    # Only blocks with a query are compared: a target block meets the query blocks that exist.
    used = queries.select("component", "query", "target").distinct()
    targets = targets.join(used, ["component", "query", "target"], "left_semi").withColumn("asks", F.lit(False))
    both = targets.select(columns).unionByName(queries.withColumn("asks", F.lit(True)).select(columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0, *map(len, sets)])
        dense = [flat[a:b].astype(np.int32) for a, b in zip(ends, ends[1:])]
        asks, parts, ids = pdf["asks"].to_numpy(bool), pdf["part"].to_numpy(np.int64), pdf["set_id"].to_numpy(np.int64)
        groups, number = TokenGroups(len(names), p, q), {}
        for i in np.flatnonzero(~asks):
            groups.place(number.setdefault(int(parts[i]), len(number)), int(ids[i]), dense[i])
        out = []
        for i in np.flatnonzero(asks):
            need = -(-p * len(dense[i]) // q)
            for g, most in groups.bounds(dense[i].tolist()).items():
                if most < need or g == number.get(int(parts[i])):
                    continue
                for name, theirs in groups.members[g]:
                    common = len(np.intersect1d(dense[i], theirs, assume_unique=True))
                    if groups.linked(len(dense[i]), len(theirs), common):
                        out.append((int(ids[i]), name))
                        break
        del groups, dense, names, flat
        trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links.unionByName(both.groupBy("component", "target", "query").applyInPandas(compare, _LINK))


def jaccard_components(
    df: DataFrame, n: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, rounds: int = 1
) -> DataFrame:
    """(doc_id, n_shingles, component_id, part, hash): the smallest doc_id reachable by links of Jaccard similarity >= p / q;
    part names the component itself (null without words), hash the text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classes = materialise(_classes(docs.withColumn("hash", F.xxhash64(text_of("text"))), n, p, q), "classes")
    frequent = frequent_shingles(df, text_col, n)
    stated = [_statements(docs, n, p, q, frequent, rounds, turn) for turn in range(rounds)]
    named = classes.where("set_id is not null").groupBy("set_id")
    first = named.agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), F.min("sketch").alias("sketch"))
    first = materialise(first, "first")
    ties = _ties(stated, first.select("set_id", "size", "sketch"), p, q)
    groups = components(ties, "set_id", "center").select(F.col("node").alias("set_id"), "component")
    wanted = materialise(first.join(groups, "set_id"), "groups")
    sizes = materialise(wanted.groupBy("component").agg(F.sum("size").alias("total")), "group-sizes")
    # A first document may have other texts under its id: those are classes of their own and are dropped by their set.
    narrow = [materialise(wanted.select("first", "component", F.col("set_id").alias("asked")), "asked")]
    asked = _bounded(narrow[0])
    texts = docs.join(asked, docs["doc_id"].eqNullSafe(asked["first"])).select("component", "asked", "text")
    tokens = _tokens(texts, n)
    over = sizes.where(F.col("total") > cap).select("component", "total")
    narrow.append(materialise(wanted.select("set_id", F.col("component").alias("own")), "members"))
    known = _bounded(narrow[1])
    tokens = tokens.join(known, "set_id").where("own = component").drop("own")
    if over.isEmpty():
        links = _small_groups(tokens, p, q)
    else:
        rows = materialise(tokens.dropDuplicates(["set_id"]), "group-sets")
        narrow.append(rows)
        links = _small_groups(rows.join(over, "component", "left_anti"), p, q)
        big = rows.join(over, "component", "left_semi")
        links = links.unionByName(_large_groups(big, ties.join(big.select("set_id"), "set_id", "left_semi"), over, p, q, cap))
    parts = components(links).select(F.col("node").alias("set_id"), "component")
    discard(ties, wanted, sizes, *narrow)
    told = first.join(parts, "set_id", "left").select("set_id", "first", F.coalesce("component", "set_id").alias("part"))
    lowest = told.groupBy("part").agg(F.min("first").alias("component_id"))
    named = told.select("set_id", "part").join(lowest, "part")
    out = classes.join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "part", "hash")


def keep_one(df: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df (documents) with one row of each component: of the smallest id (a null one only if there is no other) and, among
    texts of that id, of the smallest hash. Texts are judged each by itself: others under the same id, or without one,
    stay. Repeated rows are copies of each other. Texts without words stay."""
    found = materialise(jaccard_components(df, n, p, q, id_col, text_col, rounds=ROUNDS).where("part IS NOT NULL").select("doc_id", "hash", "part"), "components")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("hash"))
    # A row for each text of each id, with its number.
    texts = found.groupBy("part", "doc_id", "hash").agg(F.count("*").alias("rows"))
    best = texts.groupBy("part").agg(F.min(order).alias("best"), F.sum("rows").alias("total"))
    judged = texts.join(best.where("total > 1"), "part").select("doc_id", "hash", "rows", (order == F.col("best")).alias("kept"))
    judged = materialise(judged.where("NOT kept OR rows > 1"), "judged")
    discard(found)
    h, k = unused(df, "_millrace_hash"), unused(df, "_millrace_id")

    def named(rows: DataFrame) -> DataFrame:
        return _bounded(materialise(rows.select(F.col("doc_id").alias(k), F.col("hash").alias(h)), "named"))

    held = df.withColumn(f"{h}_", F.xxhash64(text_of(text_col)))
    met = lambda rows, other: rows[id_col].cast("long").eqNullSafe(other[k]) & (rows[f"{h}_"] == other[h])
    gone, repeated = named(judged.where("NOT kept")), named(judged.where("kept"))
    left = held.join(gone, met(held, gone), "left_anti")
    if not repeated.isEmpty():
        several = left.join(repeated, met(left, repeated), "left_semi")
        left = left.join(repeated, met(left, repeated), "left_anti").unionByName(several.dropDuplicates([id_col, f"{h}_"]))
    return left.select(*df.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), each AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT i, j FROM shared JOIN sets a ON a.doc_id = i JOIN sets b ON b.doc_id = j WHERE 100 * c >= 90 * (len(a.s) + len(b.s) - c)
), sides AS (SELECT i AS a, j AS b FROM links UNION ALL SELECT j, i FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b FROM reach r JOIN sides ON a = r.other)
SELECT s.doc_id, len(s) AS n_shingles, component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""
