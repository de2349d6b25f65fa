"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model file and composed with each input:

* the normaliser: one state with an arc for every character that is rewritten (the space becomes the mark), entered by
  an arc that writes the leading mark; other characters pass (models with further tables are refused);
* the pieces: a trie of all pieces that the model's merges can make, one arc of the composition for each piece that
  matches at a position, weighing its negative score;
* byte fallback: an arc that writes the UTF-8 bytes of a character that no piece spells;
* the joins: a machine whose state is the last piece. Going on with a piece weighs nothing where merges of the two
  pieces' parts never cross from one into the other, and one violation otherwise. The machine is not written out: a
  join is told from the ranks along the right edge of the one piece's merges and the left edge of the other's.

Path weights are (violations, negative score), added along a path, the least in order wins (a tropical semiring). The
arcs of the composition are relaxed in topological order, those that end at a position after all that end before it. A
path without violations is the model's own segmentation, and every prefix of it is that of the prefix, which has one
only, so a position keeps its best path alone. All parts of a batch that are new are composed and relaxed together.

Merges never enter a run of marks from the left nor cross a line end, so a text is cut there; parts and their ids are
kept in a bounded cache.

Null texts are empty, empty texts have no pieces. Texts are processed whole, however long. Decoding joins the pieces'
bytes, turns marks into spaces and drops the one that encoding added; the mark itself (U+2581) in a text comes back as
a space. Added columns replace the input's of the same name; others are carried along untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts longer than this aren't cached; a full cache is kept for one more generation, as parts in use move on: some 60
#: MB a worker. Characters that are composed at once.
CACHED_CHARS, CACHE_ENTRIES, AT_ONCE = 48, 200_000, 1 << 15
_NEVER = np.int32(1 << 30)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Lookup:
    """Whole numbers of 64 bits to values, as open addressing in arrays, asked for many at once; -1 where unknown."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[left[taken]], values[left[taken]]
            keep = np.ones(len(left), bool)
            keep[taken] = False
            left, at = left[keep], (at[keep] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Normaliser:
    """The machine that texts pass first: what it writes on entry, and its arcs that rewrite a character."""

    def __init__(self, entry: str, arcs: dict[str, str]) -> None:
        self.entry, self.arcs = entry, arcs

    def compose(self, text: str) -> str:
        for read, write in self.arcs.items():  # one state: every character takes its arc, wherever it stands
            text = text.replace(read, write)
        return self.entry + text


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes) -> None:
        ids: dict[str, int] = {}
        score: dict[str, float] = {}
        self.byte_ids = np.full(256, -1, np.int32)
        self.surface: list[bytes] = []
        dummy, extra, charsmap = True, True, b""
        n = 0
        for number, value in _fields(model):
            if number == 1:
                piece, value_of, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        value_of = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                if kind == 6:
                    code = int(piece[3:5], 16)
                    self.byte_ids[code] = n
                    self.surface.append(bytes([code]))
                elif kind in (1, 4):
                    ids[piece] = n
                    score[piece] = value_of
                    self.surface.append(piece.replace(MARK, " ").encode())
                else:
                    self.surface.append(b"")
                n += 1
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        charsmap = v
                    elif k == 3:
                        dummy = bool(v)
                    elif k == 4:
                        extra = bool(v)
        if charsmap or extra or not dummy or (self.byte_ids < 0).any():
            raise ValueError("only models with the identity normaliser, a leading space mark and byte fallback")
        wrong = [p for p in ids if MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1)]
        if wrong:
            raise ValueError(f"pieces with a mark or line end among other characters: {wrong[:3]}")
        self.ids, self.score, self.size = ids, score, n
        self.normaliser = Normaliser(MARK, {" ": MARK})
        alone = {c for p in ids for c in p} - set(ids)
        if alone:
            raise ValueError(f"characters of pieces that are no piece: {sorted(alone)[:5]}")
        self._compile()
        self.relaxed = 0
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def _compile(self) -> None:
        ids, n = self.ids, self.size
        self.cost = np.zeros(n + 1)
        self.rank = np.full(n + 1, -1, np.int32)  # when a merge makes the piece; single characters are there from the start
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        #: Pieces that share a score, or with a part that does or is made later than they are: ranks don't order their merges.
        self.odd = np.zeros(n + 1, bool)
        order = {p: r for r, p in enumerate(sorted(ids, key=lambda p: -self.score[p]))}
        held = Counter(self.score.values())
        made = []
        pair_keys, pair_values = [], []
        for p, i in ids.items():
            self.cost[i] = -self.score[p]
            if len(p) > 1:
                self.rank[i] = order[p]
                for k in range(1, len(p)):
                    a, b = ids.get(p[:k]), ids.get(p[k:])
                    if a is not None and b is not None:
                        pair_keys.append(a << 32 | b)
                        pair_values.append(i)
                parts, last = self.merged(p)
                if len(parts) > 1:
                    continue  # merges never make this piece
                self.left[i], self.right[i] = ids[last[0]], ids[last[1]]
            made.append(p)
        self.pairs = Lookup(np.array(pair_keys, np.int64), np.array(pair_values, np.int32))
        for p in sorted(made, key=len):
            i = ids[p]
            if self.left[i] >= 0:
                sides = [self.left[i], self.right[i]]
                self.odd[i] = held[self.score[p]] > 1 or any(self.rank[s] > self.rank[i] or self.odd[s] for s in sides)
        self.text_of = {i: p for p, i in ids.items()}
        #: Characters by number, 0 where no piece spells one; states of the trie, 0 its root.
        chars = sorted({c for p in made for c in p})
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {c: k + 1 for k, c in enumerate(chars)}
        trie: dict[int, int] = {}
        final = {}
        for p in made:
            node = 0
            for c in p:
                node = trie.setdefault(node * self.width + number[c], len(trie) + 1)
            final[node] = ids[p]
        self.trie = Lookup(np.fromiter(trie.keys(), np.int64), np.fromiter(trie.values(), np.int32))
        self.final = np.full(len(trie) + 1, -1, np.int32)
        self.final[list(final)] = list(final.values())

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The model's merges run on a short text, and the last two parts merged: the best-scoring neighbours first, the
        leftmost among equals. Compiling needs the parts of every piece."""
        parts, last = list(text), None
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                return parts, last
            last = parts[where], parts[where + 1]
            parts[where : where + 2] = [last[0] + last[1]]

    def joins_well(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave neighbours a and b (piece ids) as they are. Parts at the inner edges are undone, the one
        made last first; a merge across happens if it comes before those that use its two parts up, of equals the left."""
        ok = np.ones(len(a), bool)
        for i in np.flatnonzero(self.odd[a] | self.odd[b]):
            left, right = self.text_of[int(a[i])], self.text_of[int(b[i])]
            ok[i] = self.merged(left + right)[0] == [left, right]
        live = np.flatnonzero(~(self.odd[a] | self.odd[b]))
        a, b = a[live], b[live]
        end_a, end_b = np.full(len(live), _NEVER), np.full(len(live), _NEVER)
        while len(live):
            whole = self.pairs.get(a.astype(np.int64) << 32 | b)
            when = np.where(whole >= 0, self.rank[whole], _NEVER)
            crosses = (when < end_a) & (when <= end_b) & (whole >= 0)
            ok[live[crosses]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            go = ~crosses & ((made_a >= 0) | (made_b >= 0))
            undo = (made_a > made_b)[go]
            live, a, b, end_a, end_b, made_a, made_b = (v[go] for v in (live, a, b, end_a, end_b, made_a, made_b))
            end_a, end_b = np.where(undo, made_a, end_a), np.where(undo, end_b, made_b)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def arcs(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of the composition of characters with pieces and byte fallback; stop: the end of each
        character's part. A byte arc has the piece `size`."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        bare = np.flatnonzero(codes == 0)
        out = [(bare, bare + 1, np.full(len(bare), self.size, np.int32))]
        depth = 0
        while len(at):
            node = self.trie.get(node * self.width + codes[at + depth])
            depth += 1
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            piece = self.final[node]
            ends = piece >= 0
            out.append((at[ends], at[ends] + depth, piece[ends]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(c) for c in zip(*out))

    def shortest(self, parts: list[str]) -> list[bytes]:
        """Packed int32 ids of the shortest paths through the compositions with non-empty parts."""
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size)
        begin = end - size
        part = np.repeat(np.arange(len(parts)), size)
        begins, ends, piece = self.arcs(self.codes[points], end[part])
        self.relaxed += len(piece)
        # A part's position p is node p + its number, so parts have nodes of their own.
        source, target = begins + part[begins], ends + part[begins]
        place = ends - begin[part[begins]]
        order = np.lexsort((target, place))
        source, target, piece, place = source[order], target[order], piece[order], place[order]
        nodes = len(points) + len(parts)
        bad, cost = np.zeros(nodes, np.int32), np.zeros(nodes)
        last, back = np.full(nodes, self.size, np.int32), np.zeros(nodes, np.int64)
        bounds = np.searchsorted(place, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, t, p = source[lo:hi], target[lo:hi], piece[lo:hi]
            before = last[s]
            meets = np.flatnonzero((before < self.size) & (p < self.size))
            new_bad = bad[s]
            new_bad[meets] += ~self.joins_well(before[meets], p[meets])
            new_cost = cost[s] + self.cost[p]
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            heads, node = np.flatnonzero(first), np.cumsum(first) - 1
            new_cost[new_bad > np.minimum.reduceat(new_bad, heads)[node]] = np.inf
            best = np.flatnonzero(new_cost == np.minimum.reduceat(new_cost, heads)[node])
            best = best[np.concatenate([[True], node[best[1:]] != node[best[:-1]]])]
            t = t[best]
            bad[t], cost[t], last[t], back[t] = new_bad[best], new_cost[best], p[best], s[best]
        roots = begin + np.arange(len(parts))
        at, which = end + np.arange(len(parts)), np.arange(len(parts))
        steps = []
        while len(at):
            steps.append((which, at, last[at]))
            at = back[at]
            on = at > roots[which]
            at, which = at[on], which[on]
        which, node, token = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((node, which))
        which, node, token = which[order], node[order], token[order]
        cut = np.searchsorted(which, np.arange(len(parts) + 1)) * 4
        data = token.astype("<i4").tobytes()
        out = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in np.unique(which[token == self.size]).tolist():
            own = slice(int(cut[i]) // 4, int(cut[i + 1]) // 4)
            written = []
            for n, t in zip(node[own].tolist(), token[own].tolist()):
                char = parts[i][n - i - 1 - int(begin[i])]
                written += [t] if t < self.size else self.byte_ids[list(char.encode("utf-8", "replace"))].tolist()
            out[i] = np.array(written, "<i4").tobytes()
        return out

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts that the caches lack, composed some at a time: of like length, so they relax in step."""
        todo = sorted(new, key=len)
        out: dict[str, bytes] = {}
        lo = 0
        while lo < len(todo):
            hi = lo + max(1, AT_ONCE // len(todo[lo]))
            while hi > lo + 1 and sum(map(len, todo[lo:hi])) > 2 * AT_ONCE:
                hi = (lo + hi) // 2
            out.update(zip(todo[lo:hi], self.shortest(todo[lo:hi])))
            lo = hi
        return out

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        normal = self.normaliser.compose(text)
        if MARK * 2 in normal or MARK in text:
            return self.cut.findall(normal)
        return normal.replace(MARK, "\x01" + MARK)[1:].replace("\n", "\x01\n\x01").split("\x01") if "\x01" not in text else self.cut.findall(normal)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        seen = set().union(*cut)
        new = seen.difference(self.cache)
        again = new.intersection(self.older)
        found = {p: self.older[p] for p in again}
        found.update(self._learn(new - again))
        long = {p: v for p, v in found.items() if len(p) > CACHED_CHARS}
        if len(self.cache) + len(found) > CACHE_ENTRIES:
            # Whatever this batch needs goes along to the new generation.
            self.older, self.cache = self.cache, {p: self.cache[p] for p in seen if p in self.cache}
            self.cache[""] = b""
        self.cache.update(found)
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), "<i4") for c in cut]
        for p in long:
            del self.cache[p]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_LOADED: dict[int, Transducer] = kept(__name__)


def _loaded(model: bytes) -> Transducer:
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(model)
    return _LOADED[key]


def encode_decode(df: DataFrame, model_path: str = MODEL, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """df plus n_tokens, token_ids, round_trip (decoding gives back the text), and decoded if asked for. The model file
    (a fixed size, under 1 MB) is read on the driver and sent with the function."""
    with open(model_path, "rb") as f:
        model = f.read()
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
        *([T.StructField("decoded", T.StringType())] if decoded else []),
    ]
    names = {f.name for f in added}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*[df.schema[c] for c in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _loaded(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                ids = machine.encode_all(texts)
                back = [machine.decode(x) for x in ids]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                new = [
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                    pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                    *([pa.array(back, pa.string())] if decoded else []),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], *new], names=[*kept, *[f.name for f in added]]
                )

    return df.select(*kept).mapInArrow(tidy(run), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, decoded=False)
    return out.select("doc_id", "n_tokens", "token_ids", "round_trip")
