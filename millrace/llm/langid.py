"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, convolved with filters of several widths, rectified, max-pooled over a fixed-length window and
classified by softmax; a text's probabilities are the mean over all its windows, which cover it whole. For prediction
the convolution is tabulated over byte pairs, which gives the same sums with two lookups a byte.

Learning takes at most SAMPLE_DOCS labelled documents of each language (the ones of smallest id hash among those with
crc32(id as text) mod 5 <> 0) and WINDOWS_EACH windows of each. Language, source and id are never inputs. A text that is
null or has no letter is `und` with score 0; a row with a null id counts as held out. Without any labelled text every
prediction is `und`. Repeated rows are predicted alike; an empty table gives no rows; columns besides id, text and lang
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import table, tidy, unused

WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 8, 8
SAMPLE_DOCS, WINDOWS_EACH, EPOCHS, LEAST_STEPS, SEED = 400, 6, 6, 200, 17
FOLDS = 5
LETTER = r"\p{L}"


class ByteCNN:
    """Filters narrower than the widest have zero weights beyond their width, so one product serves all widths."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.mask = np.zeros((wide, DIMS, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.conv = (rng.normal(0, 0.3, (wide, DIMS, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.1, (n, max(1, len(labels)))).astype(np.float32)
        self.out = np.zeros(max(1, len(labels)), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e, wide = self.embed[x], max(WIDTHS)
        return np.concatenate([e[:, o : WINDOW - wide + 1 + o] for o in range(wide)], axis=2)

    def fit(self, x: np.ndarray, y: np.ndarray, batch: int = 64, rate: float = 0.01) -> ByteCNN:
        """Adam on cross-entropy with classes weighted evenly. x: windows of bytes, y: class numbers."""
        epochs = max(EPOCHS, -(-LEAST_STEPS * batch // len(x)))
        rng = np.random.default_rng(SEED)
        share = np.bincount(y, minlength=len(self.labels)).astype(np.float32)
        weight = (len(y) / np.maximum(share, 1) / len(self.labels))[y]
        params = ["embed", "conv", "bias", "dense", "out"]
        m = {p: np.zeros_like(getattr(self, p)) for p in params}
        v = {p: np.zeros_like(getattr(self, p)) for p in params}
        step, wide, n = 0, max(WIDTHS), self.conv.shape[2]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                columns = self._columns(x[at])
                scores = columns @ self.conv.reshape(wide * DIMS, n) + self.bias
                where = scores.argmax(axis=1)
                pooled = np.maximum(np.take_along_axis(scores, where[:, None], 1)[:, 0], 0)
                p = _softmax(pooled @ self.dense + self.out)
                p[np.arange(len(at)), y[at]] -= 1
                p *= (weight[at] / len(at))[:, None]
                g = {"dense": pooled.T @ p, "out": p.sum(0)}
                back = (p @ self.dense.T) * (pooled > 0)
                patches = columns[np.arange(len(at))[:, None], where]
                g["conv"] = np.einsum("bf,bfk->kf", back, patches).reshape(self.conv.shape) * self.mask
                g["bias"] = back.sum(0)
                inner = back[:, :, None] * self.conv.reshape(wide * DIMS, n).T[None]
                g["embed"] = np.zeros_like(self.embed)
                for o in range(wide):
                    chars = np.take_along_axis(x[at], where + o, 1)
                    np.add.at(g["embed"], chars, inner[:, :, o * DIMS : (o + 1) * DIMS])
                step += 1
                for name in params:
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    fix = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    getattr(self, name)[...] -= (fix * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
        return self

    def pair_tables(self) -> list[np.ndarray]:
        """Sums of the convolution's terms at offsets (0, 1) and (2, 3) for every pair of bytes."""
        out = []
        for o in range(0, max(WIDTHS), 2):
            a, b = self.embed @ self.conv[o], self.embed @ self.conv[o + 1]
            out.append(np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, -1)))
        return out

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray] | None = None, at_once: int = 128) -> np.ndarray:
        tables = tables or self.pair_tables()
        out = np.empty((len(x), len(self.out)), np.float32)
        span = WINDOW - max(WIDTHS) + 1
        for lo in range(0, len(x), at_once):
            part = x[lo : lo + at_once].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            sums = np.take(tables[0], pairs[:, :span], axis=0)
            for k, more in enumerate(tables[1:], 1):
                sums += np.take(more, pairs[:, 2 * k : 2 * k + span], axis=0)
            pooled = np.maximum(sums.max(axis=1) + self.bias, 0)
            out[lo : lo + at_once] = _softmax(pooled @ self.dense + self.out)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN:
    """Trains on a bounded sample: ids are drawn without their texts, then the chosen texts' windows, at most
    SAMPLE_DOCS x WINDOWS_EACH x WINDOW bytes a language, come to the driver."""
    rows = df.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    known = rows.where(F.col("l").isNotNull() & ~held_out("i"))
    # Ids are drawn by hash, somewhat more than needed of each language, so nothing is ranked in one task.
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    draw = F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("l") == lang, int(min(1.0, 1.3 * SAMPLE_DOCS / n) * (1 << 30))).otherwise(share)
    drawn: dict[str, list[tuple]] = {}
    for r in known.select("l", "i", draw.alias("h")).where(F.col("h") < share).distinct().collect():
        drawn.setdefault(r["l"], []).append((r["h"], r["i"]))
    ids = [i for rows in drawn.values() for _, i in sorted(set(rows))[:SAMPLE_DOCS]]
    data = F.encode("t", "utf-8")
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)),
        lambda k: F.substring(
            data, (k * F.greatest(F.octet_length("t") - WINDOW, F.lit(0)) / (WINDOWS_EACH - 1)).cast("int") + 1, F.lit(WINDOW)
        ),
    )
    chosen = known.where(F.col("i").isin(ids) & F.col("t").rlike(LETTER))
    # An id that repeats gives the windows of one of its texts, so what comes here is bounded by the ids.
    held = chosen.select("l", "i", F.array_distinct(spread).alias("w")).groupBy("l", "i").agg(F.min("w").alias("w"))
    got = sorted((r["l"], r["i"], w) for r in held.collect() for w in r["w"])
    labels = sorted({g[0] for g in got})
    number = {c: k for k, c in enumerate(labels)}
    x = np.zeros((len(got), WINDOW), np.uint8)
    for k, (_, _, w) in enumerate(got):
        x[k, : len(w)] = np.frombuffer(bytes(w), np.uint8)
    net = ByteCNN(labels)
    return net.fit(x, np.array([number[g[0]] for g in got])) if len(labels) else net


def predict(df: DataFrame, net: ByteCNN, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df plus the predicted language and its score under the given names; columns of these names are replaced."""
    kept = [c for c in df.columns if c.lower() not in [n.lower() for n in names]]
    schema = df.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    letters = unused(df, "_millrace_letters")
    ready: dict[str, list[np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "tables" not in ready:
            ready["tables"] = net.pair_tables()
        for batch in batches:
            texts, langs, scores = batch.column(text_col), [], []
            lettered = batch.column(letters).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.buffers(texts):
                rows = np.flatnonzero(lettered[lo:hi]) if net.labels else np.empty(0, np.int64)
                count = -(-np.diff(offsets)[rows] // WINDOW)
                starts = np.concatenate([[0], np.cumsum(count)])
                x = np.zeros((int(starts[-1]), WINDOW), np.uint8)
                flat = x.reshape(-1)
                for k, i in enumerate(rows):
                    flat[starts[k] * WINDOW : starts[k] * WINDOW + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
                lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if len(rows):
                    p = np.add.reduceat(net.probabilities(x, ready["tables"]).astype(np.float64), starts[:-1]) / count[:, None]
                    best = p.argmax(axis=1)
                    score[rows] = np.minimum(p[np.arange(len(rows)), best], 1.0)
                    for k, i in enumerate(rows):
                        lang[i] = net.labels[best[k]]
                langs += lang
                scores.append(score)
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, *names])

    # One expression tells letters in training and prediction.
    told = df.select(*kept, F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias(letters))
    return told.mapInArrow(tidy(run), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs)
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
