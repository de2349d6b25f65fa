"""Texts as arrays of ids and back, a batch of rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch that goes to a Python worker: with long texts and several ids a character, tens of MB.
BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size for Python workers to BATCH_ROWS and leaves it so: plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _known(keys: list[int], values: list[int], none: int) -> np.ndarray:
    """A table from 0 to the largest key and one more place, where all others are sent."""
    out = np.full(max([*keys, 0]) + 2, none, np.int64)
    out[keys] = values
    return out


def encode_text(text: Column, vocab: dict[str, int], unknown: int) -> Column:
    """Ids of a text's characters, as arrays.encode gives them for its array of characters; the space is the
    vocabulary's '|'. Entries of several characters spell no text."""
    known = {ord(k): v for k, v in vocab.items() if len(k) == 1}
    known.pop(ord(" "), None)
    if "|" in vocab:
        known[ord(" ")] = vocab["|"]
    ids = _known(list(known), list(known.values()), unknown).astype(np.int32)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        told = texts.to_pylist()
        points = np.frombuffer("".join(t for t in told if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = ids[np.minimum(points, len(ids) - 1)]
        ends = np.cumsum([0, *(len(t or "") for t in told)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=texts.is_null())

    return run(text)


def ctc_text(ids: Column, vocab: dict[str, int], blank: int, space: int) -> Column:
    """Greedy decoding of ids (array<int> without nulls) as arrays.ctc_decode gives it: of equal neighbours the first
    stays, blanks go, ids outside the vocabulary's single characters spell nothing."""
    spelled = {v: k for k, v in vocab.items() if len(k) == 1}
    spelled[space] = " "
    spelled.pop(blank, None)
    codes = _known(list(spelled), [ord(c) for c in spelled.values()], -1)

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        bounds, null = lists.offsets.to_numpy(), lists.is_null().to_pylist()
        values, bounds = lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]
        kept = np.ones(len(values), bool)
        kept[1:] = values[1:] != values[:-1]
        kept[bounds[bounds < len(values)]] = True
        spelt = codes[np.where(values < 0, len(codes) - 1, np.minimum(values, len(codes) - 1))]
        kept &= spelt >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
        text = spelt[kept].astype(np.uint32).tobytes().decode("utf-32-le")
        return pa.array([None if null[i] else text[ends[i] : ends[i + 1]].strip(" ") for i in range(len(null))], pa.string())

    return run(ids)
