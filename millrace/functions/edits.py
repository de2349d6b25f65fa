"""Edit distances of normalized texts, in words and in characters."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences: a column of the table is the bits of two integers (up and down by one
    from row to row), so a step costs len(a) / 64 machine words instead of len(a) places."""
    if len(a) < len(b):
        a, b = b, a
    at = 0
    while at < len(b) and a[at] == b[at]:
        at += 1
    end = 0
    while end < len(b) - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    if not b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = full, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        zero = ((same & up) + up ^ up) | same | down
        right = (down | ~(zero | up)) & full
        left = zero & up
        if right & last:
            out += 1
        elif left & last:
            out -= 1
        right = right << 1 | 1
        up = (left << 1 | ~(zero | right)) & full
        down = zero & right & full
    return out


@F.pandas_udf(T.StructType([T.StructField("word_errors", T.LongType()), T.StructField("char_errors", T.LongType())]))
def edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Distances of two normalized texts in words and in characters without spaces."""
    words, chars = [], []
    for r, h in zip(reference, hypothesis):
        words.append(0 if r == h else distance(r.split(" "), h.split(" ")) if r and h else len((r or h).split(" ")))
        chars.append(0 if r == h else distance(r.replace(" ", ""), h.replace(" ", "")))
    return pd.DataFrame({"word_errors": words, "char_errors": chars}, dtype="int64")
