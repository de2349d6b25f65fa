"""The hook for a model's inference: whole batches, halved where the model refuses them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]


def in_halves(model: Model, batch: pd.DataFrame, refused: tuple[type[BaseException], ...] = (MemoryError,)) -> Iterator[pd.DataFrame]:
    """What the model makes of a batch; a batch that it refuses is halved until it takes the parts. The refusal of a
    single row is an error."""
    todo = [batch]
    while todo:
        part = todo.pop()
        try:
            told = model(part)
        except refused:
            if len(part) <= 1:
                raise
            middle = len(part) // 2
            todo += [part.iloc[middle:], part.iloc[:middle]]
            continue
        yield told


def whole_batches(frames: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Frames of one batch each, from frames sorted by batch whose borders fall anywhere."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for frame in frames:
        for _, group in frame.groupby(list(keys), dropna=False, sort=False):
            # Whole numbers come as such or, in frames with nulls, as floats.
            name = tuple(None if pd.isna(v) else v for v in group[list(keys)].iloc[0])
            if held and name != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(group)
            last = name
    if held:
        yield pd.concat(held, ignore_index=True)


def infer(
    df: DataFrame, model: Model, schema: T.StructType | str, keys: tuple[str, ...] = ("config", "batch"), refused: tuple[type[BaseException], ...] = (MemoryError,)
) -> DataFrame:
    """The model's rows for df, batch by batch (see batching.length_buckets, which bounds what a batch costs). A batch is
    in one task; a lost task is run again."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_batches(frames, keys):
            yield from in_halves(model, batch, refused)

    return dealt.mapInPandas(run, schema)
