"""Streaming over the Arrow batches of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but integers stay exact: a column with nulls comes as Python numbers and None, not as floats."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def on_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(on_arrow, schema)


def runs(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of equal key, from batches in which equal keys follow each other. One group is held at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        cuts = [0, *(np.nonzero(k[1:] != k[:-1])[0] + 1), len(b)]
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            part = b.iloc[x:y]
            if i == 0 and held and held[0][key].iloc[0] == k[0]:
                held.append(part)
                continue
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def chunks(texts: Iterable, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about size characters together."""
    start = total = end = 0
    for end, t in enumerate(texts, 1):
        total += len(t) if isinstance(t, str) else 0
        if total >= size:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end
