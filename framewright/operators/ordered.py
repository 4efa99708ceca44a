"""Ordered folds over the rows of a key, in constant memory."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of a key, in order, through step(state, row) -> list of output tuples; start() makes a key's state.

    Rows stream through in Arrow batches, sorted by Spark within hash partitions, so a key of any length needs only
    its state; step(state, None) ends a key. Values are Python's own, null is None, and null keys are one key.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))
    Row = namedtuple("Row", df.columns)
    at = [df.columns.index(k) for k in keys]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                own = [values[i] for i in at]
                if own != key:
                    if key is not None:
                        out += step(state, None)
                    key, state = own, start()
                out += step(state, Row(*values))
            yield made(out)
        if key is not None:
            yield made(step(state, None))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
