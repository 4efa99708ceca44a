"""Recognisers: plug-ins that give each segment its texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = "array<struct<text:string,confidence:float>>"


def with_engine(segments: DataFrame, engine: Callable[[], Callable[[dict], list[tuple[str, float | None]]]]) -> DataFrame:
    """texts from engine()(row), called once for each segment; engine() warms up once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = engine()
        for b in batches:
            # One segment's row at a time: its crop is not held twice for the whole batch.
            texts = [[{"text": t, "confidence": c} for t, c in recognise(dict(zip(b.columns, row)))] for row in b.itertuples(index=False, name=None)]
            yield b.assign(texts=texts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInPandas(run, f"{schema}, texts {TEXTS}")


def silent() -> Callable[[dict], list]:
    """The engine that recognises nothing."""
    return lambda row: []


def with_lookup(segments: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """texts from a table (key, text): a deterministic recogniser for tests. A segment without an entry gets none."""
    found = lookup.select(F.col(key), F.array(F.struct("text", F.lit(None).cast("float").alias("confidence"))).alias("texts"))
    return segments.join(found, key, "left").withColumn("texts", F.coalesce("texts", F.array().cast(TEXTS)))


def bar_reader(bars: int = 4, target: int = 230) -> Callable[[dict], list]:
    """An engine over crops (crop, crop_width) for tests: it cuts a crop into bars side by side and reads a letter in each,
    A for a dark one up to Z for a bright one; a crop with no bright bar holds no text."""

    def recognise(row: dict) -> list[tuple[str, float | None]]:
        lines = np.frombuffer(row["crop"], np.uint8).reshape(-1, row["crop_width"]) >= target
        shares = [part.mean() if part.size else 0.0 for part in np.array_split(lines, bars, axis=1)]
        text = "".join(chr(65 + int(25 * s + 0.5)) for s in shares)
        return [(text, float(max(shares)))] if max(shares) >= 0.5 else []

    return recognise
