"""A store for planes, apart from the metadata of their frames.

The store is bucketed by video and frame, so that a table of wanted frames is dealt out to the buckets and the planes
stay in place: a fetch streams each bucket past a hash table of its wanted rows, and gives features instead of planes.
A video of any length is spread over all buckets.
"""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import fields, is_dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

KEYS = ["video_id", "frame_index"]
#: Frames whose features a task holds before it gives them on.
ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session runs on one machine and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
    return spark.sparkContext.getCheckpointDir()


def kept(rows: DataFrame, label: str) -> DataFrame:
    """rows written to the shared folder and read back: what is used several times is made once."""
    path = f"{shared_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored(planes: DataFrame, buckets: int | None = None) -> DataFrame:
    """planes (video_id, frame_index, ...) as a bucketed table in the shared folder; a file for each bucket."""
    spark = planes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"planes_{uuid.uuid4().hex}"
    dealt = planes.repartition(n, *KEYS)
    dealt.write.bucketBy(n, *KEYS).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def packed(features) -> bytes | None:
    """Features as bytes, a bit for each truth value of an array."""
    if features is None or not is_dataclass(features):
        return None if features is None else pickle.dumps(features, protocol=5)
    values = [getattr(features, f.name) for f in fields(features)]
    bits = [(v.shape, np.packbits(v)) if isinstance(v, np.ndarray) and v.dtype == bool else (None, v) for v in values]
    return pickle.dumps((type(features), bits), protocol=5)


def unpacked(data: bytes | None):
    value = None if data is None else pickle.loads(data)
    if not isinstance(value, tuple) or not isinstance(value[0], type):
        return value
    kind, bits = value
    return kind(*[v if shape is None else np.unpackbits(v, count=math.prod(shape)).reshape(shape).astype(bool) for shape, v in bits])


def fetched(wanted: DataFrame, planes: DataFrame, comparator) -> DataFrame:
    """wanted (video_id, frame_index, x, y, width, height, ...) with features, those of the region in the frame's plane,
    null where there are none. Frames without a plane are left out."""
    own, names = [f"_{c}" for c in comparator.columns], wanted.columns
    content = planes.select(*KEYS, *[F.col(c).alias(o) for c, o in zip(comparator.columns, own)])
    rows = content.join(wanted.hint("shuffle_hash"), KEYS)
    read = {c: F.col(o) for c, o in zip(comparator.columns, own)} if comparator.narrow is None else comparator.narrow(lambda c: F.col(f"_{c}"), F.col)
    own = [f"_{c}" for c in read]
    rows = rows.select(*names, *[e.alias(o) for e, o in zip(read.values(), own)])
    target = to_arrow_schema(wanted.schema).append(pa.field("features", pa.binary()))

    Frame = namedtuple("Frame", list(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                # A plane is looked at where it lies in the batch.
                content = [[v.as_buffer() if v.is_valid else None for v in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in (part.column(o) for o in own)]
                frames, regions = (Frame(*f) for f in zip(*content)), zip(*(part.column(c).to_pylist() for c in ("x", "y", "width", "height")))
                if comparator.together is None:
                    made = [packed(comparator.extract(frame, roi)) for frame, roi in zip(frames, regions)]
                else:
                    found = comparator.together(frames, regions)
                    once = {id(f): packed(f) for f in {id(f): f for f in found}.values()}
                    made = [once[id(f)] for f in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(made, pa.binary())], schema=target)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return rows.mapInArrow(run, f"{schema}, features binary")


def cropped(segments: DataFrame, planes: DataFrame) -> DataFrame:
    """segments (video_id, end_frame, bounds, ...) with the part of the plane that bounds name: crop, crop_width."""
    wanted = segments.select(F.struct(*segments.columns).alias("s"), F.col("video_id"), F.col("end_frame").alias("frame_index"))
    rows = planes.select(*KEYS, "y_stride", "y_plane").join(wanted.hint("shuffle_hash"), KEYS)
    x0, y0, x1, y1 = (F.col(f"s.bounds.{c}").cast("int") for c in ("left", "top", "right", "bottom"))
    lines = F.transform(F.sequence(y0, y1 - 1), lambda y: F.hex(F.substring(F.col("y_plane"), y * F.col("y_stride") + x0 + 1, x1 - x0)))
    return rows.select("s.*", F.unhex(F.array_join(lines, "")).alias("crop"), (x1 - x0).alias("crop_width"))
