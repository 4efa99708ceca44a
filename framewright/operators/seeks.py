"""Seeks as events: each one begins a new epoch of a video's frames.

A seek (video_id, order, target_ns, accurate) that comes at some place in the order of a video's events raises the video's
serial. A frame belongs to the epoch of the last seek before it; frames of an older epoch are stale for whoever has seen a
newer one, and after an accurate seek frames before its target are not shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEEK = ["target_ns", "accurate"]


def with_epochs(frames: DataFrame, seeks: DataFrame) -> DataFrame:
    """frames (video_id, order, pts_ns, ...) with serial, the number of seeks before it, the last one's target_ns and accurate,
    and shown. An as-of join by one sort: seeks and frames of a video in their order, the last seek carried on. Of a seek and a frame
    at one place the seek comes first; of seeks at one place the one with the larger target is the last."""
    own = [c for c in frames.columns if c not in ("video_id", "order")]
    some = F.struct(*[F.col(c) for c in own])
    events = frames.select("video_id", "order", F.lit(1).alias("kind"), some.alias("frame"), *[F.lit(None).cast(t).alias(c) for c, t in zip(SEEK, ("bigint", "boolean"))])
    told = seeks.select("video_id", "order", F.lit(0).alias("kind"), F.lit(None).cast(events.schema["frame"].dataType).alias("frame"), F.col("target_ns").cast("bigint"), F.coalesce("accurate", F.lit(False)).alias("accurate"))
    so_far = Window.partitionBy("video_id").orderBy("order", "kind", F.asc_nulls_first("target_ns")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct(*SEEK)), ignorenulls=True).over(so_far)
    rows = events.unionByName(told).withColumn("serial", F.count_if(F.col("kind") == 0).over(so_far)).withColumn("seek", last).where("kind = 1")
    early = F.coalesce(F.col("seek.accurate") & (F.col("frame.pts_ns") < F.col("seek.target_ns")), F.lit(False))
    return rows.select("video_id", "order", *[F.col(f"frame.`{c}`").alias(c) for c in own], "serial", "seek.target_ns", "seek.accurate", (~early).alias("shown"))


def current(frames: DataFrame) -> DataFrame:
    """Of frames with serials those of their video's latest epoch that are shown."""
    newest = F.max("serial").over(Window.partitionBy("video_id"))  # of all frames, shown or not
    return frames.withColumn("newest", newest).where((F.col("serial") == F.col("newest")) & F.col("shown")).drop("newest")
