"""Pausing, resuming and cancelling as events beside the frames.

Controls (video_id, order, command: pause, resume or cancel) take effect at their place in the order of a video's events. A frame
that comes while its video is paused is held until the next resume and is then passed on, in order; after a cancel, or
while paused for good, it isn't. So a run that was paused and resumed gives what an uninterrupted one gives, later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUNNING, PAUSED, CANCELLED = "running", "paused", "cancelled"


def gated(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """frames (video_id, order, ...) with state, that of the video when the frame comes, and released_at, the place at which it
    is passed on: its own, that of the resume, or null if never. At one place commands come before frames, and a cancel before a
    resume before a pause. Two as-of joins, back and ahead, by two sorts of one partitioning."""
    own = [c for c in frames.columns if c not in ("video_id", "order")]
    events = frames.select("video_id", "order", F.lit(3).alias("kind"), F.struct(*own).alias("frame"))
    kind = F.when(F.col("command") == "cancel", 0).when(F.col("command") == "resume", 1).when(F.col("command") == "pause", 2)
    told = controls.select("video_id", "order", kind.alias("kind"), F.lit(None).cast(events.schema["frame"].dataType).alias("frame")).where("kind is not null")
    in_order = Window.partitionBy("video_id").orderBy("order", "kind")
    so_far, ahead = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    last = F.last(F.when(F.col("kind") < 3, F.col("kind")), ignorenulls=True).over(so_far)
    cancelled = F.max((F.col("kind") == 0).cast("int")).over(so_far) == 1
    state = F.when(cancelled, CANCELLED).when(last == 2, PAUSED).otherwise(RUNNING)
    rows = events.unionByName(told).withColumn("state", state)
    following = [F.first(F.when(F.col("kind") == k, F.struct("order", "kind")), ignorenulls=True).over(ahead).alias(n) for k, n in ((1, "resume"), (0, "cancel"))]
    rows = rows.select("*", *following).where("kind = 3")
    freed = F.when(F.col("cancel").isNull() | (F.col("resume") < F.col("cancel")), F.col("resume.order"))
    released = F.when(F.col("state") == RUNNING, F.col("order")).when(F.col("state") == PAUSED, freed)
    return rows.select("video_id", "order", *[F.col(f"frame.`{c}`").alias(c) for c in own], "state", released.alias("released_at"))
