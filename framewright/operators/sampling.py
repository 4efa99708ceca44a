"""Rate-limited sampling, history windows and frame-rate estimates over frame metadata."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import fold_sorted

#: Tolerance of a target, history before a rate is known, and its upper bound.
EPSILON, DEFAULT_HISTORY, MAX_HISTORY = 1e-6, 24, 240


def _ordered(*partition: str) -> Window:
    return Window.partitionBy("video_id", *partition).orderBy("frame_index")


def with_schedule(frames: DataFrame, per_second: int = 7) -> DataFrame:
    """second and used, the targets i / per_second that a frame's place in its second has passed. Without a time,
    frames are taken as per_second a second."""
    n = F.row_number().over(_ordered()) - 1
    second = F.coalesce(F.expr("pts_ns div 1000000000"), F.floor(n / per_second))
    part = F.coalesce((F.col("pts_ns") % 1_000_000_000) / 1e9, (n % per_second) / F.lit(float(per_second)))
    used = F.size(F.filter(F.sequence(F.lit(0), F.lit(per_second - 1)), lambda i: F.col("part") + EPSILON >= i / F.lit(float(per_second))))
    rows = frames.withColumn("second", second.cast("long")).withColumn("part", part)
    change = F.when(F.col("second") == F.lag("second").over(_ordered()), 0).otherwise(1)
    rows = rows.withColumn("used", used).withColumn("change", change)
    return rows.withColumn("run", F.sum("change").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("change", "part")


def with_sampled(frames: DataFrame, per_second: int = 7, tail: bool = False) -> DataFrame:
    """sampled: the frame is the first of its second to pass another target; with tail, a video's last frame too."""
    before = _ordered("run").rowsBetween(Window.unboundedPreceding, -1)
    sampled = F.col("used") > F.coalesce(F.max("used").over(before), F.lit(0))
    if tail:
        sampled = sampled | F.lead("frame_index").over(_ordered()).isNull()
    return with_schedule(frames, per_second).withColumn("sampled", sampled).drop("used", "run")


def first_of_each_second(frames: DataFrame, n: int = 7) -> DataFrame:
    w = Window.partitionBy("video_id", F.expr("pts_ns div 1000000000")).orderBy("frame_index")
    return frames.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def new_estimate(fps: float | None, before: tuple | None, row) -> tuple[float | None, tuple | None]:
    """The running frame rate, 0.8 of the last plus 0.2 of the new one, and the last frame with a time."""
    if row.pts_ns is None:
        return fps, before
    if before and row.frame_index > before[0] and row.pts_ns > before[1]:
        x = (row.frame_index - before[0]) / ((row.pts_ns - before[1]) / 1e9)
        fps = x if fps is None else 0.8 * fps + 0.2 * x
    return fps, (row.frame_index, row.pts_ns)


def capacity(fps: float | None) -> int:
    """The frames of a history: about a second."""
    return DEFAULT_HISTORY if fps is None else min(max(math.ceil(fps), 1), MAX_HISTORY)


def fps_estimates(frames: DataFrame) -> DataFrame:
    """video_id, frame_index, fps: the running estimate at each frame."""

    def step(state: list, row) -> list[tuple]:
        if row is None:
            return []
        state[:] = new_estimate(*state, row)
        return [(row.video_id, row.frame_index, state[0])]

    return fold_sorted(frames.select("video_id", "frame_index", "pts_ns"), ["video_id"], ["frame_index"], lambda: [None, None], step, "video_id bigint, frame_index bigint, fps double")


def histories(frames: DataFrame, only_sampled: bool = False) -> DataFrame:
    """video_id, frame_index, n_history, first_index, first_pts_ns: the history of each frame (or each with sampled
    set), itself included, in one pass that holds no more than it."""

    def step(state: list, row) -> list[tuple]:
        if row is None:
            return []
        fps, before, held = state
        fps, before = new_estimate(fps, before, row)
        held.append((row.frame_index, row.pts_ns))
        while len(held) > capacity(fps):
            held.popleft()
        state[:] = fps, before, held
        return [(row.video_id, row.frame_index, len(held), held[0][0], min((t for _, t in held if t is not None), default=None))] if row.sampled else []

    rows = frames.select("video_id", "frame_index", "pts_ns", F.col("sampled") if only_sampled else F.lit(True).alias("sampled"))
    return fold_sorted(rows, ["video_id"], ["frame_index"], lambda: [None, None, deque()], step, "video_id bigint, frame_index bigint, n_history bigint, first_index bigint, first_pts_ns bigint")


def history_lengths(estimates: DataFrame) -> DataFrame:
    """ord and length: a frame's place in its video, and the frames of its history, itself included. What a smaller
    capacity has once pushed out does not come back."""
    capacity = F.when(F.col("fps").isNull(), DEFAULT_HISTORY).otherwise(F.least(F.greatest(F.ceil("fps"), F.lit(1)), F.lit(MAX_HISTORY)))
    rows = estimates.withColumn("ord", (F.row_number().over(_ordered()) - 1).cast("long")).withColumn("spare", capacity - F.col("ord"))
    least = F.min("spare").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("length", F.least(F.col("ord") + 1, F.col("ord") + least).cast("long")).drop("spare")


def history_pairs(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """samples (video_id, ord, length, ...) with each frame of their histories. A range join, made an equi-join by
    blocks of MAX_HISTORY ordinals: a history reaches into one earlier block at most."""
    s = samples.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"(ord - length + 1) div {MAX_HISTORY}"), F.expr(f"ord div {MAX_HISTORY}")))))
    past = frames.select("video_id", F.col("ord").alias("past_ord"), F.col("frame_index").alias("past_index"), F.col("pts_ns").alias("past_pts_ns"), F.expr(f"ord div {MAX_HISTORY}").alias("block"))
    return s.join(past, ["video_id", "block"]).where((F.col("past_ord") <= F.col("ord")) & (F.col("past_ord") > F.col("ord") - F.col("length"))).drop("block")
