"""Running counters and averages over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import fold_sorted

#: Fixed value: the share of a new detection time in the running average.
EMA_ALPHA = 0.1
#: Fixed value: the least change of progress that is told.
PROGRESS_STEP = 0.001


def progress(samples: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """samples_seen and progress at each sample: a count, or with totals (video_id, total_frames) the frame reached."""
    order = Window.partitionBy("video_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count(F.lit(1)).over(order)
    if totals is None:
        return samples.select("video_id", "frame_index", seen.alias("samples_seen"), F.lit(0.0).alias("progress"))
    joined = samples.join(totals.select("video_id", "total_frames"), "video_id", "left")
    known = F.col("total_frames").isNotNull()
    reached = F.when(known, F.least(F.col("frame_index") + 1, F.col("total_frames"))).otherwise(seen)
    done = F.when(known & (F.col("total_frames") > 0), F.col("frame_index") / F.col("total_frames")).otherwise(0.0)
    return joined.select("video_id", "frame_index", reached.cast("long").alias("samples_seen"), done.alias("progress"))


def detection_average(samples: DataFrame, column: str = "det_ms") -> DataFrame:
    """video_id, frame_index, det_ms: the exponential average after each sample, the first one as it is."""

    def step(state: dict, row) -> list[tuple]:
        if row is None:
            return []
        x = getattr(row, column)
        state["e"] = x if "e" not in state else (1 - EMA_ALPHA) * state["e"] + EMA_ALPHA * x
        return [(row.video_id, row.frame_index, state["e"])]

    return fold_sorted(samples.select("video_id", "frame_index", column), ["video_id"], ["frame_index"], dict, step, "video_id bigint, frame_index bigint, det_ms double")


def published(snapshots: DataFrame, step: float = PROGRESS_STEP) -> DataFrame:
    """The snapshots (video_id, frame_index, progress, completed) that are worth telling: those whose progress differs by
    step at least from the last one told, and the first completed one."""

    def advance(state: dict, row) -> list[tuple]:
        if row is None:
            return []
        done, state["done"] = bool(row.completed) and not state.get("done"), bool(row.completed)
        if not done and abs(row.progress - state.get("told", 0.0)) < step:
            return []
        state["told"] = row.progress
        return [(row.video_id, row.frame_index, row.progress)]

    return fold_sorted(snapshots.select("video_id", "frame_index", "progress", "completed"), ["video_id"], ["frame_index"], dict, advance, "video_id bigint, frame_index bigint, progress double")


def shown_ratio(progress: Column, completed: Column) -> Column:
    """Between 0 and 1; a completed run without progress is whole."""
    return F.least(F.greatest(F.when(completed & (progress <= 0), 1.0).otherwise(progress), F.lit(0.0)), F.lit(1.0))


def status(state: Column, completed: Column) -> Column:
    """What a run shows: Done once completed, else by its state; a run that is neither running nor paused is idle."""
    return F.when(completed, "Done").when(state == "running", "Processing").when(state == "paused", "Paused").otherwise("Idle")


def shown_rate(value: Column, unit: str) -> Column:
    return F.when(value <= 0, F.lit(f"-- {unit}")).otherwise(F.format_string(f"%.1f {unit}", value))


def shown_progress(fps: Column, det_ms: Column, seg_ms: Column, ocr_ms: Column, cues: Column, merged: Column, empty: Column) -> Column:
    """Two lines: averages and counts."""
    ms = [shown_rate(c, "ms") for c in (det_ms, seg_ms, ocr_ms)]
    averages = F.format_string("[   avg] fps %5.1f • det %s • seg %s • ocr %s", fps, *ms)
    return F.concat(averages, F.format_string("\n[counts] cues %d • merged %d • ocr-empty %d", cues, merged, empty))


def average_ms(total: str, units: str):
    """Milliseconds a unit; 0 without units."""
    return F.coalesce(F.sum(total) / F.nullif(F.sum(units), F.lit(0)), F.lit(0.0))
