"""Frame tables: adapters from the driver's tables, generated frames, scans, seeks and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the generated source: 640 x 360, 120 frames, 16 ms apart, 60 frames a second.
MOCK_WIDTH, MOCK_HEIGHT, MOCK_FRAMES, MOCK_STEP_NS, MOCK_FPS = 640, 360, 120, 16_000_000, 60.0
#: Extensions of the containers that are accepted.
CONTAINERS = ("mp4", "mov", "mkv", "webm", "avi", "m4v", "mpg", "mpeg", "ts")


def event_frames(events: DataFrame, tracks: int = 1) -> DataFrame:
    """video_id, track, frame_index, pts_ns, label, value: one frame for each event.

    A user is a track, and ``tracks`` neighbouring users share a video. Time runs 100,000 times as fast and starts
    at the video's first event.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    video = F.expr(f"user_id div {tracks}")
    whole, order = Window.partitionBy("video_id"), Window.partitionBy("video_id").orderBy("ts", "event_id")
    rows = events.select(video.alias("video_id"), F.col("user_id").alias("track"), "ts", "event_id", us.alias("us"), F.col("event_type").alias("label"), "value")
    rows = rows.withColumn("first_us", F.min("us").over(whole)).withColumn("frame_index", (F.row_number().over(order) - 1).cast("long"))
    return rows.select("video_id", "track", "frame_index", (F.expr("(us - first_us) div 100000") * 1000).alias("pts_ns"), "label", "value")


def mock_frames(spark: SparkSession, frames: int = MOCK_FRAMES, start_frame: int = 0) -> DataFrame:
    """frame_index, pts_ns; rows are generated by the JVM, so a start frame costs nothing."""
    return spark.range(min(start_frame, frames), frames).select(F.col("id").alias("frame_index"), (F.col("id") * MOCK_STEP_NS).alias("pts_ns"))


def mock_luma(frames: DataFrame, height: int = MOCK_HEIGHT) -> DataFrame:
    """A row (y, v) for each row of pixels, which are all alike: v = (y + frame_index) % 256."""
    return frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("v", ((F.col("y") + F.col("frame_index")) % 256).cast("int"))


def luma(e):
    """A number from about -0.6..0.6 as 0..255."""
    return F.least(F.greatest(F.floor((e.cast("double") + 0.6) / 1.2 * 255), F.lit(0)), F.lit(255)).cast("int")


def pixel_rows(vectors: DataFrame, rows: int = 16) -> DataFrame:
    """image, y, x, v: each vector a row of pixels, ``rows`` of them an image."""
    places = vectors.select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return places.select(F.expr(f"vec_id div {rows}").alias("image"), (F.col("vec_id") % rows).cast("int").alias("y"), "x", luma(F.col("e")).alias("v"))


def pixel_lines(vectors: DataFrame, rows: int = 16) -> DataFrame:
    """image, y, line: as pixel_rows, with the values of a row in one array."""
    return vectors.select(F.expr(f"vec_id div {rows}").alias("image"), (F.col("vec_id") % rows).cast("int").alias("y"), F.transform("embedding", luma).alias("line"))


def from_frame(frames: DataFrame, start_frame: int) -> DataFrame:
    return frames.where(F.col("frame_index") >= start_frame)


def seek(frames: DataFrame, seconds: float, fps: float, accurate: bool) -> DataFrame:
    """Fast: from the frame nearest to the time. Accurate: from the frame below it, and none before the time."""
    if not accurate:
        return frames.where(F.col("frame_index") >= int(seconds * fps + 0.5))
    return frames.where((F.col("frame_index") >= int(seconds * fps)) & (F.col("pts_ns") >= int(seconds * 1e9)))


def latest_serial(frames: DataFrame) -> DataFrame:
    """Frames of each video's newest seek epoch."""
    return frames.withColumn("newest", F.max("serial").over(Window.partitionBy("video_id"))).where("serial = newest").drop("newest")


def derived_index(pts_ns: Column, fps: Column, counter: Column) -> Column:
    """round(seconds * fps), half away from zero; without a time or a positive rate, the running counter."""
    return F.coalesce(F.when((pts_ns >= 0) & (fps > 0), F.floor(pts_ns / 1e9 * fps + 0.5)), counter).cast("long")


def from_ticks(ticks: Column, numerator: int, denominator: int) -> Column:
    """Nanoseconds of a time stamp in units of numerator / denominator seconds; none for negative or non-finite ones."""
    ns = F.floor(ticks / float(denominator) * numerator * 1e9 + 0.5)
    return F.when((ticks >= 0) & (ticks < float("inf")), ns).cast("long")


def frame_time(pts_ns: Column, index: Column, fps: Column, otherwise: Column | None = None) -> Column:
    """A frame's own time, else its index over the rate, else what is given (null; a sample's time is then 0)."""
    guessed = F.when(fps > 0, F.floor(index / fps * 1e9).cast("long"))
    return F.coalesce(pts_ns, guessed, *([] if otherwise is None else [otherwise]))


def native_index(pts_ns: Column, fps: Column, counter: Column, start_frame: int = 0) -> Column:
    """The index of a frame of a native source: from its time, else a running counter from the start frame."""
    return derived_index(pts_ns, fps, counter + start_frame)


def sorted_frames(frames: DataFrame, arrival: str) -> DataFrame:
    """Frames by index, the first to arrive of equal ones; those without an index are numbered as they arrive. Order by
    key to read them in order."""
    blind = F.row_number().over(Window.partitionBy("video_id", F.col("frame_index").isNull()).orderBy(arrival)) - 1
    rows = frames.withColumn("key", F.coalesce("frame_index", blind.cast("long")))
    first = F.row_number().over(Window.partitionBy("video_id", "key").orderBy(arrival))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")


def metadata(frames: DataFrame) -> DataFrame:
    """video_id, duration_ns, fps, total_frames."""
    m = frames.groupBy("video_id").agg(F.max("pts_ns").alias("duration_ns"), F.count(F.lit(1)).alias("n"))
    fps = F.when(F.col("duration_ns") > 0, (F.col("n") - 1) / (F.col("duration_ns") / 1e9))
    return m.select("video_id", "duration_ns", fps.alias("fps"), F.coalesce((F.floor(F.col("duration_ns") / 1e9 * fps + 0.5) + 1).cast("long"), F.col("n")).alias("total_frames"))


def accepted_containers(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.where(F.lower(F.regexp_extract(column, r"\.([^./\\]+)$", 1)).isin(*CONTAINERS))
