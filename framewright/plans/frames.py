"""Queries over frame sources, sampling and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..session import table
from ..sources import frames as V

FRAMES = """fr AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 100000 * 1000 AS pts_ns, event_type AS label, value FROM events)"""
SCHEDULE = """part AS (SELECT *, pts_ns // 1000000000 AS second, (pts_ns % 1000000000) / 1e9 AS frac FROM fr),
targets AS (SELECT *, len(list_filter(range(7), lambda i: frac + 1e-6 >= i / 7.0)) AS used,
  CASE WHEN second = lag(second) OVER (PARTITION BY video_id ORDER BY frame_index) THEN 0 ELSE 1 END AS change FROM part),
seconds AS (SELECT *, sum(change) OVER (PARTITION BY video_id ORDER BY frame_index) AS run FROM targets),
sampled AS (SELECT *, used > coalesce(max(used) OVER (PARTITION BY video_id, run ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sampled FROM seconds)"""
#: As SCHEDULE, with each video's last frame among the samples.
TAILED = SCHEDULE.removesuffix(" AS sampled FROM seconds)") + " OR row_number() OVER (PARTITION BY video_id ORDER BY frame_index DESC) = 1 AS sampled FROM seconds)"
ESTIMATES = """steps AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS ord,
  CASE WHEN pts_ns > lag(pts_ns) OVER (PARTITION BY video_id ORDER BY frame_index) THEN 1 / ((pts_ns - lag(pts_ns) OVER (PARTITION BY video_id ORDER BY frame_index)) / 1e9) END AS x FROM fr),
est AS (SELECT video_id, frame_index, pts_ns, ord, list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY video_id ORDER BY frame_index) AS xs FROM steps),
ema AS (SELECT video_id, frame_index, pts_ns, ord, CASE WHEN len(xs) > 0 THEN list_reduce(xs, lambda a, b: 0.8 * a + 0.2 * b) END AS fps FROM est)"""
HISTORY = ESTIMATES + """, caps AS (SELECT *, (CASE WHEN fps IS NULL THEN 24 ELSE least(greatest(ceil(fps), 1), 240) END)::BIGINT AS cap FROM ema),
hist AS (SELECT *, least(ord + 1, ord + min(cap - ord) OVER (PARTITION BY video_id ORDER BY frame_index)) AS length FROM caps)"""


def _frames(spark, d):
    return V.event_frames(table(spark, d, "events"))


def _serial(spark, d):
    return V.latest_serial(_frames(spark, d).withColumn("serial", F.expr("frame_index div 10"))).select("video_id", "frame_index", "serial")


def _mock(spark, d):
    luma = V.mock_luma(V.mock_frames(spark))
    return luma.groupBy("frame_index", "pts_ns").agg(F.sum(F.col("v").cast("long") * V.MOCK_WIDTH).alias("luma_sum"), F.count(F.lit(1)).alias("n_rows"))


def _derived(spark, d):
    frames = _frames(spark, d).withColumn("pts_ns", F.when(F.col("frame_index") % 5 != 0, F.col("pts_ns")))
    return frames.select("video_id", "frame_index", V.derived_index(F.col("pts_ns"), F.lit(29.97), F.col("frame_index")).alias("derived_index"))


def _metadata(spark, d):
    return V.metadata(_frames(spark, d)).withColumn("fps", F.round("fps", 6))


def _no_pts(spark, d):
    blind = _frames(spark, d).withColumn("pts_ns", F.lit(None).cast("long"))
    return S.with_sampled(blind).select("video_id", "frame_index", "second", "sampled")


def _history(spark, d):
    return S.history_lengths(S.fps_estimates(_frames(spark, d))).select("video_id", "frame_index", "length")


def _history_join(spark, d):
    return S.histories(S.with_sampled(_frames(spark, d)), only_sampled=True)


QUERIES = {
    "scan_start_frame": lambda s, d: V.from_frame(_frames(s, d), 5).select("video_id", "frame_index", "pts_ns", "label"),
    "seek_fast": lambda s, d: V.seek(_frames(s, d), 0.75, 7.0, accurate=False).select("video_id", "frame_index", "pts_ns"),
    "seek_accurate": lambda s, d: V.seek(_frames(s, d), 0.75, 7.0, accurate=True).select("video_id", "frame_index", "pts_ns"),
    "serial_filter": _serial,
    "mock_source": _mock,
    "frame_index_from_pts": _derived,
    "video_metadata": _metadata,
    "sample_per_second": lambda s, d: S.with_sampled(_frames(s, d)).where("sampled").select("video_id", "frame_index", "pts_ns", "second"),
    "sample_no_pts": _no_pts,
    "sample_with_tail": lambda s, d: S.with_sampled(_frames(s, d), tail=True).where("sampled").select("video_id", "frame_index", "pts_ns"),
    "dump_sample_first_n": lambda s, d: S.first_of_each_second(_frames(s, d), 3).select("video_id", "frame_index", F.col("place").cast("long").alias("place")),
    "history_length": _history,
    "history_join": _history_join,
    "fps_ema": lambda s, d: S.fps_estimates(_frames(s, d)).withColumn("fps", F.round("fps", 4)),
}
ORACLES = {
    "scan_start_frame": f"WITH {FRAMES} SELECT video_id, frame_index, pts_ns, label FROM fr WHERE frame_index >= 5",
    "seek_fast": f"WITH {FRAMES} SELECT video_id, frame_index, pts_ns FROM fr WHERE frame_index >= floor(0.75 * 7 + 0.5)",
    "seek_accurate": f"WITH {FRAMES} SELECT video_id, frame_index, pts_ns FROM fr WHERE frame_index >= floor(0.75 * 7) AND pts_ns >= 750000000",
    "serial_filter": f"WITH {FRAMES} SELECT video_id, frame_index, frame_index // 10 AS serial FROM fr QUALIFY frame_index // 10 = max(frame_index // 10) OVER (PARTITION BY video_id)",
    "mock_source": "SELECT f AS frame_index, f * 16000000 AS pts_ns, sum((y + f) % 256 * 640)::BIGINT AS luma_sum, count(*) AS n_rows FROM range(120) a(f), range(360) b(y) GROUP BY f",
    "frame_index_from_pts": f"WITH {FRAMES} SELECT video_id, frame_index, CASE WHEN frame_index % 5 <> 0 THEN floor(pts_ns / 1e9 * 29.97 + 0.5)::BIGINT ELSE frame_index END AS derived_index FROM fr",
    "video_metadata": f"""WITH {FRAMES}, m AS (SELECT video_id, max(pts_ns) AS duration_ns, count(*) AS n FROM fr GROUP BY video_id)
        SELECT video_id, duration_ns, round(CASE WHEN duration_ns > 0 THEN (n - 1) / (duration_ns / 1e9) END, 6) AS fps, n AS total_frames FROM m""",
    "sample_per_second": f"WITH {FRAMES}, {SCHEDULE} SELECT video_id, frame_index, pts_ns, second FROM sampled WHERE sampled",
    "sample_no_pts": f"WITH {FRAMES} SELECT video_id, frame_index, frame_index // 7 AS second, true AS sampled FROM fr",
    "sample_with_tail": f"WITH {FRAMES}, {SCHEDULE} SELECT video_id, frame_index, pts_ns FROM sampled QUALIFY sampled OR row_number() OVER (PARTITION BY video_id ORDER BY frame_index DESC) = 1",
    "dump_sample_first_n": f"WITH {FRAMES} SELECT video_id, frame_index, row_number() OVER (PARTITION BY video_id, pts_ns // 1000000000 ORDER BY frame_index) AS place FROM fr QUALIFY place <= 3",
    "history_length": f"WITH {FRAMES}, {HISTORY} SELECT video_id, frame_index, length FROM hist",
    "history_join": f"""WITH {FRAMES}, {SCHEDULE}, {HISTORY} SELECT a.video_id, a.frame_index, count(*) AS n_history, min(b.frame_index) AS first_index, min(b.pts_ns) AS first_pts_ns
        FROM hist a JOIN sampled s ON s.video_id = a.video_id AND s.frame_index = a.frame_index AND s.sampled
        JOIN hist b ON b.video_id = a.video_id AND b.ord <= a.ord AND b.ord > a.ord - a.length GROUP BY ALL""",
    "fps_ema": f"WITH {FRAMES}, {ESTIMATES} SELECT video_id, frame_index, round(fps, 4) AS fps FROM ema",
}
