"""Queries over sources and sinks: files of many frames, SubRip files, seeks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import controls as G
from ..operators import convert as X
from ..operators import metrics as M
from ..operators import seeks as K
from ..session import table
from ..sources import framefiles as FF
from ..sources import frames as V
from ..sources import subrip
from ..sources.planes import kept, shared_dir
from .frames import FRAMES
from .pixels import H, W, _planes
from .segments import ORACLES as SEGMENTS
from .segments import _merged

STEP_NS = 40_000_000
#: Images of a video, one frame each.
PER_VIDEO = 8


def _files(spark, d):
    """All of embeddings as images, written as raw files of several frames."""
    rows = _planes(spark, d).select(
        F.expr(f"image div {PER_VIDEO}").alias("video_id"), (F.col("image") % PER_VIDEO).alias("frame_index"), "width", "height", F.lit(W).alias("y_stride"), F.col("plane").alias("y_plane"),
        F.unhex(F.repeat(F.lpad(F.hex(F.col("image") % 256), 2, "0"), W * H // 2)).alias("uv_plane"),
    )
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    kept(FF.write_frame_files(rows, folder), "file-list")  # writes the files
    return folder


def _told(frames):
    video = F.regexp_extract("path", r"([0-9]+)\.yuv$", 1).cast("long")
    return frames.select(video.alias("video_id"), "frame_index", "pts_ns", F.md5("y_plane").alias("y_md5"), F.md5("uv_plane").alias("uv_md5"))


def _scan(spark, d):
    return _told(FF.frame_files(spark, _files(spark, d), W, H, step_ns=STEP_NS, partition_bytes=3 * W * H, start_frame=2))


def _seek(mode):
    return lambda spark, d: _told(FF.frame_files(spark, _files(spark, d), W, H, step_ns=STEP_NS, seek_ns=95_000_000, seek=mode))


def _srt(spark, d):
    """One .srt a video, read back."""
    folder = f"{shared_dir(spark)}/srt-{uuid.uuid4().hex}"
    subrip.save(_merged(spark, d), folder)
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.srt")
    return text.select(F.regexp_extract("_metadata.file_name", r"([0-9]+)\.srt$", 1).cast("long").alias("video_id"), F.col("value").alias("srt"))


def _epochs(spark, d):
    """A signup is a seek to a place a little later, every second one accurate."""
    frames = V.event_frames(table(spark, d, "events")).withColumn("order", F.col("frame_index"))
    seeks = frames.where("label = 'signup'").select("video_id", "order", (F.col("pts_ns") + F.col("frame_index") % 3 * 200_000_000).alias("target_ns"), (F.col("frame_index") % 2 == 0).alias("accurate"))
    return K.with_epochs(frames.select("video_id", "order", "frame_index", "pts_ns"), seeks).drop("order")


def _colour_frames(spark, d):
    """48 vectors are a picture: 16 lines of red, 16 of green and 16 of blue. What the last picture lacks is 0."""
    lines = V.pixel_lines(table(spark, d, "embeddings").select("vec_id", "embedding"), 3 * H)
    texts = F.map_from_entries(F.collect_list(F.struct("y", "line")))
    images = lines.groupBy("image").agg(texts.alias("lines"))
    byte = lambda y, x: F.lpad(F.hex(F.coalesce(F.get(F.element_at("lines", y), x), F.lit(0)).cast("long")), 2, "0")
    at = F.sequence(F.lit(0), F.lit(W * H - 1))
    text = F.transform(at, lambda i: F.concat(*[byte(F.floor(i / W).cast("int") + H * c, i % W) for c in range(3)]))
    return images.select("image", F.lit("rgb24").alias("layout"), F.lit(W).alias("width"), F.lit(H).alias("height"), F.unhex(F.array_join(text, "")).alias("data"))


def _converted(width, height):
    def run(spark, d):
        out = X.converted(_colour_frames(spark, d), width, height)
        return out.select("image", "width", "height", F.md5("y_plane").alias("y_md5"), F.md5("uv_plane").alias("uv_md5"))

    return run


def _gated(spark, d):
    """Errors pause a video, purchases resume it, and a signup at a frame divisible by 41 cancels it."""
    frames = V.event_frames(table(spark, d, "events")).withColumn("order", F.col("frame_index"))
    command = F.when(F.col("label") == "error", "pause").when(F.col("label") == "purchase", "resume").when((F.col("label") == "signup") & (F.col("frame_index") % 41 == 40), "cancel")
    controls = frames.select("video_id", "order", command.alias("command")).where("command is not null")
    return G.gated(frames.select("video_id", "order", "frame_index", "pts_ns"), controls).drop("order")


def _status(spark, d):
    """What a run shows at each frame; it is done at the last frame of a video that runs."""
    gated = _gated(spark, d)
    last = F.max("frame_index").over(Window.partitionBy("video_id")) == F.col("frame_index")
    rows = gated.withColumn("completed", last & (F.col("state") == G.RUNNING))
    return rows.select("video_id", "frame_index", M.status(F.col("state"), F.col("completed")).alias("status"))


QUERIES = {
    "run_status": _status,
    "pixel_format": _converted(None, None),
    "pixel_format_bilinear": _converted(41, 11),
    "paused_frames": _gated,
    "frame_file_scan": _scan,
    "frame_file_seek_fast": _seek("fast"),
    "frame_file_seek_accurate": _seek("accurate"),
    "srt_files": _srt,
    "seek_epochs": _epochs,
    "seek_current": lambda s, d: K.current(_epochs(s, d)).select("video_id", "frame_index", "pts_ns", "serial"),
}

_FILES = f"""e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
px AS (SELECT vec_id // 16 AS image, (vec_id % 16)::INT AS y, x::INT AS x, least(greatest(floor((e::DOUBLE + 0.6) / 1.2 * 255), 0), 255)::INT AS v FROM e),
grid AS (SELECT i.image, gy::INT AS y, gx::INT AS x FROM (SELECT DISTINCT image FROM px) i, range({H}) a(gy), range({W}) b(gx)),
ff AS (SELECT image // {PER_VIDEO} AS video_id, image % {PER_VIDEO} AS frame_index, image % {PER_VIDEO} * {STEP_NS} AS pts_ns,
  md5(unhex(string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY y, x))) AS y_md5, md5(unhex(repeat(printf('%02X', image % 256), {W * H // 2}))) AS uv_md5
  FROM grid LEFT JOIN px USING (image, y, x) GROUP BY image)"""
_COLOURS = f"""e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
px AS (SELECT vec_id // 48 AS image, (vec_id % 48 // 16)::INT AS c, (vec_id % 16)::INT AS y, x::INT AS x, least(greatest(floor((e::DOUBLE + 0.6) / 1.2 * 255), 0), 255)::INT AS v FROM e),
grid AS (SELECT i.image, c::INT AS c, gy::INT AS y, gx::INT AS x FROM (SELECT DISTINCT image FROM px) i, range(3) t(c), range({H}) a(gy), range({W}) b(gx)),
full_px AS (SELECT image, c, y, x, coalesce(v, 0) AS v FROM grid LEFT JOIN px USING (image, c, y, x))"""


def _nv12_sql(width: int, height: int) -> str:
    def places(name: str, n: int, to: int) -> str:
        at = f"least(greatest(((2 * i + 1) * {n} * 128) // {to} - 128, 0), {(n - 1) * 256})"
        return f"{name} AS (SELECT i::INT AS t, ({at} >> 8)::INT AS a, least(({at} >> 8) + 1, {n - 1})::INT AS b, {at} & 255 AS f FROM range({to}) r(i))"

    dot = lambda w: f"least(greatest(floor({w[3]}::DOUBLE + {w[0]}::DOUBLE * r + {w[1]}::DOUBLE * g + {w[2]}::DOUBLE * b + 0.5), 0), 255)::INT"
    return f"""WITH {_COLOURS}, {places("xs", W, width)}, {places("ys", H, height)},
        wide AS (SELECT p.image, p.c, p.y, xs.t AS x, p.v * (256 - xs.f) + q.v * xs.f AS v FROM xs JOIN full_px p ON p.x = xs.a JOIN full_px q ON q.image = p.image AND q.c = p.c AND q.y = p.y AND q.x = xs.b),
        new_px AS (SELECT p.image, p.c, ys.t AS y, p.x, (p.v * (256 - ys.f) + q.v * ys.f + 32768) >> 16 AS v FROM ys JOIN wide p ON p.y = ys.a JOIN wide q ON q.image = p.image AND q.c = p.c AND q.x = p.x AND q.y = ys.b),
        rgb AS (SELECT image, y, x, max(v) FILTER (WHERE c = 0) AS r, max(v) FILTER (WHERE c = 1) AS g, max(v) FILTER (WHERE c = 2) AS b FROM new_px GROUP BY ALL),
        small AS (SELECT image, y // 2 AS y, x // 2 AS x, (sum(r) + count(*) // 2) // count(*) AS r, (sum(g) + count(*) // 2) // count(*) AS g, (sum(b) + count(*) // 2) // count(*) AS b FROM rgb GROUP BY ALL),
        ly AS (SELECT image, md5(unhex(string_agg(printf('%02X', {dot(X.TO_Y)}), '' ORDER BY y, x))) AS y_md5 FROM rgb GROUP BY image),
        lc AS (SELECT image, md5(unhex(string_agg(printf('%02X', {dot(X.TO_U)}) || printf('%02X', {dot(X.TO_V)}), '' ORDER BY y, x))) AS uv_md5 FROM small GROUP BY image)
        SELECT image, {width}::INT AS width, {height}::INT AS height, y_md5, uv_md5 FROM ly JOIN lc USING (image)"""


_GATED = f"""{FRAMES}, ctl AS (SELECT video_id, frame_index AS ord, CASE label WHEN 'error' THEN 'pause' WHEN 'purchase' THEN 'resume' ELSE 'cancel' END AS command FROM fr
  WHERE label IN ('error', 'purchase') OR (label = 'signup' AND frame_index % 41 = 40)),
was AS (SELECT fr.*, c.command FROM fr ASOF LEFT JOIN ctl c ON c.video_id = fr.video_id AND fr.frame_index >= c.ord),
nxt AS (SELECT was.*, r.ord AS resume_at FROM was ASOF LEFT JOIN (SELECT * FROM ctl WHERE command = 'resume') r ON r.video_id = was.video_id AND was.frame_index < r.ord),
ends AS (SELECT video_id, min(ord) AS cancel_at FROM ctl WHERE command = 'cancel' GROUP BY video_id)"""
_EPOCHS = f"""{FRAMES}, sk AS (SELECT video_id, frame_index AS ord, pts_ns + frame_index % 3 * 200000000 AS target_ns, frame_index % 2 = 0 AS accurate,
  row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS serial FROM fr WHERE label = 'signup'),
ep AS (SELECT fr.video_id, fr.frame_index, fr.pts_ns, coalesce(serial, 0) AS serial, target_ns, accurate, NOT coalesce(accurate AND fr.pts_ns < target_ns, false) AS shown
  FROM fr ASOF LEFT JOIN sk ON fr.video_id = sk.video_id AND fr.frame_index >= sk.ord)"""
ORACLES = {
    "run_status": f"""WITH {_GATED}, s AS (SELECT nxt.*, frame_index = max(frame_index) OVER (PARTITION BY video_id) AS at_end, CASE WHEN frame_index >= cancel_at THEN 'Idle' WHEN command = 'pause' THEN 'Paused' ELSE 'Processing' END AS status
        FROM nxt LEFT JOIN ends USING (video_id)) SELECT video_id, frame_index, CASE WHEN at_end AND status = 'Processing' THEN 'Done' ELSE status END AS status FROM s""",
    "pixel_format": _nv12_sql(W, H),
    "pixel_format_bilinear": _nv12_sql(41, 11),
    "paused_frames": f"""WITH {_GATED}, s AS (SELECT nxt.*, cancel_at, CASE WHEN frame_index >= cancel_at THEN 'cancelled' WHEN command = 'pause' THEN 'paused' ELSE 'running' END AS state FROM nxt LEFT JOIN ends USING (video_id))
        SELECT video_id, frame_index, pts_ns, state, CASE WHEN state = 'running' THEN frame_index WHEN state = 'paused' AND (cancel_at IS NULL OR resume_at < cancel_at) THEN resume_at END AS released_at FROM s""",
    "frame_file_scan": f"WITH {_FILES} SELECT * FROM ff WHERE frame_index >= 2",
    "frame_file_seek_fast": f"WITH {_FILES} SELECT * FROM ff WHERE frame_index >= floor(95000000 / {STEP_NS} + 0.5)",
    "frame_file_seek_accurate": f"WITH {_FILES} SELECT * FROM ff WHERE pts_ns >= 95000000",
    "srt_files": SEGMENTS["srt_render"],
    "seek_epochs": f"WITH {_EPOCHS} SELECT * FROM ep",
    "seek_current": f"WITH {_EPOCHS} SELECT video_id, frame_index, pts_ns, serial FROM (SELECT *, max(serial) OVER (PARTITION BY video_id) AS newest FROM ep) WHERE shown AND serial = newest",
}
