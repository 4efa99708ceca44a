"""Queries over boxes, segments, cues, text and metrics, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import metrics as M
from ..operators import recognise as R
from ..operators import sampling as S
from ..operators import segments as C
from ..operators.tracking import tracked
from ..session import table
from ..sources import frames as V
from ..sources import srt
from .frames import FRAMES, HISTORY, SCHEDULE, TAILED

WIDTH, HEIGHT = 1920, 1080
#: Features of an event frame are its value; two are the same if they differ by no more than this.
SAME = 20.0


def _boxes(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return x.select("l_orderkey", "l_linenumber", G.box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.lit(0.1)).alias("b"))


def _flat(df, column, prefix=""):
    return [G.rounded(F.col(f"{column}.{c}").cast("double"), 6).alias(prefix + c) for c in ("x", "y", "width", "height")]


def _normalise(spark, d):
    b = _boxes(spark, d)
    pixels = G.box(F.col("b.x") * 20000, F.col("b.y") * 12000, F.col("b.width") * 2000, F.col("b.height") * 1000)
    return b.withColumn("p", pixels).withColumn("r", G.normalised(F.col("p"), WIDTH, HEIGHT)).select("l_orderkey", "l_linenumber", *_flat(b, "r"))


def _pixels(spark, d):
    b = _boxes(spark, d)
    x = F.col("b")
    out = b.select("l_orderkey", "l_linenumber", G.outer_pixels(x, WIDTH, HEIGHT).alias("o"), G.outer_pixels_never_empty(x, WIDTH, HEIGHT).alias("n"), G.inner_pixels(x, WIDTH, HEIGHT).alias("i"))
    return out.select("l_orderkey", "l_linenumber", *_flat(out, "o", "outer_"), *_flat(out, "n", "never_empty_"), *_flat(out, "i", "inner_"))


def _recogniser(spark, d):
    b = _boxes(spark, d).withColumn("r", G.recogniser_region(F.col("b"), WIDTH, HEIGHT))
    return b.select("l_orderkey", "l_linenumber", *_flat(b, "r"))


def _inflate(spark, d):
    b = _boxes(spark, d)
    pixels = G.box(F.col("b.x") * 20000, F.col("b.y") * 12000, F.col("b.width") * 2000, F.col("b.height") * 1000)
    return b.withColumn("r", G.inflated(pixels, float(WIDTH), float(HEIGHT))).select("l_orderkey", "l_linenumber", *_flat(b, "r"))


def _pairs(spark, d):
    """Boxes of one order; an order has at most seven lines."""
    b = _boxes(spark, d)
    a = b.select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("b").alias("a"))
    return a.join(b.select("l_orderkey", F.col("l_linenumber").alias("line_b"), "b"), "l_orderkey").where("line_a <> line_b")


def _overlaps(spark, d, which="line_a <> line_b"):
    """Pairs of boxes of one order that overlap, with v, their overlap over their union. A box without a place overlaps nothing."""
    b = _boxes(spark, d).where("b.x is not null and b.y is not null and b.width is not null").select("l_orderkey", "l_linenumber", G.edges(F.col("b")).alias("e"))
    a = b.select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("e").alias("a"))
    p = a.join(b.select("l_orderkey", F.col("l_linenumber").alias("line_b"), F.col("e").alias("b")), "l_orderkey").where(which)
    p = p.withColumn("common", G.common_area(F.col("a"), F.col("b"))).where("common > 0")
    union = F.col("a.area") + F.col("b.area") - F.col("common")
    return p.select("l_orderkey", "line_a", "line_b", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("v"))


def _iou(spark, d):
    p = _overlaps(spark, d, "line_a < line_b").withColumn("iou", G.rounded(F.col("v"), 9))
    # A filter would go down to the join with all that its columns stand for, code too long to be compiled; an array of none or one stays here.
    return p.select("l_orderkey", "line_a", "line_b", F.explode(F.when(F.col("iou") > 0, F.array("iou"))).alias("iou"))


def _best(spark, d):
    """Whether the best overlap is enough is asked after it is found, so that the join has only to tell what overlaps."""
    p = _overlaps(spark, d).select("l_orderkey", "line_a", (-F.col("line_b")).alias("line"), G.rounded(F.col("v"), 9).alias("iou"))
    best = p.groupBy("l_orderkey", "line_a").agg(F.max(F.struct("iou", "line")).alias("m")).where("m.iou >= 0.05")
    return best.select("l_orderkey", "line_a", (-F.col("m.line")).alias("best_line"), F.col("m.iou").alias("iou"))


def _clip(spark, d):
    p = G.with_clip_remainder(_pairs(spark, d), "a", "b", "r")
    return p.select("l_orderkey", "line_a", "line_b", *_flat(p, "r"))


def _samples(spark, d):
    """Sampled event frames with their place among a video's samples."""
    s = S.with_sampled(V.event_frames(table(spark, d, "events"))).where("sampled")
    return s.withColumn("ord", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index")).cast("long"))


def _islands(spark, d):
    return C.presence_runs(_samples(spark, d), "video_id", "label", "ord")


def _timeline(spark, d):
    return S.with_sampled(V.event_frames(table(spark, d, "events")), tail=True)


#: A place for each label; the place of an error is too flat to be valid.
LABELS = ("click", "error", "purchase", "signup", "view")


def _place():
    return F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))


def _label_box():
    height = F.when(F.col("label") == "error", 0.01).otherwise(0.05)
    return [F.lit(0.1).alias("x"), (F.lit(0.05) + _place() * 0.15).alias("y"), F.lit(0.5).alias("width"), height.alias("height")]


def _lifecycles(spark, d):
    """Each sample shows one region, that of its label."""
    one = F.array(F.struct(_place().alias("region_id"), F.col("label"), *_label_box()))
    frames = _timeline(spark, d).withColumn("regions", F.when(F.col("sampled"), one))
    return L.lifecycles(frames, L.value_comparator(SAME))


def _lifecycle(spark, d):
    s = _lifecycles(spark, d)
    ok = G.valid_region(G.box(F.col("x"), F.col("y"), F.col("width"), F.col("height")), F.col("end_ns") - F.col("start_ns"), WIDTH, HEIGHT)
    return s.select("video_id", "label", "opened_frame", "start_frame", "start_ns", "last_frame", "end_frame", "end_ns", "closed_at", ok.alias("valid"))


def _refine_start(spark, d):
    return _lifecycles(spark, d).select("video_id", "label", F.col("opened_frame").alias("frame_index"), "start_frame", "start_ns")


def _refine_end(spark, d):
    return _lifecycles(spark, d).select("video_id", "label", "last_frame", F.col("end_frame").alias("refined_frame"), F.col("end_ns").alias("refined_ns"))


def _valid(spark, d):
    return L.valid(_lifecycles(spark, d), WIDTH, HEIGHT).select("video_id", "label", "start_frame", "end_frame", "start_ns", "end_ns")


def _found_texts(spark, d):
    """The whole way: sampled, detected, tracked, segmented, refined, recognised. A detection is the box of a frame's
    label; the recogniser reads the label of the frame that represents a segment, and cannot read views."""
    frames = _timeline(spark, d)
    found = frames.where("sampled").select("video_id", "frame_index", F.lit(0).alias("ord"), *_label_box())
    segments = L.valid(L.lifecycles(L.with_regions(frames, tracked(found)), L.value_comparator(SAME)), WIDTH, HEIGHT)
    shown = L.presented(segments, frames.select("video_id", "frame_index", F.col("label").alias("content")), WIDTH, HEIGHT)
    words = table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_type").alias("content"), F.upper("event_type").alias("text")).distinct()
    texts = R.with_lookup(shown, words, "content")
    return texts.withColumn("text", T.normalised_text(T.joined_texts(F.transform("texts", lambda t: t["text"]))))


def _found_cues(spark, d):
    """In the order in which segments end; those without text are left out."""
    order = Window.partitionBy("video_id").orderBy("place")
    return _found_texts(spark, d).where("text <> ''").withColumn("ord", F.row_number().over(order).cast("long"))


def _ocr_stats(spark, d):
    t = _found_texts(spark, d)
    return t.groupBy("video_id").agg(F.count(F.lit(1)).alias("ocr_calls"), F.count_if(F.col("text") == "").alias("ocr_empty"))


def _cues(spark, d):
    """Runs of presence of three neighbouring users, 200 ms long at least, as cues of one video in order of their ends."""
    s = _islands(spark, d).where(F.col("end_ns") - F.col("start_ns") >= 200_000_000).withColumn("track", F.col("video_id")).withColumn("video_id", F.expr("track div 3"))
    texts = R.with_lookup(s, table(spark, d, "events").select(F.col("event_type").alias("label"), F.upper("event_type").alias("text")).distinct(), "label")
    text = T.normalised_text(T.joined_texts(F.transform("texts", lambda t: t["text"])))
    cues = texts.withColumn("text", text).where("text <> ''").withColumn("center", (F.col("track") % 5 * 10).cast("double"))
    order = Window.partitionBy("video_id").orderBy("end_ns", "start_ns", "track", "label")
    return cues.withColumn("ord", F.row_number().over(order).cast("long"))


def _shown(df):
    return df.withColumn("texts", F.array_join(F.transform("lines", lambda x: x["text"]), "|"))


def _merged(spark, d):
    return C.merged_cues(_cues(spark, d))


def _stats(spark, d):
    log = C.merged_cues(_cues(spark, d), changelog=True)
    return log.groupBy("video_id").agg(F.count_if(F.col("kind") == "new").alias("cues"), F.count_if(F.col("kind") == "updated").alias("merged"))


def _normalise_text(spark, d):
    rows = table(spark, d, "conversations").withColumn("spaced", F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\t\n\n ")))
    return rows.select("conv_id", "turn", T.normalised_text(F.col("spaced")).alias("text"))


def _ordered_lines(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    lines = F.transform("t", lambda x: F.struct((x["turn"] * 7 % 5).cast("double").alias("center"), F.concat(F.lit(" "), x["role"]).alias("text")))
    return rows.select("conv_id", lines.alias("lines")).select("conv_id", F.array_join(T.ordered_lines(F.col("lines")), "|").alias("lines"))


def _lookup(spark, d):
    s = R.with_lookup(_islands(spark, d), table(spark, d, "events").select(F.col("event_type").alias("label"), F.upper("event_type").alias("text")).distinct(), "label")
    return s.select("video_id", "label", "start_frame", F.get("texts", F.lit(0))["text"].alias("text"))


def _times(spark, d):
    f = V.event_frames(table(spark, d, "events"))
    ns = F.col("pts_ns") * 37 + 999_999
    return f.select("video_id", "frame_index", T.srt_time(ns).alias("srt_time"), T.display_time(ns / 1e6).alias("display_time"))


def _upsert(spark, d):
    return _shown(C.latest_versions(C.merged_cues(_cues(spark, d), changelog=True), ["video_id", "id"])).select("video_id", "id", "kind", "ord", "start_ns", "end_ns", "texts")


def _progress(spark, d):
    frames = V.event_frames(table(spark, d, "events"))
    p = M.progress(S.with_sampled(frames).where("sampled").select("video_id", "frame_index"), V.metadata(frames))
    return p.withColumn("progress", F.round("progress", 9))


def _published(spark, d):
    p = _progress(spark, d).withColumn("completed", F.lit(False))
    return M.published(p, 0.05)


def _work(spark, d):
    one = F.array(F.struct(_place().alias("region_id"), F.col("label"), *_label_box()))
    frames = _timeline(spark, d).withColumn("regions", F.when(F.col("sampled"), one))
    return L.work(frames, L.value_comparator(SAME))


def _running(spark, d):
    s = _samples(spark, d).select("video_id", "frame_index", F.col("value").alias("det_ms"))
    return M.detection_average(s).withColumn("det_ms", F.round("det_ms", 4))


def _end_to_end(spark, d):
    rows = srt.numbered(C.merged_cues(_found_cues(spark, d))).where("block is not null")
    return _shown(rows).select("video_id", "number", "start_ns", "end_ns", "start_frame", "texts", "block")


QUERIES = {
    "roi_normalise": _normalise,
    "roi_to_pixels": _pixels,
    "roi_to_ocr": _recogniser,
    "inflate_clip": _inflate,
    "iou_pairs": _iou,
    "iou_best_match": _best,
    "clip_remainder": _clip,
    "segment_islands": lambda s, d: _islands(s, d),
    "lifecycle": _lifecycle,
    "refine_start": _refine_start,
    "refine_end": _refine_end,
    "valid_segments": lambda s, d: _valid(s, d),
    "normalise_text": _normalise_text,
    "ordered_lines": _ordered_lines,
    "ocr_lookup": _lookup,
    "merge_overlap": lambda s, d: C.overlap_islands(_cues(s, d)).drop("island"),
    "merge_full": lambda s, d: _shown(_merged(s, d)).drop("lines"),
    "merge_changelog": lambda s, d: _shown(C.merged_cues(_cues(s, d), changelog=True)).drop("lines"),
    "merge_stats": _stats,
    "ocr_stats": _ocr_stats,
    "srt_render": lambda s, d: srt.rendered(_merged(s, d)),
    "timestamp_format": _times,
    "upsert_latest": _upsert,
    "progress_counters": _progress,
    "published_progress": _published,
    "lifecycle_work": _work,
    "running_metrics": _running,
    "subtitles_end_to_end": _end_to_end,
}

BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_discount AS x, l_tax AS y, l_quantity / 100 AS w, 0.1::DOUBLE AS h FROM lineitem)"
PIXELS = BOXES + ", p AS (SELECT l_orderkey, l_linenumber, x * 20000 AS x, y * 12000 AS y, w * 2000 AS w, h * 1000 AS h FROM b)"
PAIRS = BOXES + """, o AS (SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
  greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x + a.w, b.x + b.w) AS x1, least(a.y + a.h, b.y + b.h) AS y1
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber),
q AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END AS common FROM o),
i AS (SELECT *, round(CASE WHEN aw * ah + bw * bh - common > 0 THEN common / (aw * ah + bw * bh - common) ELSE 0 END, 9) AS iou FROM q)"""
ISLANDS = f"""{FRAMES}, {SCHEDULE}, smp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS n_sample FROM sampled WHERE sampled),
isl AS (SELECT *, n_sample - row_number() OVER (PARTITION BY video_id, label ORDER BY n_sample) AS island FROM smp),
seg AS (SELECT video_id, label, min(frame_index) AS start_frame, max(frame_index) AS end_frame, min(pts_ns) AS start_ns, max(pts_ns) AS end_ns, count(*) AS n FROM isl GROUP BY video_id, label, island)"""
CUES = ISLANDS + """, cues AS (SELECT video_id // 3 AS video_id, row_number() OVER (PARTITION BY video_id // 3 ORDER BY end_ns, start_ns, video_id, label) AS ord,
  start_ns, end_ns, start_frame, (video_id % 5 * 10)::DOUBLE AS center, upper(label) AS text FROM seg WHERE end_ns - start_ns >= 200000000)"""
LIFE = ISLANDS.replace(SCHEDULE, TAILED) + f""", {HISTORY}, hv AS (SELECT hist.*, fr.value FROM hist JOIN fr ON fr.video_id = hist.video_id AND fr.frame_index = hist.frame_index),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, label, island ORDER BY n_sample) AS k, count(*) OVER (PARTITION BY video_id, label, island) AS n FROM isl),
back AS (SELECT s.video_id, s.label, s.island, p.frame_index AS past_index, p.pts_ns AS past_ns, p.value AS past_value, abs(p.value - s.value) <= 20 AS first_same
  FROM rk s JOIN hv a ON a.video_id = s.video_id AND a.frame_index = s.frame_index JOIN hv p ON p.video_id = a.video_id AND p.ord < a.ord AND p.ord > a.ord - a.length WHERE s.k = 1),
near AS (SELECT video_id, label, island, max(past_index) AS near, arg_max(past_value, past_index) AS near_value FROM back WHERE first_same GROUP BY ALL),
opens AS (SELECT video_id, label, island, min(past_index) AS start_frame, arg_min(past_ns, past_index) AS start_ns, any_value(near_value) AS near_value
  FROM back JOIN near USING (video_id, label, island) WHERE past_index = near OR (past_index < near AND abs(past_value - near_value) <= 20) GROUP BY ALL),
held AS (SELECT s.video_id, s.label, s.island, s.k, s.n, coalesce(near_value, s.value) AS ref, s.frame_index AS opened_frame, coalesce(start_frame, s.frame_index) AS start_frame,
    coalesce(start_ns, s.pts_ns) AS start_ns, s.frame_index AS last_frame, s.pts_ns AS last_ns, s.frame_index AS sample FROM rk s LEFT JOIN opens USING (video_id, label, island) WHERE s.k = 1
  UNION ALL SELECT h.video_id, h.label, h.island, s.k, h.n, CASE WHEN abs(s.value - ref) <= 20 THEN s.value ELSE ref END, opened_frame, start_frame, start_ns,
    CASE WHEN abs(s.value - ref) <= 20 THEN s.frame_index ELSE last_frame END, CASE WHEN abs(s.value - ref) <= 20 THEN s.pts_ns ELSE last_ns END, s.frame_index
  FROM held h JOIN rk s ON s.video_id = h.video_id AND s.label = h.label AND s.island = h.island AND s.k = h.k + 1),
nx AS (SELECT video_id, frame_index, coalesce(lead(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index), frame_index) AS closed_at FROM smp),
shut AS (SELECT h.*, closed_at FROM held h JOIN nx ON nx.video_id = h.video_id AND nx.frame_index = h.sample WHERE k = n),
ahead AS (SELECT s.video_id, s.label, s.island, p.frame_index AS fi, p.pts_ns AS ns, p.value AS v, row_number() OVER (PARTITION BY s.video_id, s.label, s.island ORDER BY p.frame_index) AS j
  FROM shut s JOIN hv a ON a.video_id = s.video_id AND a.frame_index = s.closed_at JOIN hv p ON p.video_id = a.video_id AND p.ord <= a.ord AND p.ord > a.ord - a.length AND p.frame_index > s.last_frame),
ends AS (SELECT video_id, label, island, 0::BIGINT AS j, ref, last_frame AS end_frame, last_ns AS end_ns FROM shut
  UNION ALL SELECT e.video_id, e.label, e.island, a.j, CASE WHEN abs(a.v - ref) <= 20 THEN a.v ELSE ref END, CASE WHEN abs(a.v - ref) <= 20 THEN a.fi ELSE end_frame END, CASE WHEN abs(a.v - ref) <= 20 THEN a.ns ELSE end_ns END
  FROM ends e JOIN ahead a ON a.video_id = e.video_id AND a.label = e.label AND a.island = e.island AND a.j = e.j + 1),
life AS (SELECT s.video_id, s.label, opened_frame, start_frame, start_ns, last_frame, e.end_frame, e.end_ns, closed_at, e.end_ns - start_ns >= 200000000 AND s.label <> 'error' AS valid
  FROM shut s JOIN (SELECT * FROM ends QUALIFY j = max(j) OVER (PARTITION BY video_id, label, island)) e USING (video_id, label, island)),
read AS (SELECT life.*, (list_position({list(LABELS)}, life.label) * 0.15 + 0.05 + 0.025) * 1080 AS center, CASE WHEN fr.label <> 'view' THEN upper(fr.label) ELSE '' END AS text
  FROM life JOIN fr ON fr.video_id = life.video_id AND fr.frame_index = life.end_frame WHERE valid)"""
FOUND = LIFE + """, cues AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY closed_at, opened_frame) AS ord, start_ns, end_ns, start_frame, center, text FROM read WHERE text <> '')"""
_LOG = """, log AS (
  SELECT video_id, ord, 'new' AS kind, 0::BIGINT AS id, start_ns, end_ns, start_frame, [{'center': center, 'text': text}] AS lines FROM cues WHERE ord = 1
  UNION ALL
  SELECT video_id, next_ord, CASE WHEN joins THEN 'updated' ELSE 'new' END, CASE WHEN joins THEN id ELSE id + 1 END,
    CASE WHEN joins THEN least(start_ns, s) ELSE s END, CASE WHEN joins THEN greatest(end_ns, e) ELSE e END, CASE WHEN joins THEN least(start_frame, f) ELSE f END,
    CASE WHEN NOT joins THEN [{'center': c, 'text': t}] WHEN known THEN lines ELSE list_append(lines, {'center': c, 'text': t}) END
  FROM (SELECT l.*, q.ord AS next_ord, q.start_ns AS s, q.end_ns AS e, q.start_frame AS f, q.center AS c, q.text AS t,
      list_contains(list_transform(lines, lambda x: x.text), q.text) AS known,
      q.start_ns <= l.end_ns OR (q.start_ns - l.end_ns <= 120000000 AND list_contains(list_transform(lines, lambda x: x.text), q.text)) AS joins
    FROM log l JOIN cues q ON q.video_id = l.video_id AND q.ord = l.ord + 1)),
sub AS (SELECT * FROM log QUALIFY ord = max(ord) OVER (PARTITION BY video_id, id))"""
MERGED = CUES + _LOG
TEXTS = "array_to_string(list_transform(lines, lambda x: x.text), '|') AS texts"
SRT_TIME = "format('{:02d}:{:02d}:{:02d},{:03d}', X // 3600000000000, X // 60000000000 % 60, X // 1000000000 % 60, X // 1000000 % 1000)"
_BLOCKS = f""", exploded AS (SELECT video_id, id, unnest(lines) AS l, generate_subscripts(lines, 1) AS nth FROM sub),
ordered AS (SELECT video_id, id, l.text AS t, row_number() OVER w AS place, lag(l.text) OVER w AS was FROM exploded WINDOW w AS (PARTITION BY video_id, id ORDER BY l.center, nth)),
shown AS (SELECT video_id, id, string_agg(t, chr(10) ORDER BY place) FILTER (WHERE was IS NULL OR was <> t) AS body FROM ordered GROUP BY ALL),
num AS (SELECT sub.*, row_number() OVER (PARTITION BY sub.video_id ORDER BY start_ns, start_frame, sub.id) AS number, body FROM sub JOIN shown ON shown.video_id = sub.video_id AND shown.id = sub.id),
blk AS (SELECT *, CASE WHEN number > 1 THEN chr(10) ELSE '' END || number || chr(10) || {SRT_TIME.replace('X', 'start_ns')} || ' --> ' || {SRT_TIME.replace('X', 'end_ns')} || chr(10) || body || chr(10) AS block FROM num)"""
RENDER, FOUND_RENDER = MERGED + _BLOCKS, FOUND + _LOG + _BLOCKS
_box = lambda x0, y0, x1, y1, p="": f"round({x0}, 6) AS {p}x, round({y0}, 6) AS {p}y, round({x1} - {x0}, 6) AS {p}width, round({y1} - {y0}, 6) AS {p}height"

ORACLES = {
    "roi_normalise": f"""WITH {PIXELS}, e AS (SELECT *, least(greatest(x / 1920, 0), 1) AS x0, least(greatest(y / 1080, 0), 1) AS y0 FROM p),
        g AS (SELECT *, least(greatest((x + w) / 1920, x0), 1) AS x1, least(greatest((y + h) / 1080, y0), 1) AS y1 FROM e) SELECT l_orderkey, l_linenumber, {_box("x0", "y0", "x1", "y1")} FROM g""",
    "roi_to_pixels": f"""WITH {BOXES}, e AS (SELECT *, greatest(least(floor(x * 1920), 1920), 0) AS x0, greatest(least(floor(y * 1080), 1080), 0) AS y0, least(x, 1) AS cx, least(y, 1) AS cy, least(x + w, 1) AS dx, least(y + h, 1) AS dy FROM b),
        g AS (SELECT *, greatest(least(ceil((x + w) * 1920), 1920), x0) AS x1, greatest(least(ceil((y + h) * 1080), 1080), y0) AS y1,
          least(floor(cx * 1920), 1919) AS nx0, least(floor(cy * 1080), 1079) AS ny0, ceil(cx * 1920) AS ix0, ceil(cy * 1080) AS iy0, floor(greatest(dx, cx) * 1920) AS ix1, floor(greatest(dy, cy) * 1080) AS iy1 FROM e),
        k AS (SELECT *, least(greatest(ceil(dx * 1920), nx0 + 1), 1920) AS nx1, least(greatest(ceil(dy * 1080), ny0 + 1), 1080) AS ny1, x1 > x0 AND y1 > y0 AS o, ix1 > ix0 AND iy1 > iy0 AS i FROM g)
        SELECT l_orderkey, l_linenumber, CASE WHEN o THEN x0 END AS outer_x, CASE WHEN o THEN y0 END AS outer_y, CASE WHEN o THEN x1 - x0 END AS outer_width, CASE WHEN o THEN y1 - y0 END AS outer_height,
        nx0 AS never_empty_x, ny0 AS never_empty_y, nx1 - nx0 AS never_empty_width, ny1 - ny0 AS never_empty_height,
        CASE WHEN i THEN ix0 END AS inner_x, CASE WHEN i THEN iy0 END AS inner_y, CASE WHEN i THEN ix1 - ix0 END AS inner_width, CASE WHEN i THEN iy1 - iy0 END AS inner_height FROM k""",
    "roi_to_ocr": f"""WITH {BOXES}, e AS (SELECT *, least(greatest(x * 1920, 0), 1920) AS x0, least(greatest(y * 1080, 0), 1080) AS y0 FROM b),
        g AS (SELECT *, least(greatest((x + w) * 1920, x0), 1920) AS rx, least(greatest((y + h) * 1080, y0), 1080) AS ry FROM e),
        k AS (SELECT *, CASE WHEN rx >= 1920 THEN greatest(1920 - 0.001::DOUBLE, x0) ELSE rx END AS x1, CASE WHEN ry >= 1080 THEN greatest(1080 - 0.001::DOUBLE, y0) ELSE ry END AS y1 FROM g)
        SELECT l_orderkey, l_linenumber, round(x0, 6) AS x, round(y0, 6) AS y, round(greatest(x1 - x0, 1), 6) AS width, round(greatest(y1 - y0, 1), 6) AS height FROM k""",
    "inflate_clip": f"""WITH {PIXELS}, e AS (SELECT *, greatest(x - 5, 0) AS x0, greatest(y - 5, 0) AS y0, least(x + w + 5, 1920) AS x1, least(y + h + 5, 1080) AS y1 FROM p)
        SELECT l_orderkey, l_linenumber, round(x0, 6) AS x, round(y0, 6) AS y, round(greatest(x1 - x0, 0), 6) AS width, round(greatest(y1 - y0, 0), 6) AS height FROM e""",
    "iou_pairs": f"WITH {PAIRS} SELECT l_orderkey, line_a, line_b, iou FROM i WHERE line_a < line_b AND iou > 0",
    "iou_best_match": f"WITH {PAIRS} SELECT l_orderkey, line_a, line_b AS best_line, iou FROM i WHERE iou >= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey, line_a ORDER BY iou DESC, line_b) = 1",
    "clip_remainder": f"""WITH {PAIRS}, s AS (SELECT *, x0 + (x1 - x0) AS xr, y0 + (y1 - y0) AS yr, row_number() OVER () AS rid FROM i WHERE x1 > x0 AND y1 > y0),
        u AS (SELECT l_orderkey, line_a, line_b, rid, unnest([1, 2, 3, 4]) AS n, unnest([ax, ax, ax, least(xr, ax + aw)]) AS x, unnest([ay, least(yr, ay + ah), ay, ay]) AS y,
          unnest([aw, aw, greatest(x0 - ax, 0), greatest(ax + aw - xr, 0)]) AS w, unnest([greatest(y0 - ay, 0), greatest(ay + ah - yr, 0), ah, ah]) AS h FROM s)
        SELECT l_orderkey, line_a, line_b, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height FROM u WHERE w > 0 AND h > 0
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY w * h DESC, n DESC) = 1""",
    "segment_islands": f"WITH {ISLANDS} SELECT * FROM seg",
    "valid_segments": f"WITH RECURSIVE {LIFE} SELECT video_id, label, start_frame, end_frame, start_ns, end_ns FROM life WHERE valid",
    "lifecycle": f"WITH RECURSIVE {LIFE} SELECT * FROM life",
    "refine_start": f"WITH RECURSIVE {LIFE} SELECT video_id, label, opened_frame AS frame_index, start_frame, start_ns FROM life",
    "refine_end": f"WITH RECURSIVE {LIFE} SELECT video_id, label, last_frame, end_frame AS refined_frame, end_ns AS refined_ns FROM life",
    "ocr_stats": f"WITH RECURSIVE {LIFE} SELECT video_id, count(*) AS ocr_calls, count(*) FILTER (WHERE text = '') AS ocr_empty FROM read GROUP BY video_id",
    "normalise_text": r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(replace(text, ' ', '  '), chr(10), chr(9) || chr(10) || chr(10) || ' '), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM conversations""",
    "ordered_lines": """WITH o AS (SELECT conv_id, role, row_number() OVER w AS place, lag(role) OVER w AS was FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn * 7 % 5, turn, role))
        SELECT conv_id, string_agg(role, '|' ORDER BY place) FILTER (WHERE was IS NULL OR was <> role) AS lines FROM o GROUP BY conv_id""",
    "ocr_lookup": f"WITH {ISLANDS} SELECT video_id, label, start_frame, upper(label) AS text FROM seg",
    "merge_overlap": f"""WITH {CUES}, r AS (SELECT *, CASE WHEN start_ns <= max(end_ns) OVER (PARTITION BY video_id ORDER BY start_ns, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cues),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_ns, ord ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT video_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_cues FROM g GROUP BY video_id, island""",
    "merge_full": f"WITH RECURSIVE {MERGED} SELECT video_id, id, start_ns, end_ns, start_frame, {TEXTS} FROM sub",
    "merge_changelog": f"WITH RECURSIVE {MERGED} SELECT video_id, ord, kind, id, start_ns, end_ns, start_frame, {TEXTS} FROM log",
    "merge_stats": f"WITH RECURSIVE {MERGED} SELECT video_id, count(*) FILTER (WHERE kind = 'new') AS cues, count(*) FILTER (WHERE kind = 'updated') AS merged FROM log GROUP BY video_id",
    "srt_render": f"WITH RECURSIVE {RENDER} SELECT video_id, string_agg(block, '' ORDER BY number) AS srt FROM blk GROUP BY video_id",
    "timestamp_format": f"""WITH {FRAMES}, t AS (SELECT video_id, frame_index, pts_ns * 37 + 999999 AS n, floor((pts_ns * 37 + 999999) / 1e6 + 0.5)::BIGINT AS m FROM fr)
        SELECT video_id, frame_index, {SRT_TIME.replace('X', 'n')} AS srt_time, CASE WHEN m >= 3600000 THEN format('{{:d}}:{{:02d}}:{{:02d}}.{{:03d}}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) ELSE format('{{:d}}:{{:02d}}.{{:03d}}', m // 60000 % 60, m // 1000 % 60, m % 1000) END AS display_time FROM t""",
    "upsert_latest": f"WITH RECURSIVE {MERGED} SELECT video_id, id, kind, ord, start_ns, end_ns, {TEXTS} FROM sub",
    "progress_counters": f"""WITH {FRAMES}, {SCHEDULE}, m AS (SELECT video_id, count(*) AS total FROM fr GROUP BY video_id)
        SELECT s.video_id, frame_index, least(frame_index + 1, total) AS samples_seen, round(frame_index / total, 9) AS progress FROM sampled s JOIN m ON m.video_id = s.video_id WHERE sampled""",
    "published_progress": f"""WITH RECURSIVE {FRAMES}, {SCHEDULE}, m AS (SELECT video_id, count(*) AS total FROM fr GROUP BY video_id),
        p AS (SELECT s.video_id, frame_index, round(frame_index / total, 9) AS progress, row_number() OVER (PARTITION BY s.video_id ORDER BY frame_index) AS k FROM sampled s JOIN m ON m.video_id = s.video_id WHERE sampled),
        r AS (SELECT video_id, k, frame_index, progress, abs(progress) >= 0.05 AS told, CASE WHEN abs(progress) >= 0.05 THEN progress ELSE 0 END AS last FROM p WHERE k = 1
          UNION ALL SELECT p.video_id, p.k, p.frame_index, p.progress, abs(p.progress - last) >= 0.05, CASE WHEN abs(p.progress - last) >= 0.05 THEN p.progress ELSE last END FROM r JOIN p ON p.video_id = r.video_id AND p.k = r.k + 1)
        SELECT video_id, frame_index, progress FROM r WHERE told""",
    "lifecycle_work": f"""WITH RECURSIVE {LIFE}, b AS (SELECT video_id, count(*) AS n FROM back GROUP BY video_id), a AS (SELECT video_id, count(*) AS n FROM ahead GROUP BY video_id),
        s AS (SELECT video_id, count(*) AS samples, count(*) FILTER (WHERE k > 1) AS later FROM rk GROUP BY video_id)
        SELECT s.video_id, samples + coalesce(b.n, 0) + coalesce(a.n, 0) AS extracts, later + coalesce(b.n, 0) + coalesce(a.n, 0) AS compares FROM s LEFT JOIN b USING (video_id) LEFT JOIN a USING (video_id)""",
    "running_metrics": f"""WITH {FRAMES}, {SCHEDULE}, l AS (SELECT video_id, frame_index, list(value) OVER (PARTITION BY video_id ORDER BY frame_index) AS vs FROM sampled WHERE sampled)
        SELECT video_id, frame_index, round(list_reduce(vs, lambda a, b: 0.9 * a + 0.1 * b), 4) AS det_ms FROM l""",
    "subtitles_end_to_end": f"WITH RECURSIVE {FOUND_RENDER} SELECT video_id, number, start_ns, end_ns, start_frame, {TEXTS}, block FROM blk",
}
