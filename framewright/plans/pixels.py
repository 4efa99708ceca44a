"""Queries over pixels, detectors, comparators and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bitmasks as B
from ..operators import detect as D
from ..operators import pixels as P
from ..operators.tracking import tracked
from ..session import table
from ..sources import frames as V

W, H = 64, 16


def _pixels(spark, d):
    return V.pixel_rows(table(spark, d, "embeddings").select("vec_id", "embedding"), H)


def _mask(spark, d, target=170, delta=20):
    return P.luma_band(_pixels(spark, d), target, delta)


def _bridged(spark, d):
    return P.bridged(_mask(spark, d), 3)


def _narrow(spark, d):
    return P.luma_band(_pixels(spark, d), 190, 12)


def _bands(spark, d):
    return P.band_runs(P.row_density(_narrow(spark, d), W, H), cap=0.03, min_height=2)


def _segments(spark, d):
    return P.column_segments(_narrow(spark, d), _bands(spark, d), min_gap=2, ratio=0.05)


def _candidates(spark, d):
    return P.candidates(_segments(spark, d), min_area=6, min_fill=0.2, min_width=3)


def _shown(df, *names):
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


def _integral(spark, d):
    m = _pixels(spark, d).withColumn("m", F.col("v").between(150, 190).cast("long"))
    return P.integral(m).select("image", "y", "x", "total")


def _eval(spark, d):
    m = _pixels(spark, d).withColumn("m", F.col("v").between(150, 190).cast("long"))
    s = P.region_score(m, 4, 2, 25, 9)
    return s.select("image", *[F.round(c, 9).alias(c) for c in ("fill", "vmr", "score")])


def _boxes(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.round(F.col("l_discount") * 2000).cast("int").alias("x"), F.round(F.col("l_tax") * 1000).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("width"), F.lit(20).alias("height"))
    return x


def _groups(spark, d):
    return P.line_groups(_boxes(spark, d), "l_orderkey")


def _lines(spark, d, per_image=H):
    return V.pixel_lines(table(spark, d, "embeddings").select("vec_id", "embedding"), per_image)


def _cover(spark, d):
    """Neighbouring images that both have a set pixel."""
    lines = _lines(spark, d).select("image", "y", F.lit(0).alias("x0"), B.band_words(F.col("line"), W, 150, 190).alias("part"))
    masks = B.images(lines, W, H).where(F.exists("bits", lambda line: F.exists(line, lambda w: w != 0)))
    return B.cover_of_neighbours(masks, W).withColumn("similarity", F.round("similarity", 6))


def _packed_cover(spark, d):
    """Images of twice the width, two vectors a line, so that dilation passes from word to word; all neighbours, with or without a set pixel."""
    rows = _lines(spark, d, 2 * H)
    lines = rows.select("image", F.expr("y div 2").alias("y"), (F.col("y") % 2 * W).alias("x0"), B.band_words(F.col("line"), W, 150, 190).alias("part"))
    return B.cover_of_neighbours(B.images(lines, 2 * W, H), 2 * W).withColumn("similarity", F.round("similarity", 6))


def _planes(spark, d):
    """Lines and pixels that are missing are 0."""
    byte = lambda v: F.lpad(F.hex(F.coalesce(v, F.lit(0)).cast("long")), 2, "0")
    lines = _lines(spark, d).select("image", "y", F.rpad(F.array_join(F.transform(F.slice("line", 1, W), byte), ""), 2 * W, "0").alias("line"))
    rows = lines.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(H - 1)), lambda y: F.coalesce(F.element_at("lines", y), F.lit("00" * W))), "")
    return rows.select("image", F.unhex(text).alias("plane"), F.lit(W).alias("width"), F.lit(H).alias("height"))


def _plane_pairs(spark, d):
    p = _planes(spark, d)
    a = p.select(F.col("image").alias("a"), F.col("plane").alias("a_plane"), "width", "height")
    return a.join(p.select((F.col("image") - 1).alias("a"), F.col("image").alias("b"), F.col("plane").alias("b_plane")), "a").select("a", "b", "a_plane", "b_plane", "width", "height")


def _consecutive(spark, d):
    return D.compared(_plane_pairs(spark, d), "bitset-cover", 170, 20).withColumn("similarity", F.round("similarity", 4))


def _track(spark, d):
    """An order is a frame and its lines are detections, in one order even where lines share a number."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_discount", "l_tax", "l_quantity"))
    x = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 64").alias("video_id"), (F.col("l_orderkey") % 64).alias("frame_index"), place.alias("ord"),
        F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 100).alias("width"), F.lit(0.1).alias("height"),
    )
    return tracked(x)


def _stacked(spark, d):
    """Every vector of the table as pixels: two vectors a row, each number four pixels wide, 128 rows a frame. Of three
    bands of 32 rows the first is bright where a number isn't low. What the last frame lacks is dark."""
    lit = (F.expr("vec_id div 2 % 128 div 32 % 3") == 0) & (F.col("e") > -0.05)
    numbers = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    spots = numbers.where(lit & (F.col("x") < 64)).select(F.expr("vec_id div 256").alias("frame_index"), F.expr("vec_id div 2 % 128 * 128 + vec_id % 2 * 64 + x").cast("int").alias("at"))
    rows = spots.groupBy("frame_index").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return D.spotted(rows, 128, 128, 4)


def _detect(kind):
    return lambda s, d: D.detected(_stacked(s, d), kind)


QUERIES = {
    "luma_band": lambda s, d: _mask(s, d),
    "luma_band_comparator": lambda s, d: P.luma_band(_pixels(s, d), 128, 0, least_delta=1),
    "gap_bridge_h": lambda s, d: _bridged(s, d),
    "gap_bridge_v": lambda s, d: P.bridged(_bridged(s, d), 2, "y"),
    "row_density": lambda s, d: P.row_density(_mask(s, d), W, H).withColumn("ones", F.col("ones").cast("long")),
    "band_runs": lambda s, d: _shown(_bands(s, d), "image", "y0", "y1"),
    "column_segments": lambda s, d: _shown(_segments(s, d), "image", "y0", "y1", "x0", "x1", "ones"),
    "candidate_filter": lambda s, d: _candidates(s, d).select("image", "y0", "x0", F.round("fill", 9).alias("fill"), "mass"),
    "topk_candidates": lambda s, d: P.top_candidates(_candidates(s, d), 2).select("image", "y0", "x0", "mass", "place"),
    "run_length": lambda s, d: _shown(P.runs(_mask(s, d)), "image", "y", "x0", "x1"),
    "connected_components": lambda s, d: P.connected(P.runs(_mask(s, d))),
    "integral_image": _integral,
    "integral_eval": _eval,
    "line_grouping": lambda s, d: _groups(s, d).select("l_orderkey", "ord", "line"),
    "line_merge": lambda s, d: _shown(P.merged_lines(_groups(s, d), "l_orderkey"), "l_orderkey", "line", "x", "y", "width", "height", "n"),
    "detect_projection": _detect("projection-band"),
    "detect_integral": _detect("integral-band"),
    "bitset_dilate": lambda s, d: P.dilated(_mask(s, d), 2, W, H),
    "bitset_compare": _cover,
    "packed_cover": _packed_cover,
    "consecutive_compare": _consecutive,
    "chamfer_extract": lambda s, d: D.chamfer_points(_planes(s, d), 170, 20),
    "chamfer_compare": lambda s, d: D.compared(_plane_pairs(s, d), "sparse-chamfer", 170, 20),
    "track_regions": _track,
}

PIXELS = """e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
px AS (SELECT vec_id // 16 AS image, (vec_id % 16)::INT AS y, x::INT AS x, least(greatest(floor((e::DOUBLE + 0.6) / 1.2 * 255), 0), 255)::INT AS v FROM e)"""
MASK = PIXELS + ", m AS (SELECT image, y, x FROM px WHERE v BETWEEN 150 AND 190)"
BRIDGED = MASK + """, l AS (SELECT *, lag(x) OVER (PARTITION BY image, y ORDER BY x) AS was FROM m),
h AS (SELECT image, y, unnest(CASE WHEN x - was - 1 <= 3 THEN range(was + 1, x + 1) ELSE range(x, x + 1) END)::INT AS x FROM l)"""
DENSITY = "rows AS (SELECT image, y FROM (SELECT DISTINCT image FROM M), range(16) t(y)), d AS (SELECT r.image, r.y::INT AS y, count(M.x) AS ones, count(M.x) / 64.0 AS density FROM rows r LEFT JOIN M ON M.image = r.image AND M.y = r.y GROUP BY r.image, r.y)"
SEGMENTS = (
    PIXELS
    + ", nm AS (SELECT image, y, x FROM px WHERE v BETWEEN 178 AND 202), "
    + DENSITY.replace("M.", "nm.").replace("FROM M)", "FROM nm)").replace("JOIN M ON", "JOIN nm ON")
    + """, bar AS (SELECT *, greatest(least(0.03, avg(density) OVER (PARTITION BY image) * 0.7), 0.02) AS bar FROM d),
run AS (SELECT *, y - row_number() OVER (PARTITION BY image ORDER BY y) AS run FROM bar WHERE density >= bar),
band AS (SELECT image, min(y) AS y0, max(y) + 1 AS y1 FROM run GROUP BY image, run HAVING max(y) + 1 - min(y) >= 2),
col AS (SELECT nm.image, y0, y1, x, count(*) AS ones FROM nm JOIN band b ON b.image = nm.image AND y >= y0 AND y < y1 GROUP BY ALL),
gap AS (SELECT *, x - lag(x) OVER (PARTITION BY image, y0 ORDER BY x) - 1 AS gap, greatest(2, ceil((max(x) OVER (PARTITION BY image, y0) - min(x) OVER (PARTITION BY image, y0) + 1) * 0.05::DOUBLE)) AS split FROM col),
sg AS (SELECT *, sum(CASE WHEN gap = 0 OR gap < split THEN 0 ELSE 1 END) OVER (PARTITION BY image, y0 ORDER BY x) AS s FROM gap),
seg AS (SELECT image, y0, y1, min(x) AS x0, max(x) + 1 AS x1, sum(ones)::BIGINT AS ones FROM sg GROUP BY image, y0, y1, s),
cand AS (SELECT *, ones / ((x1 - x0) * (y1 - y0)) AS fill FROM seg WHERE (x1 - x0) * (y1 - y0) >= 6 AND ones / ((x1 - x0) * (y1 - y0)) >= 0.2 AND x1 - x0 >= 3)"""
)
RUNS = MASK + """, i AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM m),
r AS (SELECT image, y, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY image, y, g)"""
LINES = """bx AS (SELECT l_orderkey, l_linenumber AS ord, round(l_discount * 2000)::INT AS x, round(l_tax * 1000)::INT AS y, l_quantity::INT AS width, 20 AS height FROM lineitem),
f AS (SELECT *, CASE WHEN abs(y + 10 - lag(y + 10) OVER (PARTITION BY l_orderkey ORDER BY y, ord)) <= 10 THEN 0 ELSE 1 END AS fresh FROM bx),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY y, ord)::BIGINT AS line FROM f)"""
COVER = MASK + """, w AS (SELECT DISTINCT image, y, (x + dx)::INT AS x FROM m, range(-2, 3) t(dx) WHERE x + dx BETWEEN 0 AND 63),
dil AS (SELECT DISTINCT image, (y + dy)::INT AS y, x FROM w, range(-2, 3) t(dy) WHERE y + dy BETWEEN 0 AND 15)"""
COMPARE = COVER + """, pr AS (SELECT a.image AS a, b.image AS b FROM (SELECT DISTINCT image FROM m) a JOIN (SELECT DISTINCT image FROM m) b ON b.image = a.image + 1),
miss AS (SELECT pr.a, pr.b, (SELECT count(*) FROM m WHERE m.image = pr.a AND NOT EXISTS (SELECT 1 FROM dil WHERE dil.image = pr.b AND dil.y = m.y AND dil.x = m.x))
  + (SELECT count(*) FROM m WHERE m.image = pr.b AND NOT EXISTS (SELECT 1 FROM dil WHERE dil.image = pr.a AND dil.y = m.y AND dil.x = m.x)) AS miss,
  (SELECT count(*) FROM (SELECT DISTINCT y, x FROM m WHERE m.image IN (pr.a, pr.b))) AS pixels FROM pr)"""

#: Sums and products of boxes in single precision, as the tracker takes them. State: a video's regions, each with the frame that used it last.
_BOX = "struct_pack(x := ({0})::FLOAT, y := ({1})::FLOAT, w := ({2})::FLOAT, h := ({3})::FLOAT)"
_AREA = "(greatest({0}.w, 0::FLOAT) * greatest({0}.h, 0::FLOAT))"
_WIDE, _HIGH = "(least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x))", "(least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y))"
_COMMON = f"(CASE WHEN {_WIDE} > 0 AND {_HIGH} > 0 THEN {_WIDE} * {_HIGH} ELSE 0::FLOAT END)"
_UNION = f"({_AREA.format('r.b')} + {_AREA.format('b')} - {_COMMON.format('r.b', 'b')})"
_IOU = f"CASE WHEN r.used = f THEN -1::FLOAT WHEN {_UNION} > 0 THEN {_COMMON.format('r.b', 'b')} / {_UNION} ELSE 0::FLOAT END"
_STRIPS = f"""[{_BOX.format('o.x', 'o.y', 'o.w', 'greatest(c.y - o.y, 0::FLOAT)')}, {_BOX.format('o.x', 'least(c.y + c.h, o.y + o.h)', 'o.w', 'greatest(o.y + o.h - (c.y + c.h), 0::FLOAT)')},
  {_BOX.format('o.x', 'o.y', 'greatest(c.x - o.x, 0::FLOAT)', 'o.h')}, {_BOX.format('least(c.x + c.w, o.x + o.w)', 'o.y', 'greatest(o.x + o.w - (c.x + c.w), 0::FLOAT)', 'o.h')}]"""
TRACK = f"""lines AS (SELECT l_orderkey // 64 AS v, l_orderkey % 64 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_tax, l_quantity) AS ord, {_BOX.format('l_discount', 'l_tax', 'l_quantity / 100', '0.1')} AS b FROM lineitem),
det AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY f, ord) AS k FROM lines),
st AS (SELECT v, k, f, ord, [struct_pack(b := b, used := f)] AS held, [struct_pack(i := 0::BIGINT, b := b)] AS out FROM det WHERE k = 1
  UNION ALL SELECT v, k, f, ord, CASE WHEN best IS NULL THEN list_append(held, struct_pack(b := b, used := f)) ELSE changed || [struct_pack(b := x, used := f) FOR x IN remains] END,
    CASE WHEN best IS NULL THEN [struct_pack(i := len(held)::BIGINT, b := b)] ELSE [struct_pack(i := len(held)::BIGINT, b := x) FOR x IN remains] || [struct_pack(i := best - 1, b := b)] END
  FROM (SELECT *, [CASE WHEN j = best THEN struct_pack(b := b, used := f) ELSE r END FOR r, j IN held] AS changed,
      CASE WHEN {_AREA.format('b')} > {_AREA.format('o')} AND c IS NOT NULL AND len(strips) > 0 THEN [list_reduce(strips, lambda p, q: CASE WHEN {_AREA.format('q')} >= {_AREA.format('p')} THEN q ELSE p END)] ELSE [] END AS remains
    FROM (SELECT *, list_filter({_STRIPS}, lambda x: x.w > 0 AND x.h > 0) AS strips
      FROM (SELECT *, CASE WHEN {_WIDE.format('o', 'b')} > 0 AND {_HIGH.format('o', 'b')} > 0 THEN {_BOX.format('greatest(o.x, b.x)', 'greatest(o.y, b.y)', _WIDE.format('o', 'b'), _HIGH.format('o', 'b'))} END AS c
        FROM (SELECT *, held[best].b AS o
          FROM (SELECT *, CASE WHEN list_max(ious) >= 0.05::FLOAT THEN list_position(ious, list_max(ious))::BIGINT END AS best
            FROM (SELECT d.v, d.k, d.f, d.ord, d.b, held, [{_IOU.replace("= f ", "= d.f ")} FOR r IN held] AS ious FROM st JOIN det d ON d.v = st.v AND d.k = st.k + 1)))))))"""
#: Bands and segments of the projection detector over the planes of _stacked; components of the mask, its way out where there are none, don't occur there.
PROJECTION = """e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
m AS (SELECT vec_id // 256 AS f, vec_id // 2 % 128 AS y, (vec_id % 2 * 64 + x) * 4 + k AS x FROM e, range(4) t(k) WHERE vec_id // 2 % 128 // 32 % 3 = 0 AND e > -0.05 AND x < 64),
hl AS (SELECT *, lag(x) OVER (PARTITION BY f, y ORDER BY x) AS was FROM m),
hb AS (SELECT f, y, unnest(CASE WHEN x - was - 1 <= 80 THEN range(was + 1, x + 1) ELSE range(x, x + 1) END) AS x FROM hl),
vl AS (SELECT *, lag(y) OVER (PARTITION BY f, x ORDER BY y) AS was FROM hb),
vb AS (SELECT f, x, unnest(CASE WHEN y - was - 1 <= 12 THEN range(was + 1, y + 1) ELSE range(y, y + 1) END) AS y FROM vl),
ones AS (SELECT f, y, count(*) / 512 AS density FROM vb GROUP BY f, y),
bar AS (SELECT *, greatest(least(0.08::FLOAT, (sum(density) OVER (PARTITION BY f) / 128 * 0.7)::FLOAT), 0.02::FLOAT) AS bar FROM ones),
dense AS (SELECT *, y - row_number() OVER (PARTITION BY f ORDER BY y) AS run FROM bar WHERE density::FLOAT >= bar),
band AS (SELECT f, min(y) AS y0, max(y) + 1 AS y1 FROM dense GROUP BY f, run HAVING count(*) >= 24),
col AS (SELECT vb.f, y0, y1, x, count(*) AS n FROM vb JOIN band b ON b.f = vb.f AND y >= y0 AND y < y1 GROUP BY ALL),
gap AS (SELECT *, x - lag(x) OVER (PARTITION BY f, y0 ORDER BY x) - 1 AS gap, greatest(32, ceil((max(x) OVER (PARTITION BY f, y0) + 1 - min(x) OVER (PARTITION BY f, y0))::FLOAT * 0.2::FLOAT)) AS split FROM col),
cut AS (SELECT *, sum(CASE WHEN gap < split THEN 0 ELSE 1 END) OVER (PARTITION BY f, y0 ORDER BY x) AS s FROM gap),
seg AS (SELECT f, y0, y1, min(x) AS x0, max(x) + 1 AS x1, sum(n)::FLOAT AS n FROM cut GROUP BY f, y0, y1, s),
good AS (SELECT *, ((x1 - x0) * (y1 - y0))::FLOAT AS area FROM seg WHERE x1 - x0 >= 24 AND (x1 - x0) * (y1 - y0) >= 576 AND n / ((x1 - x0) * (y1 - y0))::FLOAT >= 0.25::FLOAT),
best AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n / area * area DESC, y0, x0) - 1 AS ord FROM good QUALIFY ord < 5)"""

ORACLES = {
    "track_regions": f"WITH RECURSIVE {TRACK} SELECT v AS video_id, f AS frame_index, ord::INT AS ord, o.i AS region_id, 'region-' || o.i AS label, o.b.x AS x, o.b.y AS y, o.b.w AS width, o.b.h AS height FROM (SELECT v, f, ord, unnest(out) AS o FROM st)",
    "detect_projection": f"""WITH {PROJECTION} SELECT 0::BIGINT AS video_id, f AS frame_index, ord::INT AS ord, greatest(x0 - 5, 0)::FLOAT AS x, greatest(y0 - 5, 0)::FLOAT AS y,
        (least(x1 + 5, 512) - greatest(x0 - 5, 0))::FLOAT AS width, (least(y1 + 5, 128) - greatest(y0 - 5, 0))::FLOAT AS height, n / area * area AS score FROM best""",
    "luma_band": f"WITH {MASK} SELECT * FROM m",
    "luma_band_comparator": f"WITH {PIXELS} SELECT image, y, x FROM px WHERE v BETWEEN 127 AND 129",
    "gap_bridge_h": f"WITH {BRIDGED} SELECT * FROM h",
    "gap_bridge_v": f"""WITH {BRIDGED}, l2 AS (SELECT *, lag(y) OVER (PARTITION BY image, x ORDER BY y) AS above FROM h)
        SELECT image, x, unnest(CASE WHEN y - above - 1 <= 2 THEN range(above + 1, y + 1) ELSE range(y, y + 1) END)::INT AS y FROM l2""",
    "row_density": f"WITH {MASK}, {DENSITY.replace('M.', 'm.').replace('FROM M)', 'FROM m)').replace('JOIN M ON', 'JOIN m ON')} SELECT * FROM d",
    "band_runs": f"WITH {SEGMENTS} SELECT image, y0, y1 FROM band",
    "column_segments": f"WITH {SEGMENTS} SELECT image, y0, y1, x0, x1, ones FROM seg",
    "candidate_filter": f"WITH {SEGMENTS} SELECT image, y0, x0, round(fill, 9) AS fill, ones::DOUBLE AS mass FROM cand",
    "topk_candidates": f"WITH {SEGMENTS} SELECT image, y0, x0, ones::DOUBLE AS mass, row_number() OVER (PARTITION BY image ORDER BY ones DESC, y0, x0) AS place FROM cand QUALIFY place <= 2",
    "run_length": f"WITH {RUNS} SELECT * FROM r",
    "connected_components": f"""WITH RECURSIVE {RUNS}, n AS (SELECT *, row_number() OVER (ORDER BY image, y, x0) AS id FROM r),
        t AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.image = b.image AND abs(a.y - b.y) = 1 AND a.x1 > b.x0 AND b.x1 > a.x0),
        reach AS (SELECT id AS a, id AS b FROM n UNION SELECT reach.a, t.b FROM reach JOIN t ON t.a = reach.b),
        c AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT image, sum(x1 - x0)::BIGINT AS area, min(x0) AS min_x, max(x1) - 1 AS max_x, min(y) AS min_y, max(y) AS max_y FROM n JOIN c ON c.a = n.id GROUP BY image, root""",
    "integral_image": f"""WITH {PIXELS}, a AS (SELECT *, sum((v BETWEEN 150 AND 190)::INT) OVER (PARTITION BY image, y ORDER BY x) AS across FROM px)
        SELECT image, y, x, (sum(across) OVER (PARTITION BY image, x ORDER BY y))::BIGINT AS total FROM a""",
    "integral_eval": f"""WITH {PIXELS}, t AS (SELECT image, (x - 4) // 6 AS tx, (y - 2) // 2 AS ty, sum((v BETWEEN 150 AND 190)::INT) AS s FROM px WHERE x BETWEEN 4 AND 28 AND y BETWEEN 2 AND 10 GROUP BY ALL),
        z AS (SELECT image, sum(s) / (225 + 1e-6) AS fill, var_pop(s) / (avg(s) + 1e-6) AS vmr FROM t GROUP BY image) SELECT image, round(fill, 9) AS fill, round(vmr, 9) AS vmr, round(fill - 0.1 * vmr, 9) AS score FROM z""",
    "line_grouping": f"WITH {LINES} SELECT l_orderkey, ord, line FROM g",
    "line_merge": f"""WITH RECURSIVE {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY x, ord) AS k FROM g),
        s AS (SELECT l_orderkey, line, k, 1 AS part, x, y, width, height, 1 AS n FROM o WHERE k = 1 UNION ALL
          SELECT l_orderkey, line, k, CASE WHEN j THEN part ELSE part + 1 END, CASE WHEN j THEN least(x, bx) ELSE bx END, CASE WHEN j THEN least(y, b_y) ELSE b_y END,
            CASE WHEN j THEN greatest(x + width, bx + bw) - least(x, bx) ELSE bw END, CASE WHEN j THEN greatest(y + height, b_y + bh) - least(y, b_y) ELSE bh END, CASE WHEN j THEN n + 1 ELSE 1 END
          FROM (SELECT s.l_orderkey, s.line, o.k, part, s.x, s.y, s.width, s.height, n, o.x AS bx, o.y AS b_y, o.width AS bw, o.height AS bh, o.x <= s.x + s.width + 16
              OR greatest(least(s.x + s.width, o.x + o.width) - greatest(s.x, o.x), 0) * greatest(least(s.y + s.height, o.y + o.height) - greatest(s.y, o.y), 0)
              / (s.width * s.height + o.width * o.height - greatest(least(s.x + s.width, o.x + o.width) - greatest(s.x, o.x), 0) * greatest(least(s.y + s.height, o.y + o.height) - greatest(s.y, o.y), 0) + 1e-6) >= 0.15 AS j
            FROM s JOIN o ON o.l_orderkey = s.l_orderkey AND o.line = s.line AND o.k = s.k + 1))
        SELECT l_orderkey, line, x, y, width, height, n FROM s QUALIFY k = max(k) OVER (PARTITION BY l_orderkey, line, part)""",
    "bitset_dilate": f"WITH {COVER} SELECT * FROM dil",
    "bitset_compare": f"WITH {COMPARE} SELECT a, b, miss, pixels, round(greatest(0, 1 - miss / pixels), 6) AS similarity, miss / pixels <= 0.1 AS same FROM miss",
    "consecutive_compare": f"""WITH {COMPARE.replace('image FROM m) ', 'image FROM px) ')}
        SELECT a, b, round(coalesce(greatest(0, 1 - miss / pixels), 1), 4) AS similarity, coalesce(miss / pixels, 0) <= 0.1 AS same FROM miss""",
    "packed_cover": f"""WITH e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
        px AS (SELECT vec_id // 32 AS image, (vec_id % 32 // 2)::INT AS y, (x + vec_id % 2 * 64)::INT AS x, least(greatest(floor((e::DOUBLE + 0.6) / 1.2 * 255), 0), 255)::INT AS v FROM e),
        m AS (SELECT image, y, x FROM px WHERE v BETWEEN 150 AND 190),
        dil AS (SELECT DISTINCT image, (y + dy)::INT AS y, (x + dx)::INT AS x FROM m, range(-2, 3) t(dx), range(-2, 3) u(dy) WHERE x + dx BETWEEN 0 AND 127 AND y + dy BETWEEN 0 AND 15),
        i AS (SELECT DISTINCT image FROM px), pr AS (SELECT f.image AS a, g.image AS b FROM i f JOIN i g ON g.image = f.image + 1),
        lost AS (SELECT a, b, y, x FROM pr JOIN m ON m.image = a ANTI JOIN dil ON dil.image = pr.b AND dil.y = m.y AND dil.x = m.x
          UNION ALL SELECT a, b, y, x FROM pr JOIN m ON m.image = b ANTI JOIN dil ON dil.image = pr.a AND dil.y = m.y AND dil.x = m.x),
        l AS (SELECT a, b, count(*) AS miss FROM lost GROUP BY a, b), u AS (SELECT a, b, count(DISTINCT y * 128 + x) AS pixels FROM pr JOIN m ON m.image IN (a, b) GROUP BY a, b),
        z AS (SELECT a, b, coalesce(miss, 0) AS miss, coalesce(pixels, 0) AS pixels, CASE WHEN pixels > 0 THEN coalesce(miss, 0) / pixels ELSE 0 END AS part FROM pr LEFT JOIN l USING (a, b) LEFT JOIN u USING (a, b))
        SELECT a, b, miss, pixels, round(greatest(0, 1 - part), 6) AS similarity, part <= 0.1 AS same FROM z""",
}
