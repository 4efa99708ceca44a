"""Queries over image filters, frame times and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import arrays as A
from ..operators import pixels as P
from ..session import table
from ..sources import frames as V
from .frames import FRAMES
from .pixels import MASK, PIXELS, H, W, _pixels
from .segments import BOXES, _boxes

NEW_W, NEW_H = 20, 7


def _rounded(df, column, digits=6):
    return df.withColumn(column, F.round(column, digits))


def _bounds(spark, d):
    """The box around each order's boxes in pixels, cut to the pixels of a region."""
    b = _boxes(spark, d)
    boxes = b.groupBy("l_orderkey").agg(F.collect_list(G.box(F.col("b.x") * 2000, F.col("b.y") * 1200, F.col("b.width") * 2000, F.col("b.height") * 1000)).alias("b"))
    u = boxes.select("l_orderkey", G.region_bounds(G.union(F.col("b")), 1920, 1080).alias("r")).where("r is not null")
    cut = u.select("l_orderkey", F.greatest("r.left", F.lit(20)).alias("left"), F.greatest("r.top", F.lit(10)).alias("top"), F.least("r.right", F.lit(900)).alias("right"), F.least("r.bottom", F.lit(150)).alias("bottom"))
    return cut.where("right > left and bottom > top")


def _region_bounds(spark, d):
    b = _boxes(spark, d).withColumn("r", G.region_bounds(G.recogniser_region(F.col("b"), 1920.0, 1080.0), 1920, 1080)).where("r is not null")
    return b.select("l_orderkey", "l_linenumber", "r.*")


def _sorted(spark, d):
    """Frames of which some come twice and some have no index."""
    arrival = V.event_frames(table(spark, d, "events")).withColumnRenamed("frame_index", "arrival")
    frames = arrival.withColumn("frame_index", F.when(F.col("arrival") % 5 != 0, F.expr("arrival * 7 div 2 % 40")))
    return V.sorted_frames(frames, "arrival").select("video_id", "frame_index", "arrival")


def _times(spark, d):
    f = V.event_frames(table(spark, d, "events"))
    ticks = F.when(F.col("frame_index") % 4 != 0, F.col("pts_ns") / 1000 - 2_000_000)
    rows = f.select("video_id", "frame_index", V.from_ticks(ticks, 1, 90_000).alias("pts_ns"))
    return rows.select("video_id", "frame_index", "pts_ns", V.frame_time(F.col("pts_ns"), F.col("frame_index"), F.lit(24.0)).alias("frame_ns"), V.native_index(F.col("pts_ns"), F.lit(29.97), F.col("frame_index"), 3).alias("native_index"))


def _colours(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.from_rgb(F.col("l_discount") * 9, F.col("l_tax") * 14 - 0.1, F.col("l_quantity") / 50).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "c.*")


def _distances(spark, d):
    lines = V.pixel_lines(table(spark, d, "embeddings").select("vec_id", "embedding"), H)
    return _rounded(A.distances(lines.select("image", "y", F.transform("line", lambda v: v.between(188, 212)).alias("mask"))), "distance")


QUERIES = {
    "masked_patch": lambda s, d: _rounded(_rounded(A.masked_patch(_pixels(s, d), 170, 20), "original"), "masked"),
    "resize_average": lambda s, d: _rounded(A.resized(_pixels(s, d), W, H, NEW_W, NEW_H), "v"),
    "gaussian_blur": lambda s, d: _rounded(A.gaussian(_pixels(s, d)), "v"),
    "box_blur": lambda s, d: A.box_blurred(_pixels(s, d)),
    "normalise_max": lambda s, d: _rounded(A.normalised(_pixels(s, d)), "v"),
    "percentile_rank": lambda s, d: A.nearest_rank(_pixels(s, d), 0.7),
    "cosine_transform": lambda s, d: _rounded(A.cosine_transform(_pixels(s, d), W, H), "coefficient", 4),
    "distance_transform": _distances,
    "luma_highlight": lambda s, d: A.highlighted(_pixels(s, d), (5, 2, 50, 14), W, H, 150, 190, 81),
    "rect_outline": lambda s, d: A.outlined(_pixels(s, d), (5, 2, 50, 14), 81),
    "rgb_to_nv12": _colours,
    "detection_bounds": _bounds,
    "ocr_region_bounds": _region_bounds,
    "sort_frames": _sorted,
    "frame_times": _times,
}

_EDGES = "lag({0}) OVER (PARTITION BY image, {1} ORDER BY {2}) AS {3}, lead({0}) OVER (PARTITION BY image, {1} ORDER BY {2}) AS {4}"
_YUV = [f"least(greatest(floor({w[3]}::DOUBLE + {' + '.join(f'{k}::DOUBLE * {c}' for k, c in zip(w, 'rgb'))} + 0.5), 0), 255)::INT AS {n}" for n, w in zip("yuv", (A.TO_Y, A.TO_U, A.TO_V))]
ORACLES = {
    "masked_patch": f"WITH {PIXELS} SELECT image, y, x, round(v / 255.0::DOUBLE, 6) AS original, CASE WHEN v BETWEEN 150 AND 190 THEN round(v / 255.0::DOUBLE, 6) ELSE 0 END AS masked, (v BETWEEN 150 AND 190)::INT::DOUBLE AS mask FROM px",
    "resize_average": f"""WITH {PIXELS} SELECT image, ny::INT AS ny, nx::INT AS nx, round(avg(v), 6) AS v FROM px JOIN range({NEW_W}) a(nx) ON x >= nx * {W} // {NEW_W} AND x < ceil((nx + 1) * {W} / {NEW_W})
        JOIN range({NEW_H}) b(ny) ON y >= ny * {H} // {NEW_H} AND y < ceil((ny + 1) * {H} / {NEW_H}) GROUP BY ALL""",
    "gaussian_blur": f"""WITH {PIXELS}, k AS (SELECT px.image, (y + dy)::INT AS y, (x + dx)::INT AS x, v, (2 - abs(dx)) * (2 - abs(dy)) AS w FROM px, range(-1, 2) a(dx), range(-1, 2) b(dy)),
        b AS (SELECT image, max(y) AS my FROM px GROUP BY image) SELECT k.image, y, x, round(sum(v * w) / sum(w)::DOUBLE, 6) AS v FROM k JOIN b ON b.image = k.image WHERE y BETWEEN 0 AND my AND x BETWEEN 0 AND 63 GROUP BY ALL""",
    "box_blur": f"""WITH {PIXELS}, a AS (SELECT *, {_EDGES.format('v', 'y', 'x', 'l', 'r')} FROM px), s AS (SELECT image, y, x, coalesce(l, v) + v + coalesce(r, v) AS s FROM a),
        b AS (SELECT *, {_EDGES.format('s', 'x', 'y', 'u', 'd')} FROM s) SELECT image, y, x, ((coalesce(u, s) + s + coalesce(d, s)) // 9)::INT AS v FROM b""",
    "normalise_max": f"WITH {PIXELS} SELECT image, y, x, round(v / greatest(max(v) OVER (PARTITION BY image), 1)::DOUBLE, 6) AS v FROM px",
    "percentile_rank": f"WITH {PIXELS}, l AS (SELECT image, list_sort(list(v)) AS vs FROM px GROUP BY image) SELECT image, vs[floor((len(vs) - 1) * 0.7::DOUBLE + 0.5)::INT + 1] AS v FROM l",
    "cosine_transform": f"""WITH {PIXELS}, r AS (SELECT image, y, u, sum(v * cos(pi() / {W} * (x + 0.5::DOUBLE) * u)) AS c FROM px, range({W}) t(u) GROUP BY ALL)
        SELECT image, w::INT AS v, u::INT AS u, round(sum(c * cos(pi() / {H} * (y + 0.5::DOUBLE) * w)), 4) AS coefficient FROM r, range({H}) t(w) GROUP BY ALL""",
    "distance_transform": f"""WITH {PIXELS}, m AS (SELECT image, y AS my, x AS mx FROM px WHERE v BETWEEN 188 AND 212)
        SELECT px.image, y, x, round(min(greatest(abs(x - mx), abs(y - my)) + (sqrt(2) - 1) * least(abs(x - mx), abs(y - my))), 6) AS distance FROM px LEFT JOIN m ON m.image = px.image GROUP BY ALL""",
    "luma_highlight": f"""WITH {PIXELS}, h AS (SELECT *, x // 2 * 2 >= 5 AND x // 2 * 2 + 1 < 50 AND y // 2 * 2 >= 2 AND y // 2 * 2 + 1 < 14 AND v BETWEEN 150 AND 190 AS o FROM px)
        SELECT image, y, x, CASE WHEN o THEN 81 ELSE v END AS v, bool_or(o) OVER (PARTITION BY image, y // 2, x // 2) AS hit FROM h""",
    "rect_outline": f"WITH {PIXELS} SELECT image, y, x, CASE WHEN x BETWEEN 5 AND 49 AND y BETWEEN 2 AND 13 AND (x < 7 OR x > 47 OR y < 4 OR y > 11) THEN 81 ELSE v END AS v FROM px",
    "rgb_to_nv12": f"""WITH c AS (SELECT l_orderkey, l_linenumber, floor(least(greatest(l_discount * 9, 0), 1)::DOUBLE * 255 + 0.5) AS r, floor(least(greatest(l_tax * 14 - 0.1::DOUBLE, 0), 1)::DOUBLE * 255 + 0.5) AS g,
        floor(least(greatest(l_quantity / 50, 0), 1)::DOUBLE * 255 + 0.5) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(_YUV)} FROM c""",
    "detection_bounds": f"""WITH {BOXES}, u AS (SELECT l_orderkey, floor(min(x * 2000)) AS l, floor(min(y * 1200)) AS t, ceil(min(x * 2000) + (max(x * 2000 + w * 2000) - min(x * 2000))) AS r, ceil(min(y * 1200) + (max(y * 1200 + h * 1000) - min(y * 1200))) AS b FROM b GROUP BY l_orderkey),
        c AS (SELECT l_orderkey, greatest(least(greatest(l, 0), 1920), 20)::BIGINT AS "left", greatest(least(greatest(t, 0), 1080), 10)::BIGINT AS top, least(r, 1920, 900)::BIGINT AS "right", least(b, 1080, 150)::BIGINT AS bottom FROM u)
        SELECT * FROM c WHERE "right" > "left" AND bottom > top""",
    "ocr_region_bounds": f"""WITH {BOXES}, e AS (SELECT *, least(greatest(x * 1920, 0), 1920) AS x0, least(greatest(y * 1080, 0), 1080) AS y0 FROM b),
        g AS (SELECT *, least(greatest((x + w) * 1920, x0), 1920) AS rx, least(greatest((y + h) * 1080, y0), 1080) AS ry FROM e),
        k AS (SELECT *, x0 + greatest(CASE WHEN rx >= 1920 THEN greatest(1920 - 0.001::DOUBLE, x0) ELSE rx END - x0, 1) AS x1, y0 + greatest(CASE WHEN ry >= 1080 THEN greatest(1080 - 0.001::DOUBLE, y0) ELSE ry END - y0, 1) AS y1 FROM g),
        f AS (SELECT l_orderkey, l_linenumber, floor(x0)::BIGINT AS "left", floor(y0)::BIGINT AS top, least(ceil(x1), 1920)::BIGINT AS "right", least(ceil(y1), 1080)::BIGINT AS bottom FROM k) SELECT * FROM f WHERE "right" > "left" AND bottom > top""",
    "sort_frames": f"""WITH {FRAMES}, a AS (SELECT video_id, frame_index AS arrival, CASE WHEN frame_index % 5 <> 0 THEN frame_index * 7 // 2 % 40 END AS frame_index FROM fr),
        k AS (SELECT video_id, arrival, frame_index, coalesce(frame_index, row_number() OVER (PARTITION BY video_id, frame_index IS NULL ORDER BY arrival) - 1) AS key FROM a)
        SELECT video_id, frame_index, arrival FROM k QUALIFY row_number() OVER (PARTITION BY video_id, key ORDER BY arrival) = 1""",
    "frame_times": f"""WITH {FRAMES}, t AS (SELECT video_id, frame_index, CASE WHEN frame_index % 4 <> 0 AND pts_ns / 1000 - 2000000 >= 0 THEN floor((pts_ns / 1000 - 2000000) / 90000::DOUBLE * 1e9 + 0.5)::BIGINT END AS pts_ns FROM fr)
        SELECT video_id, frame_index, pts_ns, coalesce(pts_ns, floor(frame_index / 24::DOUBLE * 1e9)::BIGINT) AS frame_ns, coalesce(floor(pts_ns / 1e9 * 29.97::DOUBLE + 0.5)::BIGINT, frame_index + 3) AS native_index FROM t""",
}
