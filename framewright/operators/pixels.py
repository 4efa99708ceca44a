"""Image kernels in relational form, over rows (image, y, x) of set pixels.

An image is a bounded group, so windows by image and row hold little; images spread over tasks by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import fold_sorted


def luma_band(pixels: DataFrame, target: int, delta: int, least_delta: int = 0) -> DataFrame:
    """Pixels within delta of target, both ends cut to 0..255. Comparators take a delta of one at least."""
    delta = max(delta, least_delta)
    return pixels.where(F.col("v").between(max(target - delta, 0), min(target + delta, 255))).select("image", "y", "x")


def bridged(mask: DataFrame, limit: int, along: str = "x") -> DataFrame:
    """Gaps of at most limit pixels between set ones are set, along rows (x) or columns (y)."""
    across = "y" if along == "x" else "x"
    before = F.lag(along).over(Window.partitionBy("image", across).orderBy(along))
    first = F.when(F.col(along) - F.col("before") - 1 <= limit, F.col("before") + 1).otherwise(F.col(along))
    filled = mask.withColumn("before", before).withColumn("at", F.explode(F.sequence(first, F.col(along)))).select("image", across, F.col("at").alias(along))
    return filled.select("image", "y", "x")


def row_density(mask: DataFrame, width: int, height: int) -> DataFrame:
    """ones and density of each row of each image that has a set pixel, empty rows included."""
    ones = mask.groupBy("image", "y").agg(F.count(F.lit(1)).alias("ones"))
    rows = mask.select("image").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    full = rows.join(ones, ["image", "y"], "left").withColumn("ones", F.coalesce("ones", F.lit(0)))
    return full.withColumn("density", F.col("ones") / F.lit(float(width)))


def band_runs(density: DataFrame, cap: float = 0.08, floor: float = 0.02, min_height: int = 8) -> DataFrame:
    """Maximal runs of rows that reach the image's threshold: 0.7 of the mean density, between floor and cap."""
    whole, order = Window.partitionBy("image"), Window.partitionBy("image").orderBy("y")
    bar = F.greatest(F.least(F.lit(cap), F.avg("density").over(whole) * 0.7), F.lit(floor))
    dense = density.withColumn("bar", bar).where("density >= bar").withColumn("run", F.col("y") - F.row_number().over(order))
    runs = dense.groupBy("image", "run").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return runs.where(F.col("y1") - F.col("y0") >= min_height).select("image", "y0", "y1")


def column_segments(mask: DataFrame, bands: DataFrame, min_gap: int = 32, ratio: float = 0.2) -> DataFrame:
    """Stretches of a band's columns that hold set pixels, joined over gaps below max(min_gap, ratio of its width)."""
    m = mask.join(bands, "image").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    columns = m.groupBy("image", "y0", "y1", "x").agg(F.count(F.lit(1)).alias("ones"))
    band = Window.partitionBy("image", "y0")
    width = F.max("x").over(band) - F.min("x").over(band) + 1
    split = F.greatest(F.lit(min_gap), F.ceil(width * ratio))
    rows = columns.withColumn("gap", F.col("x") - F.lag("x").over(band.orderBy("x")) - 1).withColumn("split", split)
    rows = rows.withColumn("fresh", F.when((F.col("gap") == 0) | (F.col("gap") < F.col("split")), 0).otherwise(1))
    rows = rows.withColumn("segment", F.sum("fresh").over(band.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("image", "y0", "y1", "segment").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.sum("ones").alias("ones")).drop("segment")


def candidates(segments: DataFrame, min_area: int = 576, min_fill: float = 0.25, min_width: int = 24) -> DataFrame:
    """Segments that are large, full and wide enough, with fill and mass (the set pixels)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    kept = segments.withColumn("fill", F.col("ones") / area)
    return kept.where((area >= min_area) & (F.col("fill") >= min_fill) & (F.col("x1") - F.col("x0") >= min_width)).withColumn("mass", F.col("ones").cast("double"))


def top_candidates(found: DataFrame, k: int = 5) -> DataFrame:
    """The k of each image with the largest mass; of equal ones the upper, then the left."""
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("mass"), "y0", "x0"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs: image, y, x0, x1 (exclusive)."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return mask.withColumn("run", island).groupBy("image", "y", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("run")


def connected(run_rows: DataFrame) -> DataFrame:
    """Components of runs that touch in neighbouring rows: image, area and inclusive bounds.

    Rows come in order, so a fold keeps the open components and the last two rows of runs, not the image."""

    def start() -> dict:
        return {"y": None, "above": [], "row": [], "parts": {}, "next": 0}

    def close(state: dict, image, everything: bool) -> list[tuple]:
        live = set() if everything else {r[2] for r in state["row"]} | {r[2] for r in state["above"]}
        done = [k for k in state["parts"] if k not in live]
        return [(image, *state["parts"].pop(k)) for k in done]

    def step(state: dict, row) -> list[tuple]:
        if row is None:
            return close(state, state["image"], True)
        out = []
        state["image"] = row.image
        if row.y != state["y"]:
            state["above"] = state["row"] if state["y"] is not None and row.y == state["y"] + 1 else []
            state["row"], state["y"] = [], row.y
            out = close(state, row.image, False)
        touching = {c for a, b, c in state["above"] if b > row.x0 and row.x1 > a}
        part = (row.x1 - row.x0, row.x0, row.x1 - 1, row.y, row.y)
        for c in touching:
            o = state["parts"].pop(c)
            part = (part[0] + o[0], min(part[1], o[1]), max(part[2], o[2]), min(part[3], o[3]), max(part[4], o[4]))
        own = state["next"]
        state["next"] += 1
        state["parts"][own] = part
        for side in ("above", "row"):
            state[side] = [(a, b, own if c in touching else c) for a, b, c in state[side]]
        state["row"].append((row.x0, row.x1, own))
        return out

    return fold_sorted(run_rows, ["image"], ["y", "x0"], start, step, "image bigint, area bigint, min_x bigint, max_x bigint, min_y bigint, max_y bigint")


def integral(pixels: DataFrame, value: str = "m") -> DataFrame:
    """total: the sum of value over the pixels above and left of each, itself included."""
    across = F.sum(value).over(Window.partitionBy("image", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("across").over(Window.partitionBy("image", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    return pixels.withColumn("across", across).withColumn("total", down).drop("across")


def region_score(pixels: DataFrame, x: int, y: int, width: int, height: int, tiles: int = 4, value: str = "m") -> DataFrame:
    """fill, vmr and score of one region of each image: fill less a tenth of the variance of tile sums over their mean."""
    dx, dy = max(width // tiles, 1), max(height // tiles, 1)
    inside = pixels.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    sums = inside.groupBy("image", F.expr(f"(x - {x}) div {dx}").alias("tx"), F.expr(f"(y - {y}) div {dy}").alias("ty")).agg(F.sum(value).alias("s"))
    vmr = F.var_pop("s") / (F.avg("s") + 1e-6) if width >= tiles and height >= tiles else F.lit(0.0)
    stats = sums.groupBy("image").agg((F.sum("s") / (width * height + 1e-6)).alias("fill"), vmr.alias("vmr"))
    return stats.withColumn("score", F.col("fill") - 0.1 * F.col("vmr"))


def line_groups(boxes: DataFrame, group: str, tolerance: int = 10) -> DataFrame:
    """line: boxes by y, chained while the middle differs by at most tolerance from the one before."""
    order = Window.partitionBy(group).orderBy("y", "ord")
    middle = F.col("y") + F.expr("height div 2")
    rows = boxes.withColumn("middle", middle)
    fresh = F.when(F.abs(F.col("middle") - F.lag("middle").over(order)) <= tolerance, 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh)
    return rows.withColumn("line", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh", "middle")


def merged_lines(boxes: DataFrame, group: str, near: int = 16, min_iou: float = 0.15) -> DataFrame:
    """Boxes of a line from left to right, joined while they overlap enough or start no more than near beyond. Boxes that
    overlap start no further than the joined box reaches, so with near and min_iou from 0 on the latter alone tells, and a box that
    starts a new one lies beyond all before it: how far the joined box reaches is a running maximum."""
    if near < 0 or min_iou <= 0:
        raise ValueError("near is not negative, min_iou is above 0")
    order = Window.partitionBy(group, "line").orderBy("x", "ord", "y", "width", "height")
    reach = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("fresh", F.when(F.col("x") <= reach + near, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.count(F.lit(1)).cast("int").alias("n")]
    joined = rows.groupBy(group, "line", "part").agg(*ends)
    return joined.select(group, "line", "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("y1") - F.col("y")).alias("height"), "n")


def dilated(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """All pixels within radius rows and columns of a set one, inside the image."""
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c) - radius, F.lit(0)), F.least(F.col(c) + radius, F.lit(n - 1)))).alias(c)
    wide = mask.select("image", "y", near("x", width)).distinct()
    return wide.select("image", near("y", height), "x").distinct()
