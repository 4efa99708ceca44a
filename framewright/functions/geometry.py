"""Boxes as Catalyst expressions. A box is a struct of x, y, width and height, in pixels or as parts of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(v: Column, low, high) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.least(F.greatest(v, as_column(low)), as_column(high))


def rounded(v: Column, digits: int) -> Column:
    """To that many decimal places, halves away from zero, as SQL does it on doubles: by arithmetic, where round() goes by way of
    a decimal number's text. What is too large to have decimal places, infinite or no number stays."""
    scale = 10.0**digits
    grown = F.abs(v) * scale
    whole = F.rint(grown)
    half = (grown - whole == 0.5).cast("double")  # rint takes it to the even side
    return F.when(grown < 2.0**52, F.signum(v) * (whole + half) / scale + 0.0).otherwise(v)


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def intersection(a: Column, b: Column) -> Column:
    """Null where the boxes do not overlap."""
    x0, y0 = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    x1, y1 = F.least(right(a), right(b)), F.least(bottom(a), bottom(b))
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def overlap_area(a: Column, b: Column) -> Column:
    width = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    height = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def iou(a: Column, b: Column, common: Column | None = None) -> Column:
    """common: their overlap_area, if it is a column already; else it is computed in each place that needs it."""
    common = overlap_area(a, b) if common is None else common
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def edges(b: Column) -> Column:
    """struct<x0, y0, x1, y1, area>: what pairs need of a box, computed once a box."""
    return F.struct(b["x"].alias("x0"), b["y"].alias("y0"), right(b).alias("x1"), bottom(b).alias("y1"), area(b).alias("area"))


def common_area(a: Column, b: Column) -> Column:
    """overlap_area of boxes given by their edges."""
    width, height = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def normalised(b: Column, width: float, height: float) -> Column:
    x0, y0 = clamp(b["x"] / width, 0.0, 1.0), clamp(b["y"] / height, 0.0, 1.0)
    x1, y1 = clamp(right(b) / width, x0, 1.0), clamp(bottom(b) / height, y0, 1.0)
    return box(x0, y0, x1 - x0, y1 - y0)


def outer_pixels(b: Column, width: int, height: int) -> Column:
    """Pixels that a part of a frame touches; null if there are none."""
    x0, y0 = clamp(F.floor(b["x"] * width), 0, width), clamp(F.floor(b["y"] * height), 0, height)
    x1, y1 = clamp(F.ceil(right(b) * width), x0, width), clamp(F.ceil(bottom(b) * height), y0, height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def outer_pixels_never_empty(b: Column, width: int, height: int) -> Column:
    """As outer_pixels of the box clamped to the frame first, and one pixel at least."""
    x0 = clamp(F.floor(clamp(b["x"], 0.0, 1.0) * width), 0, width - 1)
    y0 = clamp(F.floor(clamp(b["y"], 0.0, 1.0) * height), 0, height - 1)
    x1 = clamp(F.ceil(clamp(right(b), 0.0, 1.0) * width), x0 + 1, width)
    y1 = clamp(F.ceil(clamp(bottom(b), 0.0, 1.0) * height), y0 + 1, height)
    return box(x0, y0, x1 - x0, y1 - y0)


def inner_pixels(b: Column, width: int, height: int) -> Column:
    """Pixels that lie whole in a part of a frame; null if there are none."""
    x0, y0 = clamp(b["x"], 0.0, 1.0), clamp(b["y"], 0.0, 1.0)
    x1, y1 = clamp(right(b), x0, 1.0), clamp(bottom(b), y0, 1.0)
    px0, py0, px1, py1 = F.ceil(x0 * width), F.ceil(y0 * height), F.floor(x1 * width), F.floor(y1 * height)
    return F.when((px1 > px0) & (py1 > py0), box(px0, py0, px1 - px0, py1 - py0))


def recogniser_region(b: Column, width: float, height: float, inset: float = 1e-3) -> Column:
    """In pixels, just inside the frame's right and lower edges, one pixel wide and high at least."""
    x0, y0 = clamp(b["x"] * width, 0.0, width), clamp(b["y"] * height, 0.0, height)
    x1, y1 = clamp(right(b) * width, x0, width), clamp(bottom(b) * height, y0, height)
    x1 = F.when(x1 >= width, F.greatest(F.lit(width - inset), x0)).otherwise(x1)
    y1 = F.when(y1 >= height, F.greatest(F.lit(height - inset), y0)).otherwise(y1)
    return box(x0, y0, F.greatest(x1 - x0, F.lit(1.0)), F.greatest(y1 - y0, F.lit(1.0)))


def region_bounds(region: Column, width: int, height: int) -> Column:
    """struct<left, top, right, bottom> of the whole pixels that a region in pixels touches; null if there are none."""
    x0, y0 = clamp(F.floor(region["x"]), 0, width), clamp(F.floor(region["y"]), 0, height)
    x1, y1 = clamp(F.ceil(right(region)), x0, width), clamp(F.ceil(bottom(region)), y0, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom")))


def union(boxes: Column) -> Column:
    """The least box around an array of boxes; null for none."""
    ends = lambda f: F.transform(boxes, f)
    x0, y0 = F.array_min(ends(lambda b: b["x"])), F.array_min(ends(lambda b: b["y"]))
    return F.when(F.size(boxes) > 0, box(x0, y0, F.array_max(ends(right)) - x0, F.array_max(ends(bottom)) - y0))


def inflated(b: Column, width: float, height: float, margin: float = 5.0) -> Column:
    x0, y0 = F.greatest(b["x"] - margin, F.lit(0.0)), F.greatest(b["y"] - margin, F.lit(0.0))
    x1, y1 = F.least(right(b) + margin, F.lit(width)), F.least(bottom(b) + margin, F.lit(height))
    return box(x0, y0, F.greatest(x1 - x0, F.lit(0.0)), F.greatest(y1 - y0, F.lit(0.0)))


def with_clip_remainder(pairs: DataFrame, old: str, new: str, name: str) -> DataFrame:
    """pairs with a box: of what is left of old beside its overlap with new, the largest of the strips above, below, left and
    right; the last of equal ones. Pairs without overlap or remainder are left out. In steps of columns, so that each value
    is computed once and the generated code stays small."""
    zero, o, n = F.lit(0.0), F.col(old), F.col(new)
    x0, y0, x1, y1 = F.greatest(o["x"], n["x"]), F.greatest(o["y"], n["y"]), F.least(right(o), right(n)), F.least(bottom(o), bottom(n))
    rows = pairs.where((x1 > x0) & (y1 > y0)).withColumns({"_x0": x0, "_y0": y0}).withColumns({"_x1": F.col("_x0") + (x1 - F.col("_x0")), "_y1": F.col("_y0") + (y1 - F.col("_y0"))})
    sizes = (F.col("_y0") - o["y"], bottom(o) - F.col("_y1"), F.col("_x0") - o["x"], right(o) - F.col("_x1"))
    rows = rows.withColumns({f"_size{i}": F.greatest(s, zero) for i, s in enumerate(sizes)})
    rows = rows.withColumns({f"_area{i}": F.col(f"_size{i}") * o["width" if i < 2 else "height"] for i in range(4)})
    rows = rows.withColumn("_most", F.greatest(*[f"_area{i}" for i in range(4)]))
    which = F.when((F.col("_area3") == F.col("_most")) & (F.col("_size3") > 0), 3)
    for i in (2, 1, 0):
        which = which.when((F.col(f"_area{i}") == F.col("_most")) & (F.col(f"_size{i}") > 0), i)
    rows, at = rows.withColumn("_which", which), F.col("_which")
    strip = box(
        F.when(at == 3, F.least(F.col("_x1"), right(o))).otherwise(o["x"]),
        F.when(at == 1, F.least(F.col("_y1"), bottom(o))).otherwise(o["y"]),
        F.when(at == 3, F.col("_size3")).when(at == 2, F.col("_size2")).otherwise(o["width"]),
        F.when(at == 1, F.col("_size1")).when(at == 0, F.col("_size0")).otherwise(o["height"]),
    )
    # A filter would go down to the join with all that its columns stand for; an array of none or one stays here.
    return rows.select(*pairs.columns, F.explode(F.when(at.isNotNull(), F.array(strip))).alias(name))


def valid_region(roi: Column, duration_ns: Column, width: int, height: int) -> Column:
    """A thousandth of the frame, 15 pixels each way and 200 ms at least."""
    wide, high = F.floor(F.greatest(roi["width"], F.lit(0.0)) * width), F.floor(F.greatest(roi["height"], F.lit(0.0)) * height)
    return (area(roi) >= 0.001) & (wide >= 15) & (high >= 15) & (F.greatest(duration_ns, F.lit(0)) >= 200_000_000)


#: Fixed value: the region that is shown until another is chosen, as x, y, width and height in parts of the frame.
DEFAULT_REGION = (0.2, 0.8, 0.6, 0.2)


def default_region() -> Column:
    return box(*map(F.lit, DEFAULT_REGION))
