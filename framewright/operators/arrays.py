"""Filters and transforms of images in relational form, over rows (image, y, x, v); an image is a bounded group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K

#: What a finite maximum must pass, and the weights of the 3 x 3 kernel's middle and sides.
EPSILON, MIDDLE = 1.1920929e-7, 2
#: Fixed values of full-range colour conversion: weights of red, green and blue, and the offset.
TO_Y, TO_U, TO_V = (0.299, 0.587, 0.114, 0.0), (-0.168736, -0.331264, 0.5, 128.0), (0.5, -0.418688, -0.081312, 128.0)


def masked_patch(pixels: DataFrame, target: int, delta: int) -> DataFrame:
    """original, masked and mask of each pixel, as parts of 255."""
    delta = max(delta, 1)
    inside = F.col("v").between(max(target - delta, 0), min(target + delta, 255))
    part = F.col("v") / 255.0
    return pixels.select("image", "y", "x", part.alias("original"), F.when(inside, part).otherwise(0.0).alias("masked"), inside.cast("double").alias("mask"))


def resized(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Means over the source pixels that each new one touches; a source pixel goes to those new ones only."""

    def touched(c: str, n: int, to: int):
        at = F.sequence(F.lit(0), F.lit(to - 1))
        hit = lambda k: (F.col(c) >= F.floor(k * n / to)) & (F.col(c) < F.greatest(F.least(F.ceil((k + 1) * n / to), F.lit(n)), F.floor(k * n / to) + 1))
        return F.explode(F.filter(at, hit))

    wide = pixels.select("image", "y", touched("x", width, to_width).alias("nx"), "v")
    new = wide.select("image", touched("y", height, to_height).alias("ny"), "nx", "v")
    return new.groupBy("image", "ny", "nx").agg(F.avg("v").alias("v"))


def _beside(column: str, along: str, across: str):
    order = Window.partitionBy("image", across).orderBy(along)
    return F.lag(column).over(order), F.lead(column).over(order)


def gaussian(pixels: DataFrame) -> DataFrame:
    """3 x 3 weights 1 2 1 each way, over the weights inside the image. The kernel is a product, so rows come first."""
    before, after = _beside("v", "x", "y")
    side = lambda c: c.isNotNull().cast("double")
    rows = pixels.select("image", "y", "x", (F.coalesce(before, F.lit(0)) + MIDDLE * F.col("v") + F.coalesce(after, F.lit(0))).alias("s"), (side(before) + MIDDLE + side(after)).alias("w"))
    (s0, s1), (w0, w1) = _beside("s", "y", "x"), _beside("w", "y", "x")
    zero = F.lit(0.0)
    total, weight = (F.coalesce(a, zero) + MIDDLE * F.col(c) + F.coalesce(b, zero) for a, c, b in ((s0, "s", s1), (w0, "w", w1)))
    return rows.select("image", "y", "x", (total / weight).alias("v"))


def box_blurred(pixels: DataFrame) -> DataFrame:
    """Integer means of 3 x 3 pixels, those at the edges counted again beyond them."""
    before, after = _beside("v", "x", "y")
    rows = pixels.select("image", "y", "x", (F.coalesce(before, "v") + F.col("v") + F.coalesce(after, "v")).alias("s"))
    above, below = _beside("s", "y", "x")
    return rows.select("image", "y", "x", F.floor((F.coalesce(above, "s") + F.col("s") + F.coalesce(below, "s")) / 9).cast("int").alias("v"))


def normalised(pixels: DataFrame) -> DataFrame:
    """Over the image's maximum, where that is above nothing."""
    top = F.max("v").over(Window.partitionBy("image"))
    return pixels.select("image", "y", "x", F.col("v"), top.alias("top")).select("image", "y", "x", F.when(F.col("top") > EPSILON, F.col("v") / F.col("top")).otherwise(F.col("v").cast("double")).alias("v"))


def nearest_rank(pixels: DataFrame, share: float) -> DataFrame:
    """The value at place round((n - 1) * share) of an image's sorted values."""
    whole = Window.partitionBy("image")
    rows = pixels.select("image", "v", (F.row_number().over(whole.orderBy("v")) - 1).alias("place"), F.count(F.lit(1)).over(whole).alias("n"))
    return rows.where(F.col("place") == F.floor((F.col("n") - 1) * min(max(share, 0.0), 1.0) + 0.5)).select("image", "v")


def cosine_transform(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Unnormalised two-dimensional DCT-II: each row as an array, then each column."""

    def once(rows: DataFrame, group: str, along: str, n: int, value: str, to: str) -> DataFrame:
        lists = rows.groupBy("image", group).agg(F.array_sort(F.collect_list(F.struct(along, value))).alias("p"))
        term = lambda k: F.aggregate("p", F.lit(0.0), lambda s, p: s + p[value] * F.cos(math.pi / n * (p[along] + 0.5) * k))
        return lists.select("image", group, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), term)).alias(to, "c"))

    rows = once(pixels, "y", "x", width, "v", "u")
    return once(rows, "u", "y", height, "c", "w").select("image", F.col("w").alias("v"), "u", F.col("c").alias("coefficient"))


def distances(lines: DataFrame) -> DataFrame:
    """image, y, x, distance of each pixel to the nearest set one by straight and diagonal steps; null where an image has none.
    lines: image, y, mask (array<boolean>). Two passes over the lines of an image, each linear in its pixels; a task holds
    one image. Lines that are missing have no set pixel."""

    def run(lines: pd.DataFrame) -> pd.DataFrame:
        widths = lines["mask"].map(len)
        mask = np.zeros((lines["y"].max() + 1, widths.max()), bool)
        for y, line in zip(lines["y"], lines["mask"]):
            mask[y, : len(line)] |= np.asarray(line, bool)
        found = K.octile_distance(mask)
        rows = [found[y, :n].tolist() if mask.any() else [None] * n for y, n in zip(lines["y"], widths)]
        return pd.DataFrame({"image": lines["image"], "y": lines["y"], "row": rows})

    rows = lines.select("image", "y", "mask").groupBy("image").applyInPandas(run, "image bigint, y int, row array<double>")
    return rows.select("image", "y", F.posexplode("row").alias("x", "distance"))


def highlighted(pixels: DataFrame, roi: tuple[int, int, int, int], width: int, height: int, low: int, high: int, to: int) -> DataFrame:
    """Pixels between low and high get the value to, in whole 2 x 2 blocks inside roi (left, top, right, bottom); hit
    tells whether the block's colour changes."""
    left, top, right, bottom = roi
    bx, by = F.expr("x div 2 * 2"), F.expr("y div 2 * 2")
    inside = (bx >= left) & (bx + 1 < min(right, width)) & (by >= top) & (by + 1 < min(bottom, height))
    rows = pixels.select("image", "y", "x", "v", (inside & F.col("v").between(low, high)).alias("on"))
    block = Window.partitionBy("image", F.expr("y div 2"), F.expr("x div 2"))
    return rows.select("image", "y", "x", F.when(F.col("on"), to).otherwise(F.col("v")).alias("v"), F.max("on").over(block).alias("hit"))


def outlined(pixels: DataFrame, bounds: tuple[int, int, int, int], to: int, thickness: int = 2) -> DataFrame:
    """Pixels on the inner edge of bounds (left, top, right, bottom), thickness wide, get the value to."""
    left, top, right, bottom = bounds
    inside = F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)
    deep = F.col("x").between(left + thickness, right - 1 - thickness) & F.col("y").between(top + thickness, bottom - 1 - thickness)
    return pixels.select("image", "y", "x", F.when(inside & ~deep, to).otherwise(F.col("v")).alias("v"))


def from_rgb(r, g, b):
    """struct<y, u, v> of a colour whose parts are from 0 to 1."""
    byte = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)
    parts = [byte(c) for c in (r, g, b)]
    value = lambda w: F.least(F.greatest(F.floor(sum((p * k for p, k in zip(parts, w)), F.lit(w[3])) + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return F.struct(value(TO_Y).alias("y"), value(TO_U).alias("u"), value(TO_V).alias("v"))
