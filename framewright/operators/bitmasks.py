"""Masks as words: a row of pixels is an array of longs, bit i of word w being pixel 64 w + i. Everything is a Catalyst
expression, so that a row per line of pixels stands for a row per pixel, and one long for 64 of them.

An image is array<array<bigint>>, its lines from top to bottom. Bits beyond the width are 0 in all results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def words(n: int) -> int:
    return -(-n // BITS)


def _left(word: Column, by: int) -> Column:
    return F.call_function("shiftleft", word, F.lit(by))


def _right(word: Column, by: int) -> Column:
    return F.call_function("shiftrightunsigned", word, F.lit(by))


def _none(n: int) -> Column:
    return F.array(*[F.lit(0).cast("long")] * n)


def band_words(values: Column, width: int, low: int, high: int) -> Column:
    """The words of a line whose values lie between low and high. Missing and null values are outside."""
    inside = lambda w, i: F.coalesce(F.get(values, w * BITS + i).between(low, high), F.lit(False)) & (w * BITS + i < width)
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    word = lambda w: F.aggregate(bits, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(inside(w, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.transform(F.sequence(F.lit(0), F.lit(words(width) - 1)), word)


def widened(line: Column, width: int, radius: int) -> Column:
    """The pixels within radius columns of a set one: shifts by each distance, with the bits that cross into the neighbouring words."""
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be below a word")
    zero = F.lit(0).cast("long")
    edge = F.lit((1 << width % BITS) - 1).cast("long") if width % BITS else F.lit(-1).cast("long")

    def word(x: Column, i: Column) -> Column:
        before, after = (F.coalesce(F.get(line, i + k), zero) for k in (-1, 1))
        out = x
        for k in range(1, radius + 1):
            out = out.bitwiseOR(_left(x, k)).bitwiseOR(_right(x, k)).bitwiseOR(_right(before, BITS - k)).bitwiseOR(_left(after, BITS - k))
        return out.bitwiseAND(F.when(i == words(width) - 1, edge).otherwise(F.lit(-1).cast("long")))

    return F.transform(line, word)


def either(a: Column, b: Column) -> Column:
    """The pixels of two lines of one width together; a missing line has none."""
    zero = F.lit(0).cast("long")
    return F.zip_with(F.coalesce(a, F.array().cast("array<bigint>")), F.coalesce(b, F.array().cast("array<bigint>")), lambda x, y: F.coalesce(x, zero).bitwiseOR(F.coalesce(y, zero)))


def dilated(image: Column, width: int, radius: int) -> Column:
    """The pixels within radius rows and columns of a set one."""
    wide = F.transform(image, lambda line: widened(line, width, radius))

    def all_near(lines: Column) -> Column:
        def near(line: Column, i: Column) -> Column:
            out = line
            for k in range(1, radius + 1):
                out = either(either(out, F.get(lines, i - k)), F.get(lines, i + k))
            return out

        return F.transform(lines, near)

    return F.aggregate(F.array().cast("array<int>"), wide, lambda x, _: x, all_near)  # names the widened lines


def counted(a: Column, b: Column, of) -> Column:
    """The pixels of of(word of a, word of b) in two images of one shape."""
    lines = F.zip_with(a, b, lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(of(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda s, n: s + n)


def images(lines: DataFrame, width: int, height: int) -> DataFrame:
    """image and bits, from lines (image, y, x0, part): the words of a line's part that begins at pixel x0, a multiple of 64.
    Parts that are missing are empty."""
    parts = F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("y").cast("int").alias("y"), F.expr(f"cast(x0 div {BITS} as int)").alias("w")), "part")))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(height - 1)),
        lambda y: F.transform(F.sequence(F.lit(0), F.lit(words(width) - 1)), lambda w: F.coalesce(F.get(F.element_at("parts", F.struct(y.alias("y"), w.alias("w"))), F.lit(0)), F.lit(0).cast("long"))),
    )
    return lines.groupBy("image").agg(parts.alias("parts")).select("image", grid.alias("bits"))


def cover_of_neighbours(masks: DataFrame, width: int, radius: int = 2, threshold: float = 0.1) -> DataFrame:
    """a, b, miss, pixels, similarity, same for each image and the next by number, from masks (image, bits): set pixels of one
    outside the other's dilation, over those set in either. Each image goes to its two pairs, so no image is read twice
    and no order over all images is needed."""
    made = masks.select("image", "bits", dilated(F.col("bits"), width, radius).alias("wide"))
    sides = made.select(F.explode(F.array(F.col("image") - 1, F.col("image"))).alias("a"), F.struct("image", "bits", "wide").alias("own"))
    pairs = sides.groupBy("a").agg(F.sort_array(F.collect_list("own")).alias("both")).where(F.size("both") == 2)
    p, q = F.col("both")[0], F.col("both")[1]
    outside = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    sums = pairs.select("a", (F.col("a") + 1).alias("b"), (counted(p["bits"], q["wide"], outside) + counted(q["bits"], p["wide"], outside)).alias("miss"), counted(p["bits"], q["bits"], lambda x, y: x.bitwiseOR(y)).alias("pixels"))
    part = F.when(F.col("pixels") > 0, F.col("miss") / F.col("pixels")).otherwise(0.0)
    return sums.select("a", "b", "miss", "pixels", F.greatest(F.lit(0.0), 1 - part).alias("similarity"), (part <= threshold).alias("same"))
