"""Packed masks and two-pass distances against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import arrays as A
from framewright.operators import bitmasks as B
from framewright.operators import kernels as K


def unpacked(lines, width):
    return np.array([[bool((line[x // 64] >> (x % 64)) & 1) for x in range(width)] for line in lines])


def random_masks(width, height, n=6, share=0.2, seed=1):
    r = np.random.default_rng(seed)
    masks = [r.random((height, width)) < share for _ in range(n)]
    masks[0][:] = False
    masks[1][:] = True
    masks[2][:] = False
    masks[2][height // 2, [0, width - 1, min(63, width - 1), min(64, width - 1)]] = True
    return masks


def lines_of(spark, masks):
    rows = [(i, y, [200 if v else 7 for v in line.tolist()]) for i, m in enumerate(masks) for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "image long, y int, line array<int>")


@pytest.mark.parametrize("width", [1, 20, 63, 64, 65, 128, 200])
def test_words_and_dilation(spark, width):
    masks = random_masks(width, 5)
    lines = lines_of(spark, masks).select("image", "y", F.lit(0).alias("x0"), F.posexplode(B.band_words(F.col("line"), width, 180, 220)).alias("w", "word"))
    parts = lines.select("image", "y", (F.col("w") * 64).alias("x0"), F.array("word").alias("part"))
    for radius in (0, 2):
        rows = B.images(parts, width, 5).select("image", "bits", B.dilated(F.col("bits"), width, radius).alias("wide")).collect()
        assert len(rows) == len(masks)
        for r in rows:
            m = masks[r.image]
            assert (unpacked(r.bits, width) == m).all()
            assert (unpacked(r.wide, width) == K.spread(m, radius)).all(), (width, radius, r.image)
            tail = [line[-1] & ~((1 << (width % 64)) - 1) if width % 64 else 0 for line in r.wide]
            assert not any(tail)


def test_cover_is_that_of_the_kernel(spark):
    masks = random_masks(70, 6, 8, 0.3, 4)
    masks.append(masks[-1].copy())
    masks.append(np.roll(masks[-1], 1, axis=1))
    parts = lines_of(spark, masks).select("image", "y", F.posexplode(B.band_words(F.col("line"), 70, 180, 220)).alias("w", "word"))
    got = B.cover_of_neighbours(B.images(parts.select("image", "y", (F.col("w") * 64).alias("x0"), F.array("word").alias("part")), 70, 6), 70).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, i + 1) for i in range(len(masks) - 1)]
    for r in got:
        similarity, same = K.cover_compare(*(K.Cover(m, K.spread(m, 2)) for m in (masks[r.a], masks[r.b])))
        assert r.similarity == pytest.approx(similarity, abs=1e-6) and r.same == same


def test_missing_lines_nulls_and_no_images(spark):
    rows = [(3, 1, [200, None, 7, 200]), (3, 9, [200]), (4, 0, []), (7, 0, [200] * 90)]
    lines = spark.createDataFrame(rows, "image long, y int, line array<int>").select("image", "y", F.lit(0).alias("x0"), B.band_words(F.col("line"), 4, 180, 220).alias("part"))
    got = {r.image: unpacked(r.bits, 4).astype(int).tolist() for r in B.images(lines, 4, 3).collect()}
    assert got == {3: [[0] * 4, [1, 0, 0, 1], [0] * 4], 4: [[0] * 4] * 3, 7: [[1] * 4, [0] * 4, [0] * 4]}
    assert B.cover_of_neighbours(B.images(lines, 4, 3), 4).select("a", "b", "miss").collect() == [(3, 4, 2)]
    assert B.images(lines.limit(0), 4, 3).collect() == []


def test_one_scan_and_two_exchanges(spark, sf):
    from framewright.plans import pixels as Q

    plan = Q.QUERIES["packed_cover"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan
    assert Q.QUERIES["bitset_compare"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_two_passes_give_the_octile_distance():
    r = np.random.default_rng(2)
    for h, w, share in ((1, 1, 1.0), (1, 9, 0.2), (9, 1, 0.2), (13, 17, 0.02), (13, 17, 0.5), (30, 40, 0.003)):
        mask = r.random((h, w)) < share
        got = K.octile_distance(mask)
        ys, xs = np.nonzero(mask)
        if not len(ys):
            assert np.isinf(got).all()
            continue
        dy, dx = abs(np.arange(h)[:, None, None] - ys), abs(np.arange(w)[None, :, None] - xs)
        want = (np.maximum(dy, dx) + (np.sqrt(2) - 1) * np.minimum(dy, dx)).min(axis=2)
        assert np.allclose(got, want, atol=1e-9)


def test_distances_of_lines(spark):
    rows = [(1, 0, [False, False, False]), (1, 2, [True, False]), (2, 0, [False, None]), (5, 1, [])]
    lines = spark.createDataFrame(rows, "image long, y int, mask array<boolean>")
    got = sorted((tuple(r) for r in A.distances(lines).collect()), key=repr)
    root = 2**0.5
    assert [g[:3] for g in got] == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 2, 0), (1, 2, 1), (2, 0, 0), (2, 0, 1)]
    assert [g[3] for g in got] == [pytest.approx(x) if x is not None else None for x in (2, 1 + root, 2 * root, 0, 1, None, None)]
