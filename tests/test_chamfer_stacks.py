"""Chamfer features made in stacks, and comparisons, against plain loops; what equals the frame before it is asked once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import kernels as K
from framewright.operators import lifecycle as L
from framewright.sources import planes as P

F32 = np.float32


def pictures(n, seed=4):
    """Of a few sizes: noise, cells, thin lines; some show nothing, some are equal."""
    r, out = np.random.default_rng(seed), []
    for i in range(n):
        h, w = ((12, 20), (3, 30), (17, 9), (3, 5), (1, 16))[i % 5]
        y = [r.integers(180, 256, (h, w)), np.kron(r.random((h // 3 + 1, w // 4 + 1)) < 0.5, np.ones((3, 4)))[:h, :w] * 195 + 40, np.where(r.random((h, w)) < 0.1, 235, 40), np.full((h, w), 40)][i % 4]
        out.append(y.astype(np.uint8))
    return out + out[: n // 3]


def plain_edges(luma, target=230, delta=12):
    """Edges and mask, pixel by pixel."""
    h, w = luma.shape
    near = lambda m, y, x: [m[b][a] for b in range(max(y - 1, 0), min(y + 2, h)) for a in range(max(x - 1, 0), min(x + 2, w))]
    every = lambda m, f: [[f(near(m, y, x)) for x in range(w)] for y in range(h)]
    base = [[abs(int(v) - target) <= delta for v in line] for line in luma]
    thin = every(base, all)
    once = every(thin, any)
    mask = every(every(once, any) if once != thin else once, all)
    if sum(map(sum, mask)) * 10 < sum(map(sum, base)) or not any(map(any, mask)):
        mask = base
    v, mag = luma.astype(int), np.zeros((h, w))
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            p = v[y - 1 : y + 2, x - 1 : x + 2]
            mag[y, x] = abs(p[:, 2] @ [1, 2, 1] - p[:, 0] @ [1, 2, 1]) + abs(p[2] @ [1, 2, 1] - p[0] @ [1, 2, 1])
    found = [F32(mag[y, x]) for y in range(h) for x in range(w) if mask[y][x] and mag[y, x] > 0]
    bar = F32(0)
    if found:
        scale, counts = F32(255) / max(found), [0] * 256
        for m in found:
            counts[min(int(m * scale), 255)] += 1
        wanted = min(max(int(np.floor(F32(0.7) * F32(len(found)) + F32(0.5))), 1), len(found))
        bar = F32(next(i for i in range(256) if sum(counts[: i + 1]) >= wanted)) / scale
    return np.array([[mask[y][x] and mag[y, x] >= bar for x in range(w)] for y in range(h)]), sum(map(sum, mask))


def test_stacks_give_what_plain_loops_give(monkeypatch):
    monkeypatch.setattr(K, "LOOKED", 6000)
    monkeypatch.setattr(K, "STACKED", 700)
    lumas = pictures(60)
    got = K.chamfer_features_together(iter(lumas), 230, 12)
    assert len(got) == len(lumas) and sum(f is None for f in got) > 15
    for luma, f in zip(lumas, got):
        edges, area = plain_edges(luma)
        if luma.size < 16 or not edges.any():
            assert f is None
        else:
            assert np.array_equal(f.edges, edges) and f.stroke == F32(2 * area) / F32(edges.sum())
            step = 3 if edges[::3, ::3].any() else 1
            assert f.points.tolist() == [[x, y] for y in range(0, luma.shape[0], step) for x in range(0, luma.shape[1], step) if edges[y, x]][:400]


def plain_way(points, target, dx, dy):
    bins = [[] for _ in range(13)]
    for x, y in points + [dx, dy]:
        if 0 <= x < target.shape[1] and 0 <= y < target.shape[0]:
            d = min(target[y, x], F32(4))
            bins[min(int(np.floor(d * F32(3) + F32(0.5))), 12)].append(d)
    total = sum(map(len, bins))
    if not total:
        return np.inf, 0
    keep, held, cost = max(int(np.floor(F32(total) * F32(0.7) + F32(0.5))), 1), 0, F32(0)
    for b, own in enumerate(bins):
        if held + len(own) >= keep:
            cost += F32(keep - held) * F32(b / 3)
            break
        cost, held = cost + F32(sum(map(float, own))), held + len(own)
    return cost / F32(keep), F32(sum(d <= F32(1.5) for own in bins for d in own)) / F32(total)


def test_shifts_cost_what_plain_loops_say():
    r = np.random.default_rng(8)
    for size, reach, share in (((18, 22), 20, 0.1), ((9, 40), 60, 0.02), ((30, 5), 12, 0.5), ((4, 4), 90, 0.3), ((40, 40), 40, 0.003)):
        points, target = r.integers(0, reach, (70, 2)), K.clipped_distance(r.random(size) < share)
        costs, shares = K._one_way(points, target, K.SHIFTS)
        assert costs.dtype == shares.dtype == F32
        assert [(c, s) for c, s in zip(costs, shares)] == [plain_way(points, target, *shift) for shift in K.SHIFTS]


def test_features_travel_as_bits():
    luma = pictures(2)[1]
    f = K.chamfer_features(np.tile(luma, (3, 5)), 230, 12)
    data = P.packed(f)
    back = P.unpacked(data)
    assert len(data) < 700 < f.edges.size and back.area == f.area
    assert all(np.array_equal(getattr(back, c), getattr(f, c)) for c in ("edges", "points", "distance", "stroke", "diagonal"))


def test_frames_like_the_one_before_are_compared_once(spark):
    asked = []

    def same(a, b):
        asked.append((a, b))
        return abs(a - b) <= 1

    data = [None if v is None else P.packed(v) for v in (5.0, 5.0, 9.0, 9.0, None, 9.0, 6.0, 6.0)]
    shown = L.Shown(L.value_comparator(1)._replace(same=same), data[0])
    assert [shown.alike(d) for d in data] == [True, True, False, False, False, False, True, True]
    assert asked == [(5.0, 5.0), (5.0, 9.0), (5.0, 6.0)]
    shown.take(data[-1])
    assert [shown.alike(d) for d in (data[0], P.packed(7.0), P.packed(7.0))] == [True, True, True] and asked[3:] == [(6.0, 5.0), (6.0, 7.0)]


def test_equal_parts_of_planes_are_looked_at_once(spark, monkeypatch):
    """A fetch gives each plane's features, and hands them over together."""
    picture = np.full((12, 20), 40, np.uint8)
    picture[3:9, 4:15] = 235
    rows = [(0, i, 20, 12, 20, bytearray((picture if i % 3 else np.full((12, 20), 40, np.uint8)).tobytes())) for i in range(12)]
    planes = spark.createDataFrame(rows, "video_id long, frame_index long, width int, height int, y_stride int, y_plane binary")
    wanted = planes.selectExpr("video_id", "frame_index", "0D AS x", "0D AS y", "1D AS width", "1D AS height")
    look = L.plane_comparator("sparse-chamfer")
    assert look.together is not None and L.plane_comparator().together is None
    got = {r.frame_index: r.features for r in P.fetched(wanted, planes, look._replace(extract=None)).collect()}
    one = P.packed(K.chamfer_features(picture, 230, 12))
    assert got == {i: one if i % 3 else None for i in range(12)}
    stacks = []
    monkeypatch.setattr(K, "_stack_features", lambda v, *a, f=K._stack_features: (stacks.append(len(v)), f(v, *a))[1])
    K.chamfer_features_together([picture] * 7 + [picture + 1] * 2, 230, 12)
    assert stacks == [2]


def test_strokes_too_unlike_need_no_search(monkeypatch):
    thick, thin = np.full((30, 60), 40, np.uint8), np.full((30, 60), 40, np.uint8)
    thick[5:25, 5:55] = 235
    thin[14:16, 5:55] = 235
    a, b = (K.chamfer_features(y, 230, 12) for y in (thick, thin))
    r = np.random.default_rng(2)
    some = [f for f in K.chamfer_features_together(pictures(40), 230, 12) if f is not None]
    assert all(K.chamfer_same(x, y) == K.chamfer_compare(x, y)[1] for x in some[:12] for y in r.choice(some, 6))
    assert not K.chamfer_compare(a, b)[1] and not K.chamfer_same(a, None) and K.chamfer_same(a, a)
    monkeypatch.setattr(K, "_one_way", None)
    assert not L.plane_comparator("sparse-chamfer").same(a, b)


def test_gaps_are_bridged_and_dark_planes_passed_over(monkeypatch):
    r = np.random.default_rng(6)
    for i in range(120):
        mask, limit = r.random(r.integers(1, 30, 2)) < (0, 0.1, 0.5, 1)[i % 4], (0, 1, 3, 12)[i // 4 % 4]
        want = mask.copy()
        for line in want:
            set_ = np.flatnonzero(line)
            for a, b in zip(set_, set_[1:]):
                if b - a - 1 <= limit:
                    line[a:b] = True
        assert np.array_equal(K.bridge(mask, limit), want) and np.array_equal(K.bridge(mask.T.copy().T, limit), want)
    monkeypatch.setattr(K, "bridge", None)
    assert K.detect_projection(np.full((64, 128), 40, np.uint8)) == []


def test_only_the_lines_of_a_region_are_handed_over(spark):
    """Regions on, over and off the edges, of planes of several heights; a plane that is too short is told as before."""
    r, rows, wanted = np.random.default_rng(9), [], []
    for i in range(150):
        h, w = (1, 2, 7, 24, 64)[i % 5], (16, 33)[i % 2]
        rows.append((0, i, w, h, w + 3, bytearray(np.where(r.random((h, w + 3)) < 0.4, 235, 40).astype(np.uint8).tobytes())))
        y0, y1 = r.integers(-1, h + 2, 2) / h if i % 3 else r.random(2) * 1.4 - 0.2
        wanted.append((0, i, float(r.random() * 0.3), float(y0), 0.7, float(y1 - y0)))
    planes = spark.createDataFrame(rows, "video_id long, frame_index long, width int, height int, y_stride int, y_plane binary")
    wanted = spark.createDataFrame(wanted, "video_id long, frame_index long, x double, y double, width double, height double")
    look = L.plane_comparator("sparse-chamfer")
    got, want = ({x.frame_index: x.features for x in P.fetched(wanted, planes, c).collect()} for c in (look, look._replace(together=None, narrow=None)))
    assert got == want and len(got) == 150 and sum(v is not None for v in got.values()) > 40
    sent = planes.select(look.narrow(F.col, lambda c: F.lit({"y": 0.4, "height": 0.1}[c]))["y_plane"].alias("part"), "y_stride")
    assert sent.select(F.max(F.octet_length("part") / F.col("y_stride")).alias("n")).first().n < 12
    short = planes.withColumn("y_plane", F.expr("substring(y_plane, 1, 10)"))
    with pytest.raises(Exception, match="10 bytes for"):
        P.fetched(wanted, short, look).collect()
