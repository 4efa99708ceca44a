"""Chamfer features of all shifts at once; planes read where they lie in a batch."""

import numpy as np

from framewright.operators import kernels as K
from framewright.operators import lifecycle as L
from framewright.sources import planes as P


def test_all_shifts_at_once_are_each_alone():
    r = np.random.default_rng(3)
    points, target = r.integers(0, 20, (60, 2)), K.clipped_distance(r.random((18, 22)) < 0.1)
    costs, shares = K._one_way(points, target, K.SHIFTS)
    for i in range(len(K.SHIFTS)):
        cost, share = K._one_way(points, target, K.SHIFTS[i : i + 1])
        assert (costs[i], shares[i]) == (cost[0], share[0])
    edges = r.random((18, 22)) < 0.03
    ys, xs = np.nonzero(edges)
    near = [[min(16, min((y - b) ** 2 + (x - a) ** 2 for a, b in zip(xs, ys))) for x in range(22)] for y in range(18)]
    assert np.array_equal(K.clipped_distance(edges), np.sqrt(np.array(near, np.float32)))


def test_planes_are_not_copied_out_of_their_batch(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 3)
    planes = spark.createDataFrame([(0, i, bytearray([i] * 4)) for i in range(10)] + [(0, 10, None)], "video_id long, frame_index long, y_plane binary")
    wanted = planes.selectExpr("video_id", "frame_index", "0D AS x", "0D AS y", "1D AS width", "1D AS height")
    look = L.Comparator(lambda row, roi: None if row.y_plane is None else (type(row.y_plane).__name__, bytes(row.y_plane)), None, ("y_plane",))
    got = {r.frame_index: P.unpacked(r.features) for r in P.fetched(wanted, planes, look).collect()}
    assert got == {**{i: ("Buffer", bytes([i] * 4)) for i in range(10)}, 10: None}
