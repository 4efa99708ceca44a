import numpy as np
import pytest

from framewright.operators import detect as D
from framewright.operators import kernels as K


def picture(h, w, bg, *boxes):
    a = np.full((h, w), bg, np.uint8)
    for x, y, bw, bh, v in boxes:
        a[y : y + bh, x : x + bw] = v
    return a


def test_gaps():
    assert K.bridge(np.array([[1, 0, 0, 1], [0, 0, 0, 0]], bool), 2).tolist() == [[True] * 4, [False] * 4]
    assert K.bridge(np.array([[1, 0, 1]], bool), 1).all()
    assert K.bridge(np.array([[1, 0, 0, 1]], bool), 1).tolist() == [[True, False, False, True]]


def cover(a, b, target, delta):
    return K.cover_compare(K.cover_features(a, target, delta), K.cover_features(b, target, delta))


def test_cover():
    a = picture(12, 16, 5, (3, 4, 10, 4, 205))
    similarity, same = cover(a, a, 200, 15)
    assert same and similarity > 0.95
    similarity, same = cover(picture(14, 24, 5, (4, 5, 14, 4, 220)), picture(14, 24, 5, (8, 7, 14, 4, 220)), 210, 20)
    assert not same and similarity < 0.9
    assert cover(a, a[:, :-1], 200, 15) == (0.0, False)
    assert cover(picture(4, 4, 0), picture(4, 4, 0), 200, 15) == (1.0, True)


def chamfer(a, b, target, delta):
    return K.chamfer_compare(K.chamfer_features(a, target, delta), K.chamfer_features(b, target, delta))


def test_chamfer():
    a = picture(12, 12, 30, (2, 3, 8, 6, 210))
    similarity, same = chamfer(a, a, 210, 20)
    assert same and similarity >= 0.9
    base = picture(12, 20, 30, (3, 4, 12, 4, 230))
    assert chamfer(base, picture(12, 20, 30, (5, 5, 12, 4, 230)), 220, 25)[1]
    assert not chamfer(base, picture(12, 20, 30, (3, 5, 12, 2, 230)), 220, 25)[1]
    assert K.chamfer_features(picture(3, 4, 30), 220, 25) is None
    assert K.chamfer_features(picture(12, 20, 30), 220, 25) is None


def test_components_match_a_flood_fill():
    r = np.random.default_rng(3)
    for _ in range(20):
        m = r.random((12, 17)) < 0.45
        left, want = {tuple(p) for p in np.argwhere(m)}, []
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if p in left:
                        left.remove(p)
                        todo.append(p)
            ys, xs = zip(*part)
            want.append((len(part), min(xs), max(xs), min(ys), max(ys)))
        assert sorted(K.connected(m)) == sorted(want)


def test_detectors_find_the_rectangle():
    a = picture(360, 640, 40, (80, 240, 300, 40, 235))
    assert [r[:4] for r in K.detect_projection(a)] == [(80, 240, 300, 40)]
    assert [r[:4] for r in K.detect_integral(a)] == [(80, 240, 300, 40)]
    assert K.detect_projection(picture(360, 640, 40)) == [] == K.detect_integral(picture(360, 640, 40))


def test_planes():
    with pytest.raises(ValueError):
        K.plane(b"abc", 2, 2, 2)
    with pytest.raises(ValueError):
        K.roi_pixels(10, 10, (0.5, 0.5, 0.0, 0.0))
    assert K.roi_pixels(100, 50, (0.25, 0.5, 0.5, 0.4)) == (25, 25, 75, 45)


def test_detected_frames(spark):
    out = D.detected(D.drawn_frames(spark, 30, 320, 180, ((40, 100, 200, 30, 10, 19),)), "projection-band")
    rows = out.orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(10, 20))
    assert {(r.x, r.y, r.width, r.height) for r in rows} == {(35.0, 95.0, 210.0, 40.0)}


def test_auto_takes_the_first_detector_that_can_be_made():
    setting = D.Setting(640, 360, 640)
    assert D.preflight("auto", setting) == "projection-band" and D.preflight("integral-band", setting) == "integral-band"

    def never(s):
        raise D.Unsupported("not on this machine")

    assert D.preflight("auto", setting, D.MAKERS | {"projection-band": never}) == "integral-band"
    with pytest.raises(D.Unsupported, match="projection-band: not on.*integral-band: unknown"):
        D.preflight("auto", setting, {"projection-band": never})
    for bad in (D.Setting(0, 4, 4), D.Setting(8, 4, 4), D.Setting(8, 4, 8, 300), D.Setting(8, 4, 8, roi=(0.5, 0.5, 0.0, 0.0))):
        with pytest.raises(D.Unsupported):
            D.preflight("auto", bad)


def test_detectors_are_kept_by_setting(spark):
    D.built.cache_clear()
    a = picture(360, 640, 40, (80, 240, 300, 40, 235))
    for _ in range(3):
        assert [r[:4] for r in D.built("auto", D.Setting(640, 360, 640))(a.tobytes())] == [(80, 240, 300, 40)]
    D.built("auto", D.Setting(640, 360, 640, delta=5))
    assert (D.built.cache_info().misses, D.built.cache_info().hits) == (2, 2)
    with pytest.raises(D.Unsupported):
        D.detected(spark.range(1), "macos")


def test_source_falls_through_until_a_frame_is_read(spark):
    from pyspark.sql import functions as F

    from framewright.sources import backends as B

    broken = lambda c: spark.range(3).select(F.raise_error(F.lit("cannot decode")).cast("long").alias("id"))
    readers = {"first": broken, "second": lambda c: spark.range(3), "third": lambda c: spark.range(9)}
    assert B.opened(B.SourceConfig(), readers)[0] == "first"
    name, frames = B.opened(B.SourceConfig(), readers, probe=True)
    assert name == "second" and frames.count() == 3
    assert B.opened(B.SourceConfig(), {"empty": lambda c: spark.range(0)}, probe=True)[1].count() == 0
    with pytest.raises(B.Unavailable, match="cannot decode"):
        B.opened(B.SourceConfig(), {"first": broken}, probe=True)


def test_averages_and_containers(spark):
    from pyspark.sql import functions as F

    from framewright.operators import metrics as M
    from framewright.sources import frames as V

    rows = spark.createDataFrame([(1, 10.0, 2), (1, 5.0, 3), (2, 0.0, 0), (3, None, None)], "video_id int, total double, units int")
    assert {r.video_id: r.ms for r in rows.groupBy("video_id").agg(M.average_ms("total", "units").alias("ms")).collect()} == {1: 3.0, 2: 0.0, 3: 0.0}
    paths = spark.createDataFrame([("a/b.mp4",), ("c.MKV",), ("d.txt",), ("mp4",), (None,)], "path string")
    assert sorted(r.path for r in V.accepted_containers(paths).collect()) == ["a/b.mp4", "c.MKV"]
