"""The flow over planes against a plain simulator that keeps everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import detect as D
from framewright.operators import kernels as K
from framewright.operators import lifecycle as L
from framewright.operators import recognise as R
from framewright.operators.tracking import Tracker
from framewright.plans import planes as Q
from framewright.sources import planes as P

from .test_lifecycle import COLUMNS, FRAME, made_up, plain

NS = Q.FRAME_NS


@pytest.fixture(scope="module")
def videos(spark, sf):
    """video_id -> its planes in order."""
    out = {}
    for r in D.titled(spark.read.parquet(f"{sf}/embeddings.parquet")).select("video_id", "frame_index", "y_plane").collect():
        out.setdefault(r.video_id, {})[r.frame_index] = np.frombuffer(r.y_plane, np.uint8).reshape(Q.HEIGHT, Q.WIDTH)
    return {v: [p[i] for i in range(len(p))] for v, p in out.items()}


def sampled(n):
    """Seven a second, and the last frame."""
    hit, second, used = [], None, 0
    for i in range(n):
        now, part = divmod(i * NS, 10**9)
        if now != second:
            second, used = now, 0
        passed = sum(part / 1e9 + 1e-6 >= k / 7 for k in range(7))
        hit.append(passed > used or i == n - 1)
        used = max(used, passed)
    return hit


def simulated(videos, kind):
    features, compare = K.COMPARATORS[kind]
    rows = []
    for v, planes in videos.items():
        tracker = Tracker()
        for i, hit in enumerate(sampled(len(planes))):
            regions = []
            if hit:
                for x, y, w, h, _ in K.detect_projection(planes[i]):
                    a, c = max(x - 5, 0), max(y - 5, 0)
                    box = (a / Q.WIDTH, c / Q.HEIGHT, (min(x + w + 5, Q.WIDTH) - a) / Q.WIDTH, (min(y + h + 5, Q.HEIGHT) - c) / Q.HEIGHT)
                    regions += [(k, f"region-{k}", *map(float, b)) for k, b in tracker.add(i, tuple(map(np.float32, box)))]
            rows.append((v, i, i * NS, planes[i], hit, sorted(regions), i == len(planes) - 1))

    def read(frame, region):
        x0, y0, x1, y1 = K.roi_pixels_never_empty(Q.WIDTH, Q.HEIGHT, region[2:])
        return features(frame[3][y0:y1, x0:x1], 230, 12)

    return plain(rows, lambda a, b: a is not None and b is not None and compare(a, b)[1], read)


def test_flow_is_that_of_the_simulator(spark, sf, videos):
    got = Q.QUERIES["plane_lifecycles"](spark, sf).collect()
    want = simulated(videos, "bitset-cover")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == want
    assert len(want) > 300 and any(w[3] < w[2] for w in want) and any(w[6] > w[5] for w in want)  # both ends move
    by_video = {}
    for r in sorted(got, key=lambda r: r.place):
        by_video.setdefault(r.video_id, []).append(r)
    for rows in by_video.values():
        assert [r.place for r in rows] == list(range(len(rows))) and [r.closed_at for r in rows] == sorted(r.closed_at for r in rows)


def test_chamfer_flow(spark, sf, videos):
    some = {v: videos[v] for v in sorted(videos)[:6]}
    got = Q.QUERIES["plane_lifecycles_chamfer"](spark, sf).where(F.col("video_id").isin(list(some))).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == simulated(some, "sparse-chamfer")


def test_texts_are_read_in_the_right_crops(spark, sf, videos):
    read, n = R.bar_reader(), 0
    for r in Q.QUERIES["plane_texts"](spark, sf).collect():
        plane = videos[r.video_id][r.end_frame]
        vec = r.video_id * 20 + r.end_frame // D.TITLE_FRAMES
        rows, columns = np.nonzero(plane >= 230)
        assert len(rows), vec  # the frame that represents a segment shows something
        n += r.text != ""
        assert r.text in {"", *(t for margin in range(8) for t, _ in read(_cut(plane, rows, columns, margin)))} or len(r.text) == 4
    assert n > 50


def _cut(plane, rows, columns, margin):
    y0, y1, x0, x1 = max(rows.min() - margin, 0), rows.max() + 1 + margin, max(columns.min() - margin, 0), columns.max() + 1 + margin
    crop = plane[y0:y1, x0:x1]
    return {"crop": crop.tobytes(), "crop_width": crop.shape[1]}


def test_subtitles(spark, sf):
    rows = Q.QUERIES["plane_subtitles"](spark, sf).orderBy("video_id", "number").collect()
    assert len(rows) > 50 and all(r.end_ns > r.start_ns and r.texts for r in rows)
    for a, b in zip(rows, rows[1:]):
        assert b.video_id != a.video_id or (b.number == a.number + 1 and b.start_ns >= a.start_ns)


def test_values_in_a_store(spark):
    """The same rows from one pass and from fetched frames, null times and long gaps included."""
    rows = [r for r in made_up(9, 4, 160) if r[0] is not None]
    frames = spark.createDataFrame(rows, FRAME)
    comparator = L.value_comparator(10.0)
    regions = frames.select("video_id", "frame_index", F.explode("regions").alias("r")).select("video_id", "frame_index", "r.*")
    got = L.plane_lifecycles(frames.drop("regions"), regions, P.stored(frames.select("video_id", "frame_index", "value"), 5), comparator)
    names = got.columns
    want = L.lifecycles(frames, comparator).select(*names)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 40


def test_planes_stay_in_place(spark, sf):
    """A fetch moves wanted rows to the buckets, never planes."""
    planes = P.stored(D.titled(spark.read.parquet(f"{sf}/embeddings.parquet")), 6)
    wanted = planes.where("frame_index % 50 = 3").select("video_id", "frame_index", *[F.lit(v).alias(c) for c, v in zip(("x", "y", "width", "height"), (0.1, 0.4, 0.8, 0.5))])
    wanted = P.kept(wanted, "wanted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.fetched(wanted, planes, L.plane_comparator())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 6 out of 6" in plan
        above = plan[: plan.index("Bucketed: true")]
        assert "Sort" not in above and "ShuffledHashJoin" in above and "Exchange" not in above.split("ShuffledHashJoin")[1].split("FileScan")[0]
        assert out.count() == wanted.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_pack(spark):
    mask = np.random.default_rng(1).random((7, 13)) < 0.4
    got = P.unpacked(P.packed(K.Cover(mask, ~mask)))
    assert (got.mask == mask).all() and (got.wide == ~mask).all()
    assert P.unpacked(P.packed(None)) is None and P.unpacked(P.packed(2.5)) == 2.5
