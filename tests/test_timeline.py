import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import settings
from framewright.functions import geometry as G
from framewright.functions import text as T
from framewright.operators import sampling as S
from framewright.operators import segments as C
from framewright.operators import tracking as R
from framewright.sources import files, srt
from framewright.sources.datasource import MockFrames

MS = 1_000_000


def merged(spark, cues, **more):
    rows = [(0, i, s * MS, e * MS, i, 0.0, t) for i, (s, e, t) in enumerate(cues)]
    out = C.merged_cues(spark.createDataFrame(rows, "video_id long, ord long, start_ns long, end_ns long, start_frame long, center double, text string"), **more)
    return [(r.start_ns // MS, r.end_ns // MS, [x.text for x in r.lines]) for r in out.orderBy("id").collect()]


def test_merge_rules(spark):
    assert merged(spark, [(0, 1000, "a"), (1120, 2000, "a")]) == [(0, 2000, ["a"])]
    assert len(merged(spark, [(0, 1000, "a"), (1121, 2000, "a")])) == 2
    assert len(merged(spark, [(0, 1000, "a"), (1060, 2000, "b")])) == 2
    assert merged(spark, [(0, 1000, "a"), (1000, 2000, "b")]) == [(0, 2000, ["a", "b"])]


def test_text(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(T.srt_time(F.lit(3_661_001_999_000))) == "01:01:01,001"
    assert show(T.srt_time(F.lit(360_000_000_000_000))) == "100:00:00,000"
    assert show(T.normalised_text(F.lit("  a \t b\n\n c "))) == "a b\nc"
    assert show(T.normalised_text(F.lit("a  b\r\n"))) == "a b"
    lines = F.array(*[F.struct(F.lit(c).alias("center"), F.lit(t).alias("text")) for c, t in ((30.0, "b"), (10.0, "a"), (20.0, " a"))])
    assert show(T.ordered_lines(lines)) == ["a", "b"]
    assert [show(T.display_time(F.lit(x))) for x in (0.0, -1.0, float("nan"), 61_234.5, 3_600_000.0)] == ["0:00.000"] * 3 + ["1:01.235", "1:00:00.000"]


def test_boxes(spark):
    one = spark.range(1)
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    r = one.select(G.recogniser_region(box(-0.2, 0.5, 1.4, 0.8), 100.0, 50.0).alias("r")).first().r
    assert (r.x, r.y) == (0.0, 25.0) and abs(r.width - 100) <= 2e-3 and abs(r.height - 25) <= 2e-3
    valid = lambda w, h, ms: one.select(G.valid_region(box(0, 0, w / 1000, h / 1000), F.lit(ms * MS), 1000, 1000).alias("v")).first().v
    assert [valid(500, 500, 199), valid(500, 500, 200), valid(500, 14, 900), valid(500, 15, 900)] == [False, True, False, True]


def test_sampler_against_a_sequential_one(spark):
    r, rows, want = random.Random(5), [], []
    for video in range(6):
        t, second, used = 0, None, 0
        for i in range(120):
            t += r.choice((0, 10, 40, 90, 400)) * MS
            s, part = divmod(t, 10**9)
            if s != second:
                second, used = s, 0
            hit = False
            while used < 7 and part / 1e9 + 1e-6 >= used / 7:
                hit, used = True, used + 1
            rows.append((video, i, t))
            if hit:
                want.append((video, i))
    out = S.with_sampled(spark.createDataFrame(rows, "video_id long, frame_index long, pts_ns long")).where("sampled")
    assert sorted((x.video_id, x.frame_index) for x in out.collect()) == want
    tail = S.with_sampled(spark.createDataFrame([(0, 0, 0), (0, 1, 10 * MS)], "video_id long, frame_index long, pts_ns long"), 1, tail=True)
    assert tail.where("sampled").count() == 2


def test_history_never_grows_back(spark):
    caps = [24.0, 3.0, 10.0, 10.0, 2.5, 30.0]
    rows = [(0, i, c) for i, c in enumerate(caps)]
    got = [r.length for r in S.history_lengths(spark.createDataFrame(rows, "video_id long, frame_index long, fps double")).orderBy("frame_index").collect()]
    pool, want = 0, []
    for c in caps:
        pool = min(pool, int(np.ceil(c))) + 1
        pool = min(pool, int(np.ceil(c)))
        want.append(pool)
    assert got == want


def test_tracker():
    f = np.float32
    box = lambda *v: tuple(map(f, v))
    t = R.Tracker()
    assert t.add(0, box(0.1, 0.1, 0.2, 0.2))[0][0] == 0
    assert t.add(1, box(0.12, 0.1, 0.2, 0.2))[0][0] == 0
    assert t.add(1, box(0.12, 0.1, 0.2, 0.2))[0][0] == 1  # the first is taken in this frame
    grown = t.add(2, box(0.2, 0.1, 0.4, 0.2))
    assert [i for i, _ in grown] == [2, 0] and np.isclose(grown[0][1][2], 0.08, atol=1e-6)
    assert t.add(3, box(0.9, 0.9, 0.05, 0.05))[0][0] == 3


def test_tracking_runs_by_video(spark):
    rows = [(v, i, 0, 0.1 + i * 0.01, 0.1, 0.2, 0.2) for v in (1, 2) for i in range(5)]
    out = R.tracked(spark.createDataFrame(rows, "video_id long, frame_index long, ord int, x double, y double, width double, height double")).collect()
    assert len(out) == 10 and {r.region_id for r in out} == {0} and {r.label for r in out} == {"region-0"}


def test_srt(spark, tmp_path):
    rows = [(0, 0, 0, 1000 * MS, 0, [(0.0, "a")]), (0, 1, 2000 * MS, 3000 * MS, 5, [(0.0, " ")]), (0, 2, 4000 * MS, 5000 * MS, 9, [(2.0, "c"), (1.0, "b")])]
    subs = spark.createDataFrame(rows, "video_id long, id long, start_ns long, end_ns long, start_frame long, lines array<struct<center double, text string>>")
    text = srt.rendered(subs).first().srt
    assert text == "1\n00:00:00,000 --> 00:00:01,000\na\n\n3\n00:00:04,000 --> 00:00:05,000\nb\nc\n"
    srt.write(subs, str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("video_id=0/*.txt")).read_text() == text


def test_data_source(spark):
    spark.dataSource.register(MockFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    frames = spark.read.format("mock_frames").options(width=64, height=36).load()
    first = frames.orderBy("frame_index").first()
    assert frames.count() == 120 and len(first.y_plane) == 64 * 36 and len(first.uv_plane) == 64 * 18 and first.y_plane[64] == 1
    assert frames.where("frame_index >= 10").agg(F.min("frame_index")).first()[0] == 10
    assert spark.read.format("mock_frames").options(width=8, height=8, start_frame=200).load().count() == 0


def test_files(spark, tmp_path):
    w, h = 1920, 824
    (tmp_path / "00007.yuv").write_bytes(bytes(w * h))
    r = files.raw_frames(spark, str(tmp_path)).first()
    assert (r.frame_index, r.width, r.height, len(r.uv_plane), r.uv_plane[0]) == (7, w, h, w * h // 2, 128)
    (tmp_path / "a.json").write_text(json.dumps({"frame": {"width": 100, "height": 50}, "roi": {"x": 0, "y": 0.5, "width": 1, "height": 0.5}, "regions": []}))
    (tmp_path / "b.json").write_text(json.dumps({"frame": {"width": 100, "height": 50}, "luma_band": {"target": 9, "delta": 1}, "regions": [{"index": 0, "x": 10, "y": 5, "width": 20, "height": 10, "score": 1}]}))
    a, b = files.region_reports(spark, str(tmp_path)).orderBy("path").collect()
    assert (a.luma_band.target, a.rois[0].y) == (235, 0.5) and (b.luma_band.delta, b.rois[0].x, b.rois[0].height) == (1, 0.1, 0.2)


def test_settings(tmp_path):
    assert settings.parse_roi("0.1,0.2,0.3,0.4") == (0.1, 0.2, 0.3, 0.4) and settings.parse_roi("0.1 0.2 0.5 0.6")[3] == 0.6
    for bad in ("0.1 0.2 0.3", "0.1", "-0.1 0 1 1"):
        with pytest.raises(ValueError):
            settings.parse_roi(bad)
    assert settings.valid_roi((0.2, 0.2, 0.0, 0.5)) == settings.FULL
    assert settings.valid_roi((0.9, 0.1, 0.5, 0.95)) == pytest.approx((0.9, 0.1, 0.1, 0.9))
    (tmp_path / "c.toml").write_text("target = 200\ndelta = 3\n")
    s = settings.load({"delta": 9}, str(tmp_path / "c.toml"))
    assert (s.target, s.delta, s.samples_per_second) == (200, 9, 7)


def stream(spark, tmp_path, rows, schema, made):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = made(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_tracker_against_a_plain_one():
    r = np.random.default_rng(2)
    t, held, used = R.Tracker(), [], set()
    for frame in range(40):
        used.clear()
        for _ in range(3):
            box = tuple(np.float32(x) for x in (*r.random(2) * 0.7, *(r.random(2) * 0.3 + 0.02)))
            best, top = None, np.float32(0)
            for i, h in enumerate(held):
                c = R.overlap(box, h)
                x = R.box_area(c) / (R.box_area(box) + R.box_area(h) - R.box_area(c)) if c else np.float32(0)
                if i not in used and x > top and x >= np.float32(0.05):
                    best, top = i, x
            want = []
            if best is None:
                held.append(box)
                best = len(held) - 1
            else:
                old, held[best] = held[best], box
                left = R.remainder(old, box) if R.box_area(box) > R.box_area(old) else None
                if left is not None:
                    held.append(left)
                    used.add(len(held) - 1)
                    want.append((len(held) - 1, left))
            used.add(best)
            assert t.add(frame, box) == [*want, (best, box)]


def test_stream_tracks_across_batches(spark, tmp_path):
    from framewright.streaming import pipeline as P

    r = random.Random(3)
    rows = [(0, i, k, r.random() * 0.5, r.random() * 0.5, 0.3, 0.3 + r.random() / 9) for i in range(20) for k in range(2)]
    schema = "video_id long, frame_index long, ord int, x float, y float, width float, height float"
    got = stream(spark, tmp_path, [rows[:18], rows[18:]], schema, P.tracked_stream)
    want = R.tracked(spark.createDataFrame(rows, schema)).drop("label")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_streams_match_batches(spark, tmp_path):
    from framewright.streaming import pipeline as P

    r = random.Random(8)
    cues, t = [], 0
    for i in range(60):
        t += r.choice((0, 50, 200, 900))
        cues.append((0, i, t * MS, (t + r.choice((100, 300))) * MS, i, 0.0, r.choice("ab")))
    schema = "video_id long, ord long, start_ns long, end_ns long, start_frame long, center double, text string"
    got = stream(spark, tmp_path, [cues[:25], cues[25:]], schema, P.merged_stream)
    want = C.merged_cues(spark.createDataFrame(cues, schema), changelog=True).withColumn("texts", F.array_join(F.transform("lines", lambda x: x["text"]), "|")).drop("lines")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_default_region(spark):
    from framewright.functions import geometry as G

    assert tuple(spark.range(1).select(G.default_region().alias("r")).first().r) == (0.2, 0.8, 0.6, 0.2)
