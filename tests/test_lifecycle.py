import json
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import settings
from framewright.operators import detect as D
from framewright.operators import lifecycle as L
from framewright.operators import metrics as M
from framewright.operators.tracking import tracked
from framewright.sources import backends as B
from framewright.sources import files, srt
from framewright.streaming import pipeline as S

MS = 1_000_000
FRAME = "video_id long, frame_index long, pts_ns long, value double, sampled boolean, regions array<struct<region_id:long,label:string,x:double,y:double,width:double,height:double>>, last boolean"


def made_up(seed, videos=5, n=150):
    r, rows = random.Random(seed), []
    for video in [*range(videos), None]:
        value, on = 100.0, {}
        for i in range(n):
            value = max(0.0, value + r.choice((0, 1, -3, 8, -9, 40, -35)))
            for k in range(3):
                if r.random() < 0.2:
                    on[k] = not on.get(k, False)
            sampled = i % 4 == 0
            regions = [(k, f"region-{k}", 0.1 * k, 0.2, 0.3, 0.1) for k in range(3) if on.get(k)] if sampled else None
            rows.append((video, i, None if i % 17 == 5 else i * 40 * MS, value, sampled, regions, i == n - 1))
    return rows


def plain(rows, same, read=lambda frame, region: frame[3]):
    """A simulator that keeps everything: for each video all frames, and each region's whole story."""
    out = []
    for video in {r[0] for r in rows}:
        frames = sorted((r for r in rows if r[0] == video), key=lambda r: r[1])
        fps, last, sizes = None, None, []
        held: list = []
        for f in frames:
            if f[2] is not None:
                if last and f[2] > last[2]:
                    x = (f[1] - last[1]) / ((f[2] - last[2]) / 1e9)
                    fps = x if fps is None else 0.8 * fps + 0.2 * x
                last = f
            held = [*held, f][-(24 if fps is None else min(max(int(np.ceil(fps)), 1), 240)) :]
            sizes.append((list(held), fps))
        samples = [(f, *sizes[k]) for k, f in enumerate(frames) if f[4]]
        time = lambda f, rate, other: f[2] if f[2] is not None else int(f[1] / rate * 1e9) if rate else other
        alive: dict = {}
        for nth, (f, history, rate) in enumerate([*samples, (None, *samples[-1][1:])]):
            shown = {x[0]: (x, read(f, x)) for x in f[5] or ()} if f else {}
            shown = {k: (x, content) for k, (x, content) in shown.items() if content is not None}
            for k in sorted(set(alive) - set(shown)):
                ref, region, frame, ns, opened, start, begun = alive.pop(k)
                end, stamp = frame, ns
                for g in (g for g in history if g[1] > frame):
                    if same(ref, read(g, region)):
                        ref, end, stamp = read(g, region), g[1], stamp if g[2] is None else g[2]
                closing = f or samples[-1][0]
                out.append((video, k, opened, start, begun, frame, end, stamp, closing[1]))
            for k, (region, content) in sorted(shown.items(), key=lambda x: x[0]):
                if k not in alive:
                    past = [(g, read(g, region)) for g in reversed(history) if g[1] < f[1]]
                    begin = next((i for i, (_, c) in enumerate(past) if same(content, c)), len(past))
                    first = past[begin][1] if begin < len(past) else None
                    start, begun = f[1], time(f, rate, 0)
                    for g, c in past[begin:]:
                        if same(first, c):
                            start, begun = g[1], time(g, rate, begun)
                    alive[k] = (content if first is None else first, region, f[1], time(f, rate, 0), f[1], start, begun)
                elif same(alive[k][0], content):
                    alive[k] = (content, region, f[1], time(f, rate, 0), *alive[k][4:])
    return sorted(out, key=repr)


COLUMNS = ("video_id", "region_id", "opened_frame", "start_frame", "start_ns", "last_frame", "end_frame", "end_ns", "closed_at")


def test_against_a_plain_simulator(spark):
    rows = made_up(4)
    out = L.lifecycles(spark.createDataFrame(rows, FRAME), L.value_comparator(10.0))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)
    assert got == plain(rows, lambda a, b: abs(a - b) <= 10.0) and len(got) > 60


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [r for r in made_up(6, 3, 80) if r[0] is not None]
    frames = spark.createDataFrame(rows, FRAME)
    for part in range(4):
        frames.where(F.expr("frame_index div 20") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.lifecycle_stream(stream, 10.0).writeStream.format("memory").queryName("closed").trigger(availableNow=True).start()
    q.awaitTermination()
    want = L.lifecycles(frames, L.value_comparator(10.0))
    assert sorted(map(tuple, spark.table("closed").collect())) == sorted(map(tuple, want.collect()))


def test_planes_from_detection_to_segments(spark):
    """White boxes in grey frames: detected, tracked, followed and refined to the frames they were drawn in."""
    drawn = D.drawn_frames(spark, 60, 320, 180, ((40, 100, 200, 30, 10, 39),)).withColumn("sampled", F.col("frame_index") % 4 == 0)
    found = tracked(D.detected(drawn.where("sampled")).select("video_id", "frame_index", "ord", (F.col("x") / 320).alias("x"), (F.col("y") / 180).alias("y"), (F.col("width") / 320).alias("width"), (F.col("height") / 180).alias("height")))
    for kind in ("bitset-cover", "sparse-chamfer"):
        out = L.valid(L.lifecycles(L.with_regions(drawn, found), L.plane_comparator(kind)), 320, 180).collect()
        assert [(r.region_id, r.start_frame, r.end_frame, r.start_ns, r.end_ns) for r in out] == [(0, 10, 39, 400 * MS, 1560 * MS)]


def test_publishing(spark):
    rows = [(1, i, p, c) for i, (p, c) in enumerate(((0.0, False), (0.0004, False), (0.001, False), (0.0015, False), (0.5, False), (0.5, True), (0.5, True)))]
    out = M.published(spark.createDataFrame(rows, "video_id long, frame_index long, progress double, completed boolean"))
    assert [r.frame_index for r in out.orderBy("frame_index").collect()] == [2, 4, 5]
    told = spark.createDataFrame([("running", True), ("running", False), ("paused", False), ("cancelled", False), (None, None)], "state string, completed boolean")
    assert [r.s for r in told.select(M.status(F.col("state"), F.col("completed")).alias("s")).collect()] == ["Done", "Processing", "Paused", "Idle", "Idle"]
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(M.shown_rate(F.lit(0.0), "ms")) == "-- ms" and show(M.shown_rate(F.lit(12.34), "ms")) == "12.3 ms"
    assert show(M.shown_ratio(F.lit(0.0), F.lit(True))) == 1.0 and show(M.shown_ratio(F.lit(1.5), F.lit(False))) == 1.0
    text = show(M.shown_progress(*map(F.lit, (24.0, 1.5, 0.0, 3.25, 4, 2, 1))))
    assert text.split("\n")[1] == "[counts] cues 4 • merged 2 • ocr-empty 1" and "seg -- ms" in text


def test_sources_are_chosen(spark):
    def missing(config):
        raise B.Unavailable("not here")

    readers = {"first": missing, "second": lambda c: spark.range(c.start_frame, 5)}
    name, frames = B.opened(B.from_environment({"FRAMEWRIGHT_START_FRAME": "2"}), readers)
    assert name == "second" and frames.count() == 3
    with pytest.raises(B.Unavailable):
        B.opened(B.SourceConfig("first"), readers)
    for bad in ({"FRAMEWRIGHT_CHANNEL_CAPACITY": "0"}, {"FRAMEWRIGHT_CHANNEL_CAPACITY": "x"}, {"FRAMEWRIGHT_START_FRAME": "-1"}):
        with pytest.raises(ValueError):
            B.from_environment(bad)
    with pytest.raises(ValueError, match="native.*mock"):
        B.SourceConfig("mock", output=B.HANDLES).checked()
    assert B.SourceConfig("own", output=B.HANDLES).checked(("own",)).output == B.HANDLES


def read_png(data):
    """width, height and pixels of a grey picture without line filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunks[kind] = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + chunks[kind]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        at += 12 + n
    w, h = (int.from_bytes(chunks[b"IHDR"][k : k + 4], "big") for k in (0, 4))
    lines = zlib.decompress(chunks[b"IDAT"])
    assert chunks[b"IHDR"][8:] == bytes([8, 0, 0, 0, 0]) and len(lines) == h * (w + 1) and not any(lines[:: w + 1])
    return w, h, b"".join(lines[y * (w + 1) + 1 : (y + 1) * (w + 1)] for y in range(h))


def test_dumps_and_reports(spark, tmp_path):
    frame = (7, 4, 2, 6, bytes(range(12)), 4, bytes([9] * 4))
    rows = spark.createDataFrame([frame], "frame_index long, width int, height int, y_stride int, y_plane binary, uv_stride int, uv_plane binary")
    out = files.write_raw_frames(rows, str(tmp_path / "out")).collect()
    assert [(r.path.rpartition("/")[2], r.bytes) for r in out] == [("00007.yuv", 12)]
    assert (tmp_path / "out" / "00007.yuv").read_bytes() == bytes([0, 1, 2, 3, 6, 7, 8, 9, 9, 9, 9, 9])
    pairs = spark.createDataFrame([("a", "b", None, "roi 0", 0.5, True), ("b", "c", "no regions", None, None, None)], "prev_frame string, curr_frame string, skipped string, description string, similarity double, same_segment boolean")
    told = [json.loads(r.json) for r in files.pair_report_lines(pairs, "bitset-cover").orderBy("prev_frame").collect()]
    assert [(p["comparator"], len(p["roi_results"]), p["skipped"]) for p in told] == [("bitset-cover", 1, None), ("bitset-cover", 0, "no regions")]
    grey = files.write_pictures(rows, str(tmp_path / "grey")).collect()
    data = (tmp_path / "grey" / "00007.png").read_bytes()
    assert [r.bytes for r in grey] == [len(data)] and read_png(data) == (4, 2, bytes([0, 1, 2, 3, 6, 7, 8, 9]))
    assert [p.name for p in (tmp_path / "grey").iterdir()] == ["00007.png"]
    path = files.write_metadata(str(tmp_path / "grey"), input="a=b.mp4", backend="mock", sample_frequency_hz=7)
    assert open(path).read() == "input=a=b.mp4\nbackend=mock\nsample_frequency_hz=7\n"
    with pytest.raises(ValueError):
        files.write_metadata(str(tmp_path), input="a\nb")
    assert [srt.default_path(p) for p in ("/a/b.mp4", "c.x.mkv", "/a/b")] == ["/a/b.srt", "c.x.srt", "/a/b.srt"]
    assert settings.valid_roi((0.12345678, 0, 0.5, 2)) == (0.123457, 0, 0.5, 1.0) and settings.valid_roi((1.0, 0, 0.5, 0.5)) == settings.FULL
    with pytest.raises(ValueError, match="unknown"):
        settings.load({"samples": 3})


def test_averages_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(i * i % 7)) for i in range(20)], "video_id long, frame_index long, det_ms double")
    rows.where("frame_index < 9").coalesce(1).write.mode("append").parquet(str(tmp_path))
    rows.where("frame_index >= 9").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    S.averaged_stream(stream).writeStream.format("memory").queryName("averages").trigger(availableNow=True).start().awaitTermination()
    want = {r.frame_index: r.det_ms for r in M.detection_average(rows).collect()}
    assert {r.frame_index: r.det_ms for r in spark.table("averages").collect()} == want


def test_engine_that_recognises_nothing():
    from framewright.operators import recognise as R

    assert R.silent()(SimpleNamespace()) == []
