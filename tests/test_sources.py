"""Files of many frames, SubRip files and seeks."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import seeks as K
from framewright.sources import framefiles as FF
from framewright.sources import srt, subrip

WIDTH, HEIGHT, N = 16, 6, 1000
SIZE = WIDTH * HEIGHT + WIDTH * 3


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """One file of a thousand frames; the first two bytes of a frame tell its number."""
    path = tmp_path_factory.mktemp("raw") / "film.yuv"
    path.write_bytes(b"".join(i.to_bytes(2, "big") + bytes([i % 251]) * (SIZE - 2) for i in range(N)))
    return str(path)


def test_one_file_is_read_in_parts(spark, big):
    df = FF.frame_files(spark, big, WIDTH, HEIGHT, step_ns=10, partitions=8)
    rows = df.select("frame_index", "pts_ns", F.length("y_plane").alias("y"), F.length("uv_plane").alias("uv"), F.substring("y_plane", 1, 2).alias("n"), F.spark_partition_id().alias("part")).collect()
    assert [r.frame_index for r in sorted(rows, key=lambda r: r.frame_index)] == list(range(N)) and len({r.part for r in rows}) == 8
    assert all(int.from_bytes(r.n, "big") == r.frame_index and r.pts_ns == 10 * r.frame_index and (r.y, r.uv) == (WIDTH * HEIGHT, WIDTH * 3) for r in rows)


def reader(path, filters=(), **options):
    r = FF.FrameFiles({"path": path, "width": str(WIDTH), "height": str(HEIGHT), "step_ns": "10", "filters": "true", **options}).reader(None)
    left = list(r.pushFilters(filters))
    return r, left


def read(r):
    return [i for p in r.partitions() for b in r.read(p) for i in b.column("frame_index").to_pylist()]


def test_what_lies_before_is_not_read(big):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

    index, pts = ("frame_index",), ("pts_ns",)
    cases = [
        ([], {"start_frame": "990"}, range(990, N)),
        ([GreaterThanOrEqual(index, 700)], {}, range(700, N)),
        ([GreaterThan(index, 10), LessThan(index, 20)], {}, range(11, 20)),
        ([EqualTo(index, 500)], {}, range(500, 501)),
        ([EqualTo(index, 5000)], {}, range(0)),
        ([GreaterThan(pts, 95), LessThanOrEqual(pts, 125)], {}, range(10, 13)),
        ([GreaterThanOrEqual(pts, 90), LessThan(pts, 120)], {}, range(9, 12)),
        ([EqualTo(pts, 95)], {}, range(0)),
        ([], {"seek_ns": "94", "seek": "fast"}, range(9, N)),
        ([], {"seek_ns": "94", "seek": "accurate"}, range(10, N)),
        ([], {"seek_ns": "90", "seek": "accurate"}, range(9, N)),
    ]
    for filters, options, want in cases:
        r, left = reader(big, filters, **options)
        assert left == [] and read(r) == list(want), (filters, options)
        assert r.read_bytes == len(want) * SIZE


def test_filters_reach_the_source(spark, big):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = FF.frame_files(spark, big, WIDTH, HEIGHT, partitions=4).where("frame_index >= 996").select("frame_index", F.spark_partition_id().alias("p"))
        rows = df.collect()
        assert sorted(r.frame_index for r in rows) == [996, 997, 998, 999] and len({r.p for r in rows}) == 4  # one frame a part
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_folders_layouts_and_faults(spark, tmp_path):
    for name, n in (("b", 2), ("a", 3), ("empty", 0)):
        (tmp_path / f"{name}.yuv").write_bytes(bytes(range(WIDTH * HEIGHT)) * n)
    (tmp_path / "notes.txt").write_text("x")
    df = FF.frame_files(spark, str(tmp_path), WIDTH, HEIGHT, layout="y")
    got = df.select(F.regexp_extract("path", "([a-z]+).yuv", 1).alias("f"), "frame_index", F.hex(F.substring("uv_plane", 1, 2)).alias("uv")).collect()
    assert sorted((r.f, r.frame_index) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)] and {r.uv for r in got} == {"8080"}
    parts = reader(str(tmp_path), layout="y")[0].partitions()
    assert [p.path.rpartition("/")[2] for p in parts] == ["a.yuv", "b.yuv"]  # in order of names
    (tmp_path / "b.yuv").write_bytes(bytes(WIDTH * HEIGHT + 1))
    with pytest.raises(ValueError, match="no whole number"):
        reader(str(tmp_path), layout="y")[0].partitions()
    assert len(read(reader(str(tmp_path), layout="y", truncated="skip")[0])) == 4
    for bad in ({"layout": "rgb"}, {"step_ns": "0"}, {"seek_ns": "1", "seek": "soon"}):
        with pytest.raises(ValueError):
            reader(str(tmp_path), **bad)
    with pytest.raises(FileNotFoundError):
        reader(str(tmp_path / "none"))[0].partitions()


def test_written_files_read_back(spark, tmp_path):
    rows = [(v, i, 4, 2, 6, bytes([v, i, 1, 2, 99, 99, 3, 4, 5, 6, 99, 99]), bytes([i] * 4)) for v in (3, 1) for i in (2, 0, 1)]
    frames = spark.createDataFrame(rows, "video_id long, frame_index long, width int, height int, y_stride int, y_plane binary, uv_plane binary")
    told = FF.write_frame_files(frames, str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.frames, r.bytes) for r in told) == [("1.yuv", 3, 36), ("3.yuv", 3, 36)]
    back = FF.frame_files(spark, str(tmp_path), 4, 2).collect()
    assert sorted((bytes(r.y_plane), bytes(r.uv_plane), r.frame_index) for r in back) == sorted((bytes([v, i, 1, 2, 3, 4, 5, 6]), bytes([i] * 4), i) for v in (1, 3) for i in range(3))
    short = frames.withColumn("y_plane", F.when(F.col("frame_index") < 2, F.col("y_plane")))
    with pytest.raises(Exception, match="NoneType"):
        FF.write_frame_files(short, str(tmp_path / "failed")).collect()
    assert list((tmp_path / "failed").iterdir()) == []  # no half file


SUBTITLE = "video_id long, id long, start_ns long, end_ns long, start_frame long, lines array<struct<center:double,text:string>>, source string"


def subtitles(spark):
    rows = [(v, i, 10**9 * (i + 1), 10**9 * (i + 1) + 5 * 10**8, i, [(1.0, f"line {v}.{i}")] if i != 1 else [], f"/films/part {v}.mp4") for v in (1, 2) for i in range(3)]
    return spark.createDataFrame([*rows, (9, 0, 0, 1, 0, [], "x/y")], SUBTITLE)


def test_a_file_for_each_video(spark, tmp_path):
    s = subtitles(spark)
    subrip.save(s, str(tmp_path / "ids"))
    want = {r.video_id: r.srt for r in srt.rendered(s).collect()}
    assert {int(p.stem): p.read_text() for p in (tmp_path / "ids").iterdir()} == want and set(want) == {1, 2}
    subrip.save(s, str(tmp_path / "ids"))  # again: same files
    assert {int(p.stem): p.read_text() for p in (tmp_path / "ids").iterdir()} == want
    subrip.save(s, str(tmp_path / "names"), source="source")
    assert {p.name: p.read_text() for p in (tmp_path / "names").iterdir()} == {"part 1.srt": want[1], "part 2.srt": want[2]}


def test_failed_and_doubled_tasks_leave_nothing(spark, tmp_path):
    writer = subrip.SubRipWriter(str(tmp_path), False)
    row = lambda name, n, block: {"name": name, "number": n, "block": block}
    first, again = writer.write(iter([row("a", 1, "x"), row("a", 2, "y"), row("b", 1, "z")])), writer.write(iter([row("a", 1, "x"), row("a", 2, "y"), row("b", 1, "z")]))
    assert not list(tmp_path.glob("*.srt"))  # nothing before the commit
    writer.abort([again, None])  # a speculative task that lost
    writer.commit([first])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.srt": "xy", "b.srt": "z"}

    def breaks():
        yield row("c", 1, "x")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    with pytest.raises(ValueError):
        writer.write(iter([row("../c", 1, "x")]))
    doubled = [writer.write(iter([row("d", 1, "x")])), writer.write(iter([row("d", 2, "y")]))]
    with pytest.raises(ValueError, match="together"):
        writer.commit(doubled)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.srt", "b.srt"]


def test_failed_job_writes_no_file(spark, tmp_path):
    bad = subtitles(spark).withColumn("source", F.when(F.col("video_id") == 1, F.lit("ok.mp4")).otherwise(F.raise_error(F.lit("unreadable")).cast("string")))
    with pytest.raises(Exception, match="unreadable"):
        subrip.save(bad, str(tmp_path / "out"), source="source")
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_epochs(spark):
    frames = spark.createDataFrame([(v, i, None if i == 4 else 100 * i, f"f{i}") for v in (1, 2, None) for i in range(8)], "video_id long, order long, pts_ns long, serial_name string")
    seeks = spark.createDataFrame([(1, 3, 500, True), (1, 3, 450, None), (1, 6, 0, False), (5, 1, 1, True), (None, 2, 300, True)], "video_id long, order long, target_ns long, accurate boolean")
    got = {(r.video_id, r.order): (r.serial, r.target_ns, r.shown) for r in K.with_epochs(frames, seeks).collect()}
    assert len(got) == 24 and got[(1, 2)] == (0, None, True)
    assert got[(1, 3)] == (2, 500, False) and got[(1, 4)] == (2, 500, True) and got[(1, 5)] == (2, 500, True)  # without a time it is shown
    assert got[(1, 6)] == (3, 0, True) and got[(2, 7)] == (0, None, True) and got[(None, 2)] == (1, 300, False) and got[(None, 3)] == (1, 300, True)
    kept = K.current(K.with_epochs(frames, seeks)).collect()
    assert sorted((r.video_id, r.order) for r in kept if r.video_id) == [(1, 6), (1, 7), *((2, i) for i in range(8))]
    assert K.with_epochs(frames, seeks.limit(0)).where("serial > 0 or not shown").count() == 0 and K.with_epochs(frames.limit(0), seeks).count() == 0
