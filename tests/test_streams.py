"""Streams with typed state and timers, late rows, null times, and the upsert table."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import lifecycle as L
from framewright.operators import sampling as S
from framewright.operators.tracking import tracked
from framewright.streaming import pipeline as P
from framewright.streaming import stateful as T
from framewright.streaming.upsert import UpsertTable

from .test_lifecycle import FRAME, made_up

STEP = 40_000_000


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, parts, schema, path):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def rows_of(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q


def test_life_cycles_end_by_a_timer_and_count_late_rows(rocks, tmp_path):
    spark = rocks
    rows = [r[:6] for r in made_up(8, 3, 80) if r[0] is not None]
    schema = FRAME.removesuffix(", last boolean") + ", at timestamp"
    import datetime as D

    when = lambda i: D.datetime(2024, 1, 1) + D.timedelta(milliseconds=40 * i)
    timed = [(*r, when(r[1])) for r in rows]
    parts = [[r for r in timed if r[1] // 20 == k] for k in range(4)]
    again = [r for r in parts[0] if r[0] == 1][:7]
    parts[2] = parts[2] + again  # late: seen two batches before
    parts.append([(77, 0, 0, 1.0, False, None, when(10_000))])  # another video moves the watermark
    frames = streamed(spark, parts, schema, tmp_path).withWatermark("at", "1 hour")
    frames = frames.select("*")  # the watermark is an hour behind; what closes the videos is a later row
    extra = [(77, 1, 0, 1.0, False, None, when(10_000_000))]
    spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, q = rows_of(spark, T.lifecycles(frames, 10.0, idle_ms=5000), "typed_lives")
    want = L.lifecycles(spark.createDataFrame(rows, FRAME.removesuffix(", last boolean")), L.value_comparator(10.0))
    spans = [r for r in got if r.kind == "span"]
    names = want.columns
    assert sorted(repr([r[c] for c in names]) for r in spans) == sorted(repr([r[c] for c in names]) for r in want.collect()) and len(spans) > 20
    ends = {r.video_id: r.late_rows for r in got if r.kind == "end"}
    assert ends == {0: 0, 1: 7, 2: 0}


def test_only_changed_regions_are_written():
    """Of a batch that touches one region of many, one entry is written."""
    wrote = []

    class Spans:
        def updateValue(self, key, value):
            wrote.append(("put", key))

        def removeKey(self, key):
            wrote.append(("gone", key))

    class Other:
        def put(self, x):
            pass

        clear = update = lambda self, *x: None

    p = T.LifecycleProcessor(L.value_comparator(1.0), 1)
    p.spans, p.recent, p.ahead, p.meta = Spans(), Other(), Other(), Other()
    span = L.Span("a", (0.0, 0.0, 1.0, 1.0), 1.0, 0, (0, 0), (0, 0))
    before = {i: span._replace(opened=i) for i in range(100)}
    t = L.Timeline(L.value_comparator(1.0))
    t.spans = {**before, 7: before[7]._replace(content=2.0), 200: span}
    del t.spans[9]
    p._saved(t, before, 1, 0, None)
    assert sorted(wrote) == [("gone", (9,)), ("put", (7,)), ("put", (200,))]


def test_tracking_with_typed_state(rocks, tmp_path):
    spark = rocks
    import datetime as D
    import random

    r = random.Random(2)
    rows = [(v, f, o, r.random() * 0.5, r.random() * 0.5, 0.2 + r.random() * 0.3, 0.3) for v in (1, 2) for f in range(30) for o in range(r.randint(0, 3))]
    schema = "video_id long, frame_index long, ord int, x double, y double, width double, height double, at timestamp"
    when = lambda f: D.datetime(2024, 1, 1) + D.timedelta(seconds=f)
    timed = [(*x, when(x[1])) for x in rows]
    parts = [[x for x in timed if x[1] // 10 == k] for k in range(3)] + [timed[:2], [(9, 0, 0, 0.0, 0.0, 0.1, 0.1, when(10_000))]]
    stream = streamed(spark, parts, schema, tmp_path).withWatermark("at", "1 minute")
    got, _ = rows_of(spark, T.tracked(stream, idle_ms=1000), "typed_tracks")
    want = tracked(spark.createDataFrame(rows, schema.removesuffix(", at timestamp"))).drop("label")
    names = want.columns
    assert sorted(repr([r[c] for c in names]) for r in got if r.kind == "region" and r.video_id != 9) == sorted(repr([r[c] for c in names]) for r in want.collect())
    assert {r.video_id for r in got if r.kind == "end"} == {1, 2} and {r.late_rows for r in got if r.kind == "end"} <= {0, 2}


def test_sampled_stream_with_null_times(spark, tmp_path):
    rows = [(v, i, None if (v == 1 and i % 3) or v == 2 else 2**53 + 1 + i * STEP, i == 59) for v in (1, 2, 3) for i in range(60)]
    schema = "video_id long, frame_index long, pts_ns long, last boolean"
    stream = streamed(spark, [[r for r in rows if r[1] // 15 == k] for k in range(4)], schema, tmp_path)
    got, _ = rows_of(spark, P.sampled_stream(stream), "null_times")
    want = S.with_sampled(spark.createDataFrame(rows, schema), tail=True).where("sampled").select("video_id", "frame_index", "pts_ns").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 60


LOG = "video_id long, id long, ord long, text string"


def test_upsert_survives_a_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    r = __import__("random").Random(3)
    log = [(r.randint(0, 3), r.randint(0, 30), n, f"t{n}") for n in range(400)]
    stream = streamed(spark, [log[k : k + 100] for k in range(0, 400, 100)], LOG, tmp_path)
    newest = {}
    for row in log:
        newest[row[:2]] = row
    table = UpsertTable(str(tmp_path / "table"), ["video_id", "id"], "ord", 5)
    commit, dies = UpsertTable._commit, [2]

    def killed(self, manifest):
        if manifest["batch"] in dies:
            dies.remove(manifest["batch"])
            raise RuntimeError("killed before the commit")
        commit(self, manifest)

    def run():
        q = stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    monkeypatch.setattr(UpsertTable, "_commit", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    assert table.manifest()["batch"] == 1 and {tuple(x) for x in table.read(spark).collect()} == {x for x in _newest(log[:200])}
    run()
    assert {tuple(x) for x in table.read(spark).collect()} == set(newest.values()) and table.read(spark).count() == len(newest)
    before = table.manifest()
    table.upsert(spark.createDataFrame([(0, 0, 10**6, "again")], LOG), 3)  # replayed: committed already
    assert table.manifest() == before
    assert table.vacuum() > 0 and {tuple(x) for x in table.read(spark).collect()} == set(newest.values())


def _newest(log):
    out = {}
    for row in log:
        out[row[:2]] = row
    return out.values()


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = UpsertTable(str(tmp_path / "t"), ["video_id", "id"], "ord", 8)
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    table.upsert(spark.createDataFrame([(1, i, 0, None) for i in range(50)] + [(None, None, 0, "no key")], LOG), 0)
    first = table.manifest()["versions"]
    table.upsert(spark.createDataFrame([(1, 7, 3, "new"), (1, 7, 2, "older"), (None, None, 1, "later")], LOG), 1)
    second = table.manifest()["versions"]
    assert 1 <= sum(first[b] != second[b] for b in first) <= 2
    got = {(r.video_id, r.id): r.text for r in table.read(spark).collect()}
    assert len(got) == 51 and got[(1, 7)] == "new" and got[(None, None)] == "later" and got[(1, 8)] is None
    table.upsert(spark.createDataFrame([], LOG), 2)
    assert table.manifest()["batch"] == 2 and table.manifest()["versions"] == second
