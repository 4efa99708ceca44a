"""Pairs of boxes and lines of boxes: rounding, remainders and joins by plain columns, tracking of many videos side by side."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framewright.functions import geometry as G
from framewright.operators import pixels as P
from framewright.operators import tracking as R

#: The JVM does not compile longer methods.
LONGEST = 8000


@pytest.mark.parametrize("name", ["iou_pairs", "iou_best_match", "clip_remainder"])
def test_code_of_pairs_is_short_enough_to_be_compiled(spark, sf, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        code = entry.queries()[name](spark, sf)._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < LONGEST
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounding_is_that_of_sql_on_doubles(spark):
    import duckdb

    values = [1.005, -1.005, 0.125, 0.135, -0.125, 2.5e-3, 1e300, -0.001, 0.0, float("inf"), float("nan"), None]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(G.rounded(F.col("v"), 2).alias("r")).collect()]
    want = [None if v is None else duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]
    assert [repr(x + 0.0) if x is not None else None for x in got] == [repr(x + 0.0) if x is not None else None for x in want]


def test_remainders_are_those_of_the_tracker(spark):
    r = random.Random(4)
    grid = lambda low: r.randrange(low, 6) / 8
    rows = [(i, (grid(0), grid(0), grid(1), grid(1)), (grid(0), grid(0), grid(1), grid(1))) for i in range(500)]
    one = "struct<x:double,y:double,width:double,height:double>"
    pairs = spark.createDataFrame([*rows, (500, None, rows[0][1])], f"i int, a {one}, b {one}")
    got = {x.i: tuple(x.r) for x in G.with_clip_remainder(pairs, "a", "b", "r").collect()}
    plain = {i: R.remainder(tuple(map(np.float32, a)), tuple(map(np.float32, b))) for i, a, b in rows}
    assert got == {i: tuple(map(float, v)) for i, v in plain.items() if v is not None} and 0 < len(got) < 500


def test_lines_are_merged_as_by_a_fold(spark):
    r = random.Random(5)
    rows = [(g, 0, k, r.randrange(400), r.randrange(5), r.randrange(30), 20) for g in range(40) for k in range(r.randrange(1, 25))]
    df = spark.createDataFrame(rows, "g int, line int, ord int, x int, y int, width int, height int")
    out = P.merged_lines(df, "g")
    got = sorted((x.g, x.x, x.y, x.width, x.height, x.n) for x in out.collect())
    want = []
    for g in range(40):
        now = None
        for _, _, _, x, y, w, h in sorted((b for b in rows if b[0] == g), key=lambda b: (b[3], b[2])):
            if now is not None:
                cw, ch = max(min(now[0] + now[2], x + w) - max(now[0], x), 0), max(min(now[1] + now[3], y + h) - max(now[1], y), 0)
            if now is not None and (x <= now[0] + now[2] + 16 or cw * ch / (now[2] * now[3] + w * h - cw * ch + 1e-6) >= 0.15):
                x0, y0 = min(now[0], x), min(now[1], y)
                now = (x0, y0, max(now[0] + now[2], x + w) - x0, max(now[1] + now[3], y + h) - y0, now[4] + 1)
            else:
                want += [(g, *now)] if now else []
                now = (x, y, w, h, 1)
        want.append((g, *now))
    assert got == sorted(want)
    assert "collect_list" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("alone", [512, 1])
def test_videos_side_by_side_are_tracked_as_one_by_one(spark, monkeypatch, alone):
    monkeypatch.setattr(R, "ALONE", alone)
    r = np.random.default_rng(alone)
    lengths = r.integers(1, 80, 12)
    n = int(lengths.sum())
    boxes = np.stack([r.random(n) * 0.5, r.random(n) * 0.5, r.random(n) * 0.4 - 0.02, r.random(n) * 0.3]).astype(np.float32)
    frames = np.concatenate([np.sort(r.integers(0, 20, k)) for k in lengths])
    video = np.repeat(np.arange(len(lengths)), lengths)
    want, trackers = [], {}
    for i in range(n):
        t = trackers.setdefault(int(video[i]), R.Tracker())
        want.append(t.add(int(frames[i]), tuple(boxes[:, i])))
    got, state, before = [], None, None
    for a, b in ((0, 100), (100, 101), (101, n)):
        new = np.concatenate([[False], video[a + 1 : b] != video[a : b - 1]])
        fresh = new | np.concatenate([[False], frames[a + 1 : b] != frames[a : b - 1]])
        held = state if state is not None and video[a] == before else None
        fresh[0] = held is None or frames[a] != held.frame
        first = np.concatenate([[0], np.flatnonzero(new)])
        ids, rest, left, state = R._through(held, np.diff(np.append(first, b - a)), boxes[:, a:b], fresh, [int(frames[b - 1])])
        before = video[b - 1]
        got += [[*([(int(rest[i]), tuple(left[:, i]))] if rest[i] >= 0 else []), (int(ids[i]), tuple(boxes[:, a + i]))] for i in range(b - a)]
    assert got == want
