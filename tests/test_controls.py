"""Pauses, resumes and cancels; pixel formats."""

import random

import numpy as np
import pytest

from framewright.operators import controls as G
from framewright.operators import convert as X
from framewright.operators import lifecycle as L
from framewright.streaming import stateful as T

from .test_lifecycle import FRAME, made_up
from .test_streams import rocks, rows_of, streamed  # noqa: F401


def simulated(frames, commands):
    """order -> (state, released_at) of one video by playing it."""
    out, state, held = {}, "running", []
    events = sorted([(o, {"cancel": 0, "resume": 1, "pause": 2}[c], c) for o, c in commands] + [(o, 3, None) for o in frames])
    for o, _, c in events:
        if c is None:
            out[o] = (state, o if state == "running" else None)
            held += [o] if state == "paused" else []
        elif state != "cancelled":
            if c == "resume":
                out.update({h: ("paused", o) for h in held})
            held = held if c == "pause" else []
            state = {"pause": "paused", "resume": "running", "cancel": "cancelled"}[c]
    return out


def test_gates(spark):
    r = random.Random(4)
    commands = {v: [(r.randint(0, 40), r.choice(["pause", "resume", "pause", "resume", *(["cancel"] if v % 3 == 0 else [])])) for _ in range(v)] for v in range(12)}
    frames = spark.createDataFrame([(v, o, o * 10, "x") for v in range(12) for o in range(40)], "video_id long, order long, pts_ns long, command string")
    controls = spark.createDataFrame([(v, o, c) for v in commands for o, c in commands[v]] + [(3, 5, "rewind"), (99, 1, "pause")], "video_id long, order long, command string")
    got = {}
    for x in G.gated(frames, controls).collect():
        got.setdefault(x.video_id, {})[x.order] = (x.state, x.released_at)
    assert got == {v: simulated(range(40), commands[v]) for v in range(12)}
    assert G.gated(frames.limit(0), controls).count() == 0 and G.gated(frames, controls.limit(0)).where("state <> 'running' or released_at <> order").count() == 0


def test_paused_and_resumed_is_uninterrupted(rocks, tmp_path):  # noqa: F811
    """Frames pass a gate that closes twice, once over the end of a batch and a restart, and life cycles of what comes out are those
    of all frames; a video that is cancelled stops."""
    spark = rocks
    rows = [r[:6] for r in made_up(11, 2, 60) if r[0] is not None]
    schema = FRAME.removesuffix(", last boolean")
    events = [(*r, r[1], None) for r in rows]
    events += [(0, None, None, None, None, None, o, c) for o, c in ((10, "pause"), (25, "resume"), (30, "pause"), (30, "pause"), (55, "resume"))] + [(1, None, None, None, None, None, 40, "cancel")]
    both = f"{schema}, order long, command string"
    stream = streamed(spark, [[e for e in events if e[6] // 20 == k] for k in range(2)], both, tmp_path)
    where = str(tmp_path / "out")

    def run():
        T.gated(stream).writeStream.format("parquet").option("path", where).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(where)

    first = run().select("video_id", "frame_index").collect()
    assert sorted(x.frame_index for x in first if x.video_id == 0) == list(range(30))  # held since
    spark.createDataFrame([e for e in events if e[6] // 20 == 2], both).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = run()  # from the checkpoint
    all_frames = spark.createDataFrame(rows, schema)
    assert sorted(x.frame_index for x in out.where("video_id = 1").collect()) == list(range(40))
    lives = lambda df: sorted(map(repr, L.lifecycles(df.where("video_id = 0").select(*all_frames.columns), L.value_comparator(10.0)).collect()))
    assert lives(out) == lives(all_frames) and len(lives(out)) > 5


def test_bilinear_by_the_formula():
    r = np.random.default_rng(5)
    for (h, w), (th, tw) in (((5, 7), (5, 7)), ((5, 7), (3, 11)), ((1, 1), (4, 4)), ((8, 8), (4, 4)), ((9, 2), (1, 1))):
        p = r.integers(0, 256, (h, w)).astype(np.uint8)
        got = X.bilinear(p, tw, th)
        for y in range(th):
            for x in range(tw):
                sy, sx = min(max((y + 0.5) * h / th - 0.5, 0), h - 1), min(max((x + 0.5) * w / tw - 0.5, 0), w - 1)
                y0, x0 = int(sy), int(sx)
                y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
                want = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
                assert abs(float(got[y, x]) - want) <= 2.5


def test_layouts_agree():
    r = np.random.default_rng(6)
    w, h = 7, 5
    rgb = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
    y, uv = X.to_nv12(rgb.tobytes(), "rgb24", w, h, w, h)
    assert (len(y), len(uv)) == (35, 24) and X.to_nv12(rgb[:, :, ::-1].tobytes(), "bgr24", w, h, w, h) == (y, uv)
    c = np.frombuffer(uv, np.uint8).reshape(3, 4, 2)
    for layout, chroma in (("nv12", c), ("nv21", c[:, :, ::-1]), ("yuv420p", c.transpose(2, 0, 1))):
        assert X.to_nv12(y + chroma.tobytes(), layout, w, h, w, h) == (y, uv), layout
        assert X.to_nv12(y + chroma.tobytes(), layout, w, h, 14, 10) == X.to_nv12(y + uv, "nv12", w, h, 14, 10)
    assert X.to_nv12(y, "gray8", w, h, w, h) == (y, bytes([128]) * 24)
    white, grey = np.full((2, 2, 3), 255, np.uint8), np.full((2, 2, 3), 99, np.uint8)
    assert X.to_nv12(white.tobytes(), "rgb24", 2, 2, 2, 2) == (b"\xff" * 4, b"\x80\x80") and X.to_nv12(grey.tobytes(), "rgb24", 2, 2, 2, 2)[0] == b"\x63" * 4
    with pytest.raises(ValueError, match="no gray8 frame"):
        X.to_nv12(b"abc", "gray8", 2, 2, 2, 2)


def test_frames_of_several_layouts(spark):
    rows = [(1, "gray8", 2, 2, bytes([1, 2, 3, 4]), "a"), (2, "rgb24", 1, 1, bytes([255, 0, 0]), None)]
    frames = spark.createDataFrame(rows, "frame_index long, layout string, width int, height int, data binary, note string")
    got = {r.frame_index: r for r in X.converted(frames).collect()}
    assert (bytes(got[1].y_plane), got[1].uv_stride, got[1].note) == (bytes([1, 2, 3, 4]), 2, "a")
    assert (got[2].width, len(got[2].y_plane), len(got[2].uv_plane)) == (1, 1, 2)
    assert {(r.width, r.height, len(r.y_plane), len(r.uv_plane)) for r in X.converted(frames, 6, 4).collect()} == {(6, 4, 24, 12)}
