"""Structured Streaming forms of the sampler, the tracker and the cue merge.

Each is a step over one key's rows with state between micro-batches. Spark keeps no order across files, so a batch
is sorted inside the handler and rows at or before the last one seen are dropped; a stream has no end, so a row with
``last`` set flushes a key.
"""

from __future__ import annotations

import json
from collections import deque, namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.lifecycle import SEGMENT, Span, Timeline, value_comparator
from ..operators.metrics import EMA_ALPHA
from ..operators.sampling import EPSILON
from ..operators.segments import MERGE_GAP_NS
from ..operators.tracking import Tracker

STATE = "state string"
_Frame = namedtuple("_Frame", "frame_index pts_ns sampled regions value")


def _keyed(df: DataFrame, key: str, order: list[str], step, schema: str, load=dict, dump=dict) -> DataFrame:
    """step(state, row) -> output tuples. The state is JSON between batches, with the order of the last row under "at";
    load and dump make the object that step works on from it and back, once a batch."""
    names = [f.split()[0] for f in schema.split(", ")]

    def handle(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        at, live = held.pop("at", None), load(held)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in rows.itertuples(index=False):
            now = [int(getattr(row, c)) for c in order]
            if at is None or now > at:
                at = now
                out += step(live, row)
        state.update((json.dumps({**dump(live), "at": at}),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(handle, schema, STATE, "append", "NoTimeout")


def sampled_stream(frames: DataFrame, per_second: int = 7) -> DataFrame:
    """video_id, frame_index, pts_ns of the sampled frames; a frame with last set is always one of them. Frames without a
    time are taken as per_second a second, as in the batch form."""

    def step(s: dict, row) -> list[tuple]:
        n, pts = s.get("n", 0), None if row.pts is None else int(row.pts)
        second, part = divmod(n, per_second) if pts is None else divmod(pts, 1_000_000_000)
        part, s["n"] = part / per_second if pts is None else part / 1e9, n + 1
        if s.get("second") != second:
            s["second"], s["used"] = second, 0
        used = sum(part + EPSILON >= i / per_second for i in range(per_second))
        hit, s["used"] = used > s["used"], max(used, s["used"])
        return [(row.video_id, row.frame_index, row.pts)] if hit or bool(row.last) else []

    # As text, times beside nulls don't become floats on their way through pandas.
    rows = frames.withColumn("pts", F.col("pts_ns").cast("string"))
    out = _keyed(rows, "video_id", ["frame_index"], step, "video_id bigint, frame_index bigint, pts string")
    return out.select("video_id", "frame_index", F.col("pts").cast("bigint").alias("pts_ns"))


def tracked_stream(regions: DataFrame) -> DataFrame:
    """As operators.tracking.tracked, a video's regions kept in state."""

    def load(s: dict) -> Tracker:
        return Tracker(s.get("regions", ()), s.get("used", ()), s.get("frame"))

    def dump(t: Tracker) -> dict:
        return {"regions": t.boxes[: t.n].tolist(), "used": np.flatnonzero(t.used[: t.n]).tolist(), "frame": t.frame}

    def step(t: Tracker, row) -> list[tuple]:
        found = t.add(int(row.frame_index), tuple(np.float32(getattr(row, c)) for c in ("x", "y", "width", "height")))
        return [(row.video_id, row.frame_index, row.ord, i, *map(float, b)) for i, b in found]

    return _keyed(regions, "video_id", ["frame_index", "ord"], step, "video_id bigint, frame_index bigint, ord int, region_id bigint, x float, y float, width float, height float", load, dump)


def averaged_stream(samples: DataFrame) -> DataFrame:
    """As operators.metrics.detection_average: video_id, frame_index, det_ms, and samples_seen so far."""

    def step(s: dict, row) -> list[tuple]:
        s["n"], x = s.get("n", 0) + 1, float(row.det_ms)
        s["e"] = x if "e" not in s else (1 - EMA_ALPHA) * s["e"] + EMA_ALPHA * x
        return [(row.video_id, row.frame_index, s["e"], s["n"])]

    return _keyed(samples, "video_id", ["frame_index"], step, "video_id bigint, frame_index bigint, det_ms double, samples_seen bigint")


def lifecycle_stream(frames: DataFrame, limit: float) -> DataFrame:
    """As operators.lifecycle.lifecycles with a comparator of values: frames with value, sampled and regions; a row with
    last set closes what is open. The state holds a history of numbers and the open regions."""
    comparator = value_comparator(limit)

    def load(s: dict) -> Timeline:
        t = Timeline(comparator)
        frame = lambda x: _Frame(*x)
        t.recent, t.ahead = deque(map(frame, s.get("recent", ()))), list(map(frame, s.get("ahead", ())))
        t.spans = {i: Span(label, tuple(roi), content, opened, tuple(start), tuple(last)) for i, label, roi, content, opened, start, last in s.get("spans", ())}
        t.at, t.fps, t.before, t.ended = s.get("sample"), s.get("fps"), s.get("before") and tuple(s["before"]), s.get("ended", 0)
        return t

    def dump(t: Timeline) -> dict:
        return {"recent": list(t.recent), "ahead": t.ahead, "spans": [(i, *x) for i, x in t.spans.items()], "sample": t.at, "fps": t.fps, "before": t.before, "ended": t.ended}

    def step(t: Timeline, row) -> list[tuple]:
        regions = None if row.regions is None else [dict(r) for r in row.regions]
        pts = None if row.pts_ns != row.pts_ns else int(row.pts_ns)
        f = _Frame(int(row.frame_index), pts, bool(row.sampled), regions, float(row.value))
        found = t.add(f)
        t.recent[-1] = f._replace(regions=None)
        t.ahead = [x._replace(regions=None) for x in t.ahead]
        return [(row.video_id, *s) for s in (found + t.finish() if row.last else found)]

    return _keyed(frames, "video_id", ["frame_index"], step, f"video_id bigint, {SEGMENT}", load, dump)


def merged_stream(cues: DataFrame) -> DataFrame:
    """The changelog of merged cues: video_id, ord, kind, id, start_ns, end_ns, start_frame, texts (joined by |)."""

    def step(s: dict, row) -> list[tuple]:
        last, text = s.get("last"), row.text
        gap = int(row.start_ns) - last["end"] if last else 0
        if last and (gap <= 0 or (gap <= MERGE_GAP_NS and text in last["texts"])):
            kind = "updated"
            last.update(start=min(last["start"], int(row.start_ns)), end=max(last["end"], int(row.end_ns)), frame=min(last["frame"], int(row.start_frame)))
            if text not in last["texts"]:
                last["texts"].append(text)
        else:
            kind = "new"
            last = s["last"] = {"id": last["id"] + 1 if last else 0, "start": int(row.start_ns), "end": int(row.end_ns), "frame": int(row.start_frame), "texts": [text]}
        return [(row.video_id, row.ord, kind, last["id"], last["start"], last["end"], last["frame"], "|".join(last["texts"]))]

    return _keyed(cues, "video_id", ["ord"], step, "video_id bigint, ord bigint, kind string, id bigint, start_ns bigint, end_ns bigint, start_frame bigint, texts string")
