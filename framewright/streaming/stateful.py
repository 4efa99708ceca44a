"""Life cycles and tracking with typed state: a region is an entry of a map of its own, a history a list, and the rest of a video
one value, so that a micro-batch writes what it changes and no more. A video ends by a timer: when the watermark has passed its
last frame by ``idle``, open spans are closed. Rows at or before the last one taken are late; they are counted.

These need the RocksDB state store (spark.sql.streaming.stateStore.providerClass) and a watermark on the column ``at``.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.controls import CANCELLED, PAUSED, RUNNING
from ..operators.lifecycle import SEGMENT, Comparator, Span, Timeline, value_comparator
from ..operators.tracking import Tracker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FRAME = "frame_index bigint, pts_ns bigint, value double"
_SPAN = "label string, x double, y double, width double, height double, content double, opened bigint, start_frame bigint, start_ns bigint, last_frame bigint, last_ns bigint"
_META = "at bigint, fps double, before_index bigint, before_ns bigint, sample bigint, ended bigint, late bigint, timer bigint"
_Frame = namedtuple("_Frame", "frame_index pts_ns value sampled regions")

#: kind: span for a closed span, end for a video that has ended, with late_rows, the late rows so far.
LIFE = f"video_id bigint, kind string, late_rows bigint, {SEGMENT}"
_NAMES = [c.split()[0] for c in LIFE.split(", ")]


class _Timed(StatefulProcessor):
    """What both processors share: order within a batch, late rows, the timer of a video's end."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def _ordered(self, rows: Iterator[Row], order: tuple[str, ...], last: list | None) -> tuple[list[Row], int]:
        """The rows after the last one taken, in order, and how many are not."""
        at = lambda r: [getattr(r, c) for c in order]
        some = sorted(rows, key=at)
        fresh, before = [], last
        for r in some:
            if before is None or at(r) > before:
                fresh.append(r)
                before = at(r)
        return fresh, len(some) - len(fresh)

    def _timer(self, handle: StatefulProcessorHandle, old: int | None, rows: list[Row]) -> int | None:
        """A timer for the end after the latest of these rows, in place of the old one."""
        new = max((int(r.at.timestamp() * 1000) + self.idle_ms for r in rows), default=0)
        if old is not None and new <= old:
            return old
        if old is not None:
            handle.deleteTimer(old)
        if new:
            handle.registerTimer(new)
        return new or None

    def close(self) -> None:
        pass


class LifecycleProcessor(_Timed):
    """Timeline over the frames of a video."""

    def __init__(self, comparator: Comparator, idle_ms: int):
        super().__init__(idle_ms)
        self.comparator = comparator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", _META)
        self.recent, self.ahead = handle.getListState("recent", _FRAME), handle.getListState("ahead", _FRAME)
        self.spans = handle.getMapState("spans", "region_id bigint", _SPAN)

    def _loaded(self) -> tuple[Timeline, dict]:
        t = Timeline(self.comparator)
        meta = dict(zip((c.split()[0] for c in _META.split(", ")), self.meta.get())) if self.meta.exists() else {}
        frame = lambda x: _Frame(*x, False, None)
        t.recent.extend(map(frame, self.recent.get()))
        t.ahead = list(map(frame, self.ahead.get()))
        for (i,), (label, x, y, w, h, content, opened, *ends) in self.spans.iterator():
            t.spans[i] = Span(label, (x, y, w, h), content, opened, tuple(ends[:2]), tuple(ends[2:]))
        t.fps, t.at, t.ended = meta.get("fps"), meta.get("sample"), meta.get("ended") or 0
        t.before = (meta["before_index"], meta["before_ns"]) if meta.get("before_index") is not None else None
        return t, meta

    def _saved(self, t: Timeline, before: dict[int, Span], at: int | None, late: int, timer: int | None) -> None:
        for i in before.keys() - t.spans.keys():
            self.spans.removeKey((i,))
        for i, s in t.spans.items():
            if before.get(i) is not s:
                self.spans.updateValue((i,), (s.label, *s.roi, s.content, s.opened, *s.start, *s.last))
        for state, frames in ((self.recent, t.recent), (self.ahead, t.ahead)):
            if frames:
                state.put([(f.frame_index, f.pts_ns, f.value) for f in frames])
            else:
                state.clear()
        self.meta.update((at, t.fps, *(t.before or (None, None)), t.at, t.ended, late, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        t, meta = self._loaded()
        before = dict(t.spans)
        fresh, late = self._ordered(rows, ("frame_index",), [meta["at"]] if meta.get("at") is not None else None)
        late += meta.get("late") or 0
        out = []
        for r in fresh:
            out += t.add(_Frame(r.frame_index, r.pts_ns, r.value, r.sampled, r.regions))
        timer = self._timer(self.handle, meta.get("timer"), fresh)
        self._saved(t, before, fresh[-1].frame_index if fresh else meta.get("at"), late, timer)
        for s in out:
            yield Row(**dict(zip(_NAMES, (key[0], "span", late, *s))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t, meta = self._loaded()
        before = dict(t.spans)
        out = t.finish()
        t.recent.clear()
        t.ahead = []
        self._saved(t, before, meta.get("at"), meta.get("late") or 0, None)
        for s in out:
            yield Row(**dict(zip(_NAMES, (key[0], "span", meta.get("late") or 0, *s))))
        yield Row(**(dict.fromkeys(_NAMES) | {"video_id": key[0], "kind": "end", "late_rows": meta.get("late") or 0}))


def lifecycles(frames: DataFrame, limit: float, idle_ms: int = 10_000) -> DataFrame:
    """As operators.lifecycle.lifecycles with a comparator of values, on a stream of frames with value, sampled, regions and
    at, the time of the watermark. A frame may have no time (pts_ns) of its own."""
    rows = frames.select("video_id", "at", "frame_index", "pts_ns", "value", "sampled", "regions")
    return rows.groupBy("video_id").transformWithState(LifecycleProcessor(value_comparator(limit), idle_ms), LIFE, "append", "EventTime")


TRACKED = "video_id bigint, kind string, late_rows bigint, frame_index bigint, ord int, region_id bigint, x float, y float, width float, height float"


class TrackingProcessor(_Timed):
    """Tracker over the detections of a video. A region's entry tells its box and the frame that used it last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "frame bigint, ord bigint, late bigint, timer bigint")
        self.regions = handle.getMapState("regions", "region_id bigint", "x float, y float, width float, height float, used bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        frame, place, late, timer = self.meta.get() if self.meta.exists() else (None, None, 0, None)
        held = {i: v for (i,), v in self.regions.iterator()}
        t = Tracker([held[i][:4] for i in range(len(held))], [i for i in held if held[i][4] == frame], frame)
        fresh, more = self._ordered(rows, ("frame_index", "ord"), [frame, place] if frame is not None else None)
        used: dict[int, int] = {}
        for r in fresh:
            for i, b in t.add(r.frame_index, tuple(np.float32(getattr(r, c)) for c in ("x", "y", "width", "height"))):
                used[i] = r.frame_index
                yield Row(video_id=key[0], kind="region", late_rows=late + more, frame_index=r.frame_index, ord=r.ord, region_id=i, x=float(b[0]), y=float(b[1]), width=float(b[2]), height=float(b[3]))
        for i, f in used.items():
            self.regions.updateValue((i,), (*map(float, t.boxes[i]), f))
        last = (fresh[-1].frame_index, fresh[-1].ord) if fresh else (frame, place)
        self.meta.update((*last, late + more, self._timer(self.handle, timer, fresh)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The regions of an ended video go; how far it had come stays, so that what follows is late."""
        frame, place, late, _ = self.meta.get()
        self.regions.clear()
        self.meta.update((frame, place, late, None))
        yield Row(video_id=key[0], kind="end", late_rows=late, frame_index=None, ord=None, region_id=None, x=None, y=None, width=None, height=None)


def tracked(regions: DataFrame, idle_ms: int = 10_000) -> DataFrame:
    """As operators.tracking.tracked, on a stream of detections with at."""
    rows = regions.select("video_id", "at", "frame_index", "ord", "x", "y", "width", "height")
    return rows.groupBy("video_id").transformWithState(TrackingProcessor(idle_ms), TRACKED, "append", "EventTime")


class GateProcessor(_Timed):
    """Holds a paused video's frames and passes them on at its resume. Held frames are a list in the state store, each written
    once; a batch of a running video reads and writes none."""

    def __init__(self, columns: tuple[tuple[str, str], ...], idle_ms: int):
        super().__init__(idle_ms)
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "state string")
        self.held = handle.getListState("held", ", ".join(f"{n} {t}" for n, t in self.columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [n for n, _ in self.columns]
        state = self.meta.get()[0] if self.meta.exists() else RUNNING
        rank = {"cancel": 0, "resume": 1, "pause": 2}
        fresh: list[tuple] = []  # frames to hold
        for r in sorted(rows, key=lambda r: (r.order, rank.get(r.command, 3))):
            if state == CANCELLED:
                continue
            if r.command is None:
                values = tuple(getattr(r, n) for n in names)
                if state == PAUSED:
                    fresh.append(values)
                else:
                    yield Row(video_id=key[0], **dict(zip(names, values)))
            elif r.command == "pause":
                state = PAUSED
            else:
                if r.command == "resume":
                    for values in [*self.held.get(), *fresh]:
                        yield Row(video_id=key[0], **dict(zip(names, values)))
                self.held.clear()
                fresh, state = [], RUNNING if r.command == "resume" else CANCELLED
        if fresh:
            self.held.appendList(fresh)
        self.meta.update((state,))


def gated(events: DataFrame) -> DataFrame:
    """The frames that operators.controls.gated would release, as soon as they are, on a stream of frames and controls (order, command and the
    columns of frames; command is null for a frame). Rows of a video must come in order between batches."""
    columns = tuple((f.name, f.dataType.simpleString()) for f in events.schema if f.name not in ("video_id", "command"))
    schema = "video_id bigint, " + ", ".join(f"{n} {t}" for n, t in columns)
    return events.groupBy("video_id").transformWithState(GateProcessor(columns, 0), schema, "append", "None")
