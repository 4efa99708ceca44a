"""Greedy tracking of boxes by overlap, as a step over one detection of each of many videos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: less overlap than this makes a new region.
MIN_IOU = np.float32(0.05)
Box = tuple[np.float32, np.float32, np.float32, np.float32]


def box_area(b: Box) -> np.float32:
    return max(b[2], np.float32(0)) * max(b[3], np.float32(0))


def overlap(a: Box, b: Box) -> Box | None:
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    return (x0, y0, x1 - x0, y1 - y0) if x1 > x0 and y1 > y0 else None


def remainder(old: Box, new: Box) -> Box | None:
    """The largest strip of old beside its overlap with new; the last of equal ones."""
    c = overlap(old, new)
    if c is None:
        return None
    zero = np.float32(0)
    x, y, w, h = old
    low, far = c[1] + c[3], c[0] + c[2]
    strips = [(x, y, w, max(c[1] - y, zero)), (x, min(low, y + h), w, max(y + h - low, zero)), (x, y, max(c[0] - x, zero), h), (min(far, x + w), y, max(x + w - far, zero), h)]
    best = None
    for s in strips:
        if s[2] > 0 and s[3] > 0 and (best is None or box_area(s) >= box_area(best)):
            best = s
    return best


class Tracker:
    """Regions are kept for good, by id; of equal overlaps the least id wins."""

    def __init__(self, boxes=(), used=(), frame: int | None = None):
        self.n, self.frame = len(boxes), frame
        self.boxes = np.zeros((max(16, 2 * self.n), 4), np.float32)
        self.used = np.zeros(len(self.boxes), bool)
        if self.n:
            self.boxes[: self.n] = boxes
            self.used[list(used)] = True

    def _new(self, box: Box) -> int:
        if self.n == len(self.boxes):
            self.boxes, self.used = np.concatenate([self.boxes, np.zeros_like(self.boxes)]), np.concatenate([self.used, np.zeros_like(self.used)])
        self.boxes[self.n], self.used[self.n] = box, True
        self.n += 1
        return self.n - 1

    def _best(self, box: Box) -> int | None:
        held = self.boxes[: self.n]
        x, y, w, h = held.T
        wide = np.minimum(x + w, box[0] + box[2]) - np.maximum(x, box[0])
        high = np.minimum(y + h, box[1] + box[3]) - np.maximum(y, box[1])
        common = np.where((wide > 0) & (high > 0), wide * high, np.float32(0))
        union = np.maximum(w, 0) * np.maximum(h, 0) + box_area(box) - common
        iou = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        iou[self.used[: self.n]] = -1
        best = int(iou.argmax()) if self.n else -1
        return best if best >= 0 and iou[best] >= MIN_IOU else None

    def add(self, frame: int, box: Box) -> list[tuple[int, Box]]:
        """The regions that a detection gives: first what it leaves of a region that it has outgrown, then its own."""
        if frame != self.frame:
            self.frame = frame
            self.used[:] = False
        best = self._best(box)
        if best is None:
            return [(self._new(box), box)]
        old = tuple(self.boxes[best])
        self.boxes[best], self.used[best] = box, True
        out = []
        if box_area(box) > box_area(old) and (left := remainder(old, box)) is not None:
            out.append((self._new(left), left))
        return [*out, (best, box)]


def _areas(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(boxes[2], np.float32(0)) * np.maximum(boxes[3], np.float32(0))


def _remainders(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """remainder of each column of old and new (4 x n), and whether there is one."""
    zero = np.float32(0)
    x, y, w, h = old
    cx, cy = np.maximum(x, new[0]), np.maximum(y, new[1])
    cw, ch = np.minimum(x + w, new[0] + new[2]) - cx, np.minimum(y + h, new[1] + new[3]) - cy
    low, far = cy + ch, cx + cw
    # The last of equal ones comes first here.
    strips = np.stack([
        [np.minimum(far, x + w), y, np.maximum(x + w - far, zero), h],
        [x, y, np.maximum(cx - x, zero), h],
        [x, np.minimum(low, y + h), w, np.maximum(y + h - low, zero)],
        [x, y, w, np.maximum(cy - y, zero)],
    ])
    areas = np.where((strips[:, 2] > 0) & (strips[:, 3] > 0), strips[:, 2] * strips[:, 3], np.float32(-1))
    best, at = areas.argmax(0), np.arange(len(x))
    # Two boxes that overlap enough to be one region have a common part.
    return strips[best, :, at].T, areas[best, at] >= 0


class Lanes:
    """Trackers of several videos side by side, each a lane of the arrays, the longest first: a step adds one detection to each of
    the first lanes."""

    def __init__(self, lanes: int, room: int = 16):
        self.boxes, self.used, self.n = np.zeros((4, lanes, room), np.float32), np.ones((lanes, room), bool), np.zeros(lanes, np.int64)

    def load(self, lane: int, t: Tracker) -> None:
        self.reserve(t.n + 1)
        self.n[lane], self.boxes[:, lane, : t.n], self.used[lane, : t.n] = t.n, t.boxes[: t.n].T, t.used[: t.n]

    def saved(self, lane: int, frame: int | None) -> Tracker:
        n = self.n[lane]
        return Tracker(self.boxes[:, lane, :n].T, np.flatnonzero(self.used[lane, :n]), frame)

    def reserve(self, n: int) -> None:
        if (more := n - self.used.shape[1]) > 0:
            more = max(more, self.used.shape[1])
            self.boxes, self.used = np.pad(self.boxes, ((0, 0), (0, 0), (0, more))), np.pad(self.used, ((0, 0), (0, more)), constant_values=True)

    def _new(self, lanes: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        ids = self.n[lanes]
        self.boxes[:, lanes, ids], self.used[lanes, ids] = boxes, True
        self.n[lanes] += 1
        return ids

    def add(self, box: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A box (4 x m) for each of the first m lanes, fresh where it is the first of its frame: the region of each; the region of
        what it leaves, -1 for none; and that rest. As Tracker.add."""
        m = box.shape[1]
        lanes, most = np.arange(m), int(self.n[:m].max())
        self.reserve(most + 2)
        if fresh.any():
            self.used[:m][fresh] = np.arange(self.used.shape[1]) >= self.n[:m][fresh, None]
        held = self.boxes[:, :m, : max(most, 1)]
        wide = np.minimum(held[0] + held[2], (box[0] + box[2])[:, None]) - np.maximum(held[0], box[0][:, None])
        high = np.minimum(held[1] + held[3], (box[1] + box[3])[:, None]) - np.maximum(held[1], box[1][:, None])
        common = np.where((wide > 0) & (high > 0), wide * high, np.float32(0))
        union = _areas(held) + _areas(box)[:, None] - common
        iou = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        iou[self.used[:m, : held.shape[2]]] = -1
        best = iou.argmax(1)
        hit = iou[lanes, best] >= MIN_IOU
        ids, rest, left = best.copy(), np.full(m, -1), np.zeros((4, m), np.float32)
        ids[~hit] = self._new(lanes[~hit], box[:, ~hit])
        old = self.boxes[:, lanes, best]
        self.boxes[:, lanes[hit], best[hit]], self.used[lanes[hit], best[hit]] = box[:, hit], True
        grown = np.flatnonzero(hit & (_areas(box) > _areas(old)))
        if len(grown):
            strips, some = _remainders(old[:, grown], box[:, grown])
            grown, strips = grown[some], strips[:, some]
            rest[grown], left[:, grown] = self._new(grown, strips), strips
        return ids, rest, left


#: A video with this many regions is tracked on its own, so that it doesn't widen the lanes of others.
ALONE = 512


def _through(held: Tracker | None, lengths: np.ndarray, boxes: np.ndarray, fresh: np.ndarray, frames: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tracker]:
    """Videos of these lengths, one after the other in boxes (4 x rows), the first of them carried on from held: the region of
    each box, of what it leaves, and that rest; and the state of the last video."""
    first, rows = np.cumsum(lengths) - lengths, boxes.shape[1]
    ids, rest, left, state = np.zeros(rows, np.int64), np.full(rows, -1), np.zeros((4, rows), np.float32), held
    groups = [np.arange(len(lengths))]
    if held is not None and held.n >= ALONE:
        groups = [groups[0][:1], groups[0][1:]]
    for group in filter(len, groups):
        order = group[np.argsort(-lengths[group], kind="stable")]
        lanes, at = Lanes(len(order)), {v: i for i, v in enumerate(order.tolist())}
        if held is not None and 0 in at:
            lanes.load(at[0], held)
        active = len(order) - np.searchsorted(np.sort(lengths[order]), np.arange(lengths[order[0]]), "right")
        for k, m in enumerate(active.tolist()):
            r = first[order[:m]] + k
            ids[r], rest[r], left[:, r] = lanes.add(boxes[:, r], fresh[r])
        if (last := len(lengths) - 1) in at:
            state = lanes.saved(at[last], frames[-1])
    return ids, rest, left, state


def tracked(regions: DataFrame) -> DataFrame:
    """video_id, frame_index, ord, region_id, label, x, y, width, height from detections in the order of ord. Videos are sorted by
    Spark within hash partitions; a task holds a batch of detections and the regions of the last video."""
    names = ("x", "y", "width", "height")
    out = pa.schema([("video_id", pa.int64()), ("frame_index", pa.int64()), ("ord", pa.int32()), ("region_id", pa.int64()), *((c, pa.float32()) for c in names)])

    def starts(column: pa.Array) -> np.ndarray:
        """Where a value differs from the one before, nulls being one value; the first row counts as not different."""
        v, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        return np.concatenate([[False], (v[1:] != v[:-1]) | (null[1:] != null[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = starts(b.column("video_id"))
            fresh, frame, own = new | starts(b.column("frame_index")), b.column("frame_index"), b.column("video_id")
            held = state if state is not None and own[0].as_py() == video else None
            fresh[0] = held is None or frame[0].as_py() != held.frame
            boxes = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in names])
            first = np.concatenate([[0], np.flatnonzero(new)])
            ids, rest, left, state = _through(held, np.diff(np.append(first, b.num_rows)), boxes, fresh, [frame[-1].as_py()])
            video = own[-1].as_py()
            # A row for what is left, if anything is, then the box's own.
            row = np.repeat(np.arange(b.num_rows), 1 + (rest >= 0))
            is_rest = np.concatenate([row[1:] == row[:-1], [False]])
            shown = np.where(is_rest, left[:, row], boxes[:, row])
            keys = [b.column(c).take(pa.array(row)).cast(out.field(c).type) for c in ("video_id", "frame_index", "ord")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.where(is_rest, rest[row], ids[row])), *map(pa.array, shown)], schema=out)

    rows = regions.select("video_id", "frame_index", "ord", *[F.col(c).cast("double").alias(c) for c in names])
    schema = "video_id bigint, frame_index bigint, ord int, region_id bigint, x float, y float, width float, height float"
    found = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_index", "ord").mapInArrow(run, schema)
    return found.select("video_id", "frame_index", "ord", "region_id", F.concat(F.lit("region-"), F.col("region_id").cast("string")).alias("label"), *names)
