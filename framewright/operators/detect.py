"""Detection and comparison over frame tables, by Arrow batches. Only the luma plane is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

FULL = (0.0, 0.0, 1.0, 1.0)
#: What "auto" tries, in this order.
AUTO = ("projection-band", "integral-band")
#: Detectors that a worker keeps, one for each size and setting.
KEPT = 64


class Unsupported(ValueError):
    """A detector that cannot run here, or not on such frames."""


@dataclass(frozen=True)
class Setting:
    """What a detector is made for."""

    width: int
    height: int
    stride: int
    target: int = 230
    delta: int = 12
    roi: tuple[float, float, float, float] = FULL

    def checked(self) -> Setting:
        if min(self.width, self.height) <= 0 or self.stride < self.width:
            raise Unsupported(f"no frames of {self.width} x {self.height} with a stride of {self.stride}")
        if not (0 <= self.target <= 255 and 0 <= self.delta <= 255):
            raise Unsupported("target and delta are bytes")
        try:
            K.roi_pixels(self.width, self.height, self.roi)
        except ValueError as e:
            raise Unsupported(str(e)) from None
        return self


def _band_detector(kind: str) -> Callable[[Setting], Callable[[bytes], list[K.Region]]]:
    def make(s: Setting) -> Callable[[bytes], list[K.Region]]:
        kernel, (x0, y0, x1, y1) = K.DETECTORS[kind], K.roi_pixels(s.width, s.height, s.roi)
        more = {"frame_area": s.width * s.height} if kind == "integral-band" else {}
        return lambda data: kernel(K.plane(data, s.width, s.height, s.stride)[y0:y1, x0:x1], s.target, s.delta, origin=(x0, y0), **more)

    return make


#: name -> what makes a detector for a setting, or raises Unsupported.
MAKERS: dict[str, Callable[[Setting], Callable[[bytes], list[K.Region]]]] = {kind: _band_detector(kind) for kind in AUTO}


def preflight(kind: str, setting: Setting, makers: dict | None = None) -> str:
    """The name of the detector that will run: kind, or for auto the first that can be made. Unsupported tells why none can."""
    makers, reasons = MAKERS if makers is None else makers, []
    setting.checked()
    for name in AUTO if kind == "auto" else (kind,):
        try:
            if name not in makers:
                raise Unsupported("unknown")
            makers[name](setting)
            return name
        except Unsupported as e:
            reasons.append(f"{name}: {e}")
    raise Unsupported("; ".join(reasons))


@lru_cache(maxsize=KEPT)
def built(kind: str, setting: Setting) -> Callable[[bytes], list[K.Region]]:
    """A detector; a worker makes one for each setting that it meets."""
    return MAKERS[preflight(kind, setting)](setting)


def detected(frames: DataFrame, detector: str = "projection-band", target: int = 230, delta: int = 12, roi: tuple = FULL, margin: int = 5) -> DataFrame:
    """video_id, frame_index, ord, x, y, width, height, score from frames (video_id, frame_index, width, height,
    y_stride, y_plane); regions are inflated by the margin inside the frame. A frame without regions gives no row. detector: a name of
    MAKERS, or auto."""
    if detector != "auto" and detector not in MAKERS:
        raise Unsupported(f"no detector {detector!r}")

    target_schema = pa.schema([("video_id", pa.int64()), ("frame_index", pa.int64()), ("ord", pa.int32()), *((c, pa.float32()) for c in ("x", "y", "width", "height", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, planes = [], b.column("y_plane")
            # A plane is looked at where it lies in the batch.
            for at, (video, frame, width, height, stride) in enumerate(zip(*(b.column(c).to_pylist() for c in ("video_id", "frame_index", "width", "height", "y_stride")))):
                for i, (x, y, w, h, s) in enumerate(built(detector, Setting(width, height, stride, target, delta, roi))(planes[at].as_buffer())):
                    left, top = max(x - margin, 0), max(y - margin, 0)
                    out.append((video, frame, i, float(left), float(top), float(min(x + w + margin, width) - left), float(min(y + h + margin, height) - top), s))
            columns = zip(*out) if out else [()] * len(target_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target_schema)], schema=target_schema)

    rows = frames.select("video_id", "frame_index", "width", "height", "y_stride", "y_plane")
    return rows.mapInArrow(run, "video_id bigint, frame_index bigint, ord int, x float, y float, width float, height float, score float")


def compared(pairs: DataFrame, comparator: str = "bitset-cover", target: int = 230, delta: int = 12) -> DataFrame:
    """a, b, similarity, same from pairs (a, b, a_plane, b_plane, width, height) of planes without a stride."""
    features, compare = K.COMPARATORS[comparator]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch.itertuples(index=False):
                x, y = (features(K.plane(v, p.width, p.height, p.width), target, delta) for v in (p.a_plane, p.b_plane))
                out.append((p.a, p.b, *compare(x, y)))
            yield pd.DataFrame(out, columns=["a", "b", "similarity", "same"])

    return pairs.mapInPandas(run, "a bigint, b bigint, similarity double, same boolean")


def chamfer_points(images: DataFrame, target: int, delta: int) -> DataFrame:
    """image, points, stroke; null where nothing can be extracted. images: image, plane, width, height."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [K.chamfer_features(K.plane(p.plane, p.width, p.height, p.width), target, delta) for p in b.itertuples(index=False)]
            yield pd.DataFrame({"image": b["image"], "points": [None if f is None else len(f.points) for f in found], "stroke": [None if f is None else float(f.stroke) for f in found]}).astype({"points": "Int64"}).astype({"points": object}).where(lambda d: d.notna(), None)

    return images.mapInPandas(run, "image bigint, points bigint, stroke double")


def spotted(frames: DataFrame, width: int, height: int, wide: int = 1, dark: int = 40, bright: int = 235) -> DataFrame:
    """Frames of video 0 from frame_index and at, the places (row * width + column) of bright spots; a spot is wide
    pixels wide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            planes = []
            for at in b["at"]:
                y = np.full(width * height, dark, np.uint8)
                y[np.asarray(at, int)] = bright
                planes.append(np.repeat(y.reshape(height, width), wide, axis=1).tobytes())
            yield pd.DataFrame({"video_id": 0, "frame_index": b["frame_index"], "width": width * wide, "height": height, "y_stride": width * wide, "y_plane": planes})

    return frames.select("frame_index", "at").mapInPandas(run, "video_id bigint, frame_index bigint, width int, height int, y_stride int, y_plane binary")


def drawn_frames(spark, frames: int = 60, width: int = 320, height: int = 180, boxes=((40, 120, 200, 30, 10, 39), (60, 20, 120, 28, 25, 54))) -> DataFrame:
    """Grey frames with white rectangles (x, y, width, height, first, last frame), 40 ms apart: a video whose
    answer is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            planes = []
            for i in b["frame_index"]:
                y = np.full((height, width), 40, np.uint8)
                for x, top, w, h, first, last in boxes:
                    if first <= i <= last:
                        y[top : top + h, x : x + w] = 235
                planes.append(y.tobytes())
            yield b.assign(width=width, height=height, y_stride=width, y_plane=planes)

    rows = spark.range(frames).selectExpr("0L AS video_id", "id AS frame_index", "id * 40000000L AS pts_ns")
    return rows.mapInPandas(run, "video_id bigint, frame_index bigint, pts_ns bigint, width int, height int, y_stride int, y_plane binary")


#: Width and height of the planes of titled(), frames for each vector, and vectors whose planes a task holds.
TITLE_SIZE, TITLE_FRAMES, TITLED = (128, 64), 14, 4


def titled(vectors: DataFrame) -> DataFrame:
    """Planes with titles, made from vectors (vec_id, embedding): twenty vectors make a video, and each gives TITLE_FRAMES
    frames. From the third of them on its first 64 numbers are shown as 8 rows of 8 cells, bright where a number isn't low;
    the first number tells for how long. Every third vector flickers: one of its frames shows the other cells."""
    width, height = TITLE_SIZE
    blank = np.full((height, width), 40, np.uint8)
    target = pa.schema([("video_id", pa.int64()), ("frame_index", pa.int64()), *((c, pa.int32()) for c in ("width", "height", "y_stride")), ("y_plane", pa.binary())])

    def drawn(cells: np.ndarray) -> bytes:
        y = blank.copy()
        y[30:54, 16:112] = np.where(cells.repeat(3, 0).repeat(12, 1), 235, 40)
        return y.tobytes()

    def shown(vec: int, e: list | None) -> list[bytes]:
        numbers = np.full(64, -1.0)
        given = np.asarray([] if e is None else e, float)[:64]
        numbers[: len(given)] = np.nan_to_num(given, nan=-1.0)
        cells = (numbers > -0.03).reshape(8, 8)
        long = 4 + int(min(max((numbers[0] + 0.6) / 1.2, 0.0), 0.999) * 9)
        planes = [blank.tobytes()] * TITLE_FRAMES
        if len(given):
            planes[2 : 2 + long] = [drawn(cells)] * long
            if vec % 3 == 0 and vec % 5 < long:
                planes[2 + vec % 5] = drawn(~cells)
        return planes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TITLED):
                part = b.slice(at, TITLED)
                vecs = part.column("vec_id").to_pylist()
                planes = [p for vec, e in zip(vecs, part.column("embedding").to_pylist()) for p in shown(vec, e)]
                videos = np.repeat([vec // 20 for vec in vecs], TITLE_FRAMES)
                index = np.concatenate([vec % 20 * TITLE_FRAMES + np.arange(TITLE_FRAMES) for vec in vecs])
                sizes = [np.full(len(planes), n, np.int32) for n in (width, height, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((videos, index, *sizes, planes), target)], schema=target)

    return vectors.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(run, "video_id bigint, frame_index bigint, width int, height int, y_stride int, y_plane binary")
