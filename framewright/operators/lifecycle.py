"""Life cycles of regions: a sample without a region's span opens one, samples with the same content carry it on, others leave
it as it is, and the first sample without the region ends it. Both ends are then moved over the frames between samples.

Two forms give the same rows:

* ``lifecycles``: one ordered pass over a video's frames, for content that is small enough to travel with them. It holds the
  frames of a second (MAX_HISTORY at most) and the open spans, so a video of any length needs no more.
* ``plane_lifecycles``: for planes in a store of their own. Metadata alone decides which frames may matter; only these are
  fetched, each is reduced to features where it lies, and only features are sorted and folded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..sources import planes as P
from . import kernels as K
from . import sampling as S
from .ordered import fold_sorted

Roi = tuple[float, float, float, float]


class Comparator(NamedTuple):
    """extract(row, roi) gives features or None; same(a, b) tells whether two are of one segment. columns: what extract
    reads of a frame's row. together(rows, rois), where there is such, gives what extract gives for each; narrow(frame, roi)
    gives, from what makes columns of names, the columns that it reads instead: the frame without what lies off the region."""

    extract: Callable[[Any, Roi], Any]
    same: Callable[[Any, Any], bool]
    columns: tuple[str, ...]
    together: Callable[[Iterable, Iterable[Roi]], list] | None = None
    narrow: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]] | None = None


def value_comparator(limit: float, column: str = "value") -> Comparator:
    """Features are a number of the frame."""
    return Comparator(lambda row, roi: getattr(row, column), lambda a, b: abs(a - b) <= limit, (column,))


def plane_comparator(kind: str = "bitset-cover", target: int = 230, delta: int = 12) -> Comparator:
    """Features are those of the region's part of the luma plane."""
    (features, compare), many = K.COMPARATORS[kind], K.TOGETHER.get(kind)
    same = K.SAME.get(kind) or (lambda a, b: compare(a, b)[1])

    def cut(row, roi: Roi):
        x0, y0, x1, y1 = K.roi_pixels_never_empty(row.width, row.height, roi)
        return K.plane(row.y_plane, row.width, row.height, row.y_stride)[y0:y1, x0:x1]

    def cut_lines(row, roi: Roi):
        x0, y0, x1, y1 = K.roi_pixels_never_empty(row.width, row.height, roi)
        return K.plane(row.y_plane, row.width, row.lines, row.y_stride)[y0 - row.first : y1 - row.first, x0:x1]

    def together(rows: Iterable, rois: Iterable[Roi]) -> list:
        return many(map(cut_lines, rows, rois), target, delta)

    def narrow(frame: Callable[[str], Column], roi: Callable[[str], Column]) -> dict[str, Column]:
        """The lines of the region and one more on each side, as its place is rounded otherwise here; a plane that is too short stays whole."""
        width, height, stride, data = (frame(c) for c in ("width", "height", "y_stride", "y_plane"))
        low, high = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * height for v in (roi("y"), roi("y") + roi("height")))
        first = F.greatest(F.least(F.floor(low) - 1, height - 2), F.lit(0)).cast("int")
        lines = (F.least(F.greatest(F.ceil(high) + 1, first + 3), height) - first).cast("int")
        sound = (stride >= width) & (stride > 0) & (F.octet_length(data) >= stride * height)
        part = F.when(sound, F.substring(data, first * stride + 1, lines * stride)).otherwise(data)
        return {"width": width, "height": height, "y_stride": stride, "y_plane": part, "first": F.when(sound, first).otherwise(0), "lines": F.when(sound, lines).otherwise(height)}

    extract = lambda row, roi: features(cut(row, roi), target, delta)
    return Comparator(extract, same, ("width", "height", "y_stride", "y_plane"), many and together, many and narrow)


def walk(found: Iterable[tuple], reference, same: Callable[[Any, Any], bool], follow: bool) -> Iterator[tuple]:
    """The frames of (frame, features) that show what reference shows. The first match takes its place, and with follow each
    later one as well."""
    first = True
    for frame, features in found:
        if features is not None and same(reference, features):
            if first or follow:
                reference, first = features, False
            yield frame, reference


class Span(NamedTuple):
    """An open region. content: what the next sample has to show; start, last: frame and time."""

    label: str
    roi: Roi
    content: Any
    opened: int
    start: tuple[int, int]
    last: tuple[int, int]


class Timeline:
    """A video's frames, in order, with the spans open at the last of them."""

    def __init__(self, comparator: Comparator):
        self.extract, self.same = comparator.extract, comparator.same
        self.spans: dict[int, Span] = {}
        self.recent: deque = deque()
        self.ahead: list = []  # what was recent at the last sample
        self.at = self.fps = self.before = None
        self.extracts = self.compares = self.ended = 0

    def read(self, frames: Iterable, roi: Roi) -> Iterator[tuple]:
        for f in frames:
            self.extracts += 1
            yield f, self.extract(f, roi)

    def alike(self, a, b) -> bool:
        self.compares += 1
        return self.same(a, b)

    def stamp(self, frame, otherwise: int = 0) -> tuple[int, int]:
        """A frame's index and time; without a time, the index over the frame rate."""
        if frame.pts_ns is None:
            return frame.frame_index, int(frame.frame_index / self.fps * 1e9) if self.fps else otherwise
        return frame.frame_index, frame.pts_ns

    def add(self, frame) -> list[tuple]:
        """The spans that this frame ends."""
        self.fps, self.before = S.new_estimate(self.fps, self.before, frame)
        self.recent.append(frame)
        while len(self.recent) > S.capacity(self.fps):
            self.recent.popleft()
        if not frame.sampled:
            return []
        self.ahead, self.at = list(self.recent), frame.frame_index
        shown = {}
        for r in frame.regions or ():
            roi = (r["x"], r["y"], r["width"], r["height"])
            ((_, content),) = self.read([frame], roi)
            if content is not None:
                shown[r["region_id"]] = self.carried(r["region_id"], frame, r["label"], roi, content)
        gone = sorted(self.spans.keys() - shown.keys())
        out = [self.end(i) for i in gone]
        self.spans.update(shown)
        return out

    def carried(self, ident: int, frame, label: str, roi: Roi, content) -> Span:
        here = self.stamp(frame)
        if (span := self.spans.get(ident)) is not None:
            return span._replace(roi=roi, content=content, last=here) if self.alike(span.content, content) else span
        start, earlier = here, (f for f in reversed(self.recent) if f.frame_index < frame.frame_index)
        for f, content in walk(self.read(earlier, roi), content, self.alike, follow=False):
            start = self.stamp(f, start[1])
        return Span(label, roi, content, frame.frame_index, start, here)

    def end(self, ident: int) -> tuple:
        span = self.spans.pop(ident)
        frame, time = span.last
        later = (f for f in self.ahead if f.frame_index > frame)
        for f, _ in walk(self.read(later, span.roi), span.content, self.alike, follow=True):
            frame, time = f.frame_index, time if f.pts_ns is None else f.pts_ns
        self.ended += 1
        return (ident, span.label, span.opened, *span.start, span.last[0], frame, time, *span.roi, self.at, self.ended - 1)

    def finish(self) -> list[tuple]:
        return [self.end(i) for i in sorted(self.spans)]


SEGMENT = "region_id bigint, label string, opened_frame bigint, start_frame bigint, start_ns bigint, last_frame bigint, end_frame bigint, end_ns bigint, x double, y double, width double, height double, closed_at bigint, place bigint"


def _through(frames: DataFrame, comparator: Comparator, give: Callable[[Timeline, Any], list[tuple]], schema: str) -> DataFrame:
    def step(state: list, row) -> list[tuple]:
        if not state:
            state += [row.video_id, Timeline(comparator)]
        return [(state[0], *x) for x in give(state[1], row)]

    rows = frames.select("video_id", "frame_index", "pts_ns", "sampled", "regions", *comparator.columns)
    return fold_sorted(rows, ["video_id"], ["frame_index"], list, step, f"video_id bigint, {schema}")


def lifecycles(frames: DataFrame, comparator: Comparator) -> DataFrame:
    """A row for each span of each video, with the sampled frame that ended it and its place among them; spans that end
    together end in the order of their ids. frames: video_id, frame_index, pts_ns, sampled, regions
    (array<struct<region_id, label, x, y, width, height>>, parts of a frame) and what the comparator reads. end_frame is also the
    frame that represents the segment."""
    return _through(frames, comparator, lambda t, row: t.finish() if row is None else t.add(row), SEGMENT)


def work(frames: DataFrame, comparator: Comparator) -> DataFrame:
    """video_id, extracts, compares: how often a video's regions were read and compared."""

    def give(t: Timeline, row) -> list[tuple]:
        t.finish() if row is None else t.add(row)
        return [(t.extracts, t.compares)] if row is None else []

    return _through(frames, comparator, give, "extracts bigint, compares bigint")


def with_regions(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """frames with the regions (video_id, frame_index, region_id, label, x, y, width, height) of each, in order of id."""
    one = F.struct("region_id", "label", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    lists = regions.groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list(one)).alias("regions"))
    return frames.join(lists, ["video_id", "frame_index"], "left")


ROI = ["x", "y", "width", "height"]
SPAN = ["video_id", "region_id", "opened_frame"]


def _spans(looks: DataFrame, samples: DataFrame) -> DataFrame:
    """looks with the number of their sample and opened_frame, the first frame of a run of samples that show the region."""
    numbered = looks.join(samples.select("video_id", "frame_index", "number", "pts_ns", "fps"), ["video_id", "frame_index"])
    of_region = Window.partitionBy("video_id", "region_id")
    run = F.col("number") - F.row_number().over(of_region.orderBy("number"))
    return numbered.withColumn("run", run).withColumn("opened_frame", F.min("frame_index").over(Window.partitionBy("video_id", "region_id", "run"))).drop("run")


#: Answers that a span keeps for what it shows.
ANSWERS = 8


class Shown:
    """What a span shows, as packed features. Frames with the same features get the same answer, and features are unpacked
    only when they are compared."""

    def __init__(self, comparator: Comparator, data: bytes):
        self.same, self.data, self.content = comparator.same, data, None
        self.answers: dict[bytes, bool] = {}

    def alike(self, data: bytes | None) -> bool:
        if data is None:
            return False
        if data not in self.answers:
            if self.content is None:
                self.content = P.unpacked(self.data)
            if len(self.answers) == ANSWERS:
                self.answers.clear()
            self.answers[data] = self.same(self.content, P.unpacked(data))
        return self.answers[data]

    def take(self, data: bytes) -> None:
        if data != self.data:
            self.data, self.content, self.answers = data, None, {}


def _started(spans: DataFrame, earlier: DataFrame, comparator: Comparator) -> DataFrame:
    """A row for each span: where it starts, its last sample with the same content, and that content. A span's events are its
    first sample, the frames before that, backwards, and the later samples."""
    columns = [*SPAN, "label", *ROI, "frame_index", "pts_ns", "fps", "features"]
    first = F.when(F.col("frame_index") == F.col("opened_frame"), 0).otherwise(2)
    events = spans.select(*columns, first.alias("kind"), F.col("number").alias("turn"))
    events = events.unionByName(earlier.select(*columns, F.lit(1).alias("kind"), (-F.col("frame_index")).alias("turn")))

    def time(row, otherwise: int = 0) -> int:
        return row.pts_ns if row.pts_ns is not None else int(row.frame_index / row.fps * 1e9) if row.fps else otherwise

    def step(s: dict, row) -> list[tuple]:
        if row is None:
            return [(*s["key"], s["label"], *s["start"], *s["last"], *s["roi"], s["shown"].data)]
        here = (row.frame_index, time(row))
        if row.kind == 0:
            s.update(key=(row.video_id, row.region_id, row.opened_frame), label=row.label, start=here, last=here, roi=[getattr(row, c) for c in ROI], shown=Shown(comparator, row.features), moved=False)
        elif s["shown"].alike(row.features):
            if row.kind == 2:
                s.update(last=here, roi=[getattr(row, c) for c in ROI])
                s["shown"].take(row.features)
            else:
                if not s["moved"]:
                    s["shown"].take(row.features)
                s.update(start=(row.frame_index, time(row, s["start"][1])), moved=True)
        return []

    schema = "video_id bigint, region_id bigint, opened_frame bigint, label string, start_frame bigint, start_ns bigint, last_frame bigint, last_ns bigint, x double, y double, width double, height double, content binary"
    return fold_sorted(events, SPAN, ["kind", "turn"], dict, step, schema)


def _ended(started: DataFrame, later: DataFrame, comparator: Comparator) -> DataFrame:
    """started with end_frame and end_ns: on through the frames after the last sample, as long as each shows what the last
    match showed."""
    names = [c for c in started.columns if c != "content"]
    nothing = [F.lit(None).cast(started.schema[c].dataType).alias(c) for c in names if c not in SPAN]
    events = started.select(*names, F.lit(-1).cast("long").alias("frame_index"), F.lit(None).cast("long").alias("pts_ns"), F.col("content").alias("features"))
    events = events.unionByName(later.select(*SPAN, *nothing, "frame_index", "pts_ns", "features"))

    def step(s: dict, row) -> list[tuple]:
        if row is None:
            return [(*s["own"], s["frame"], s["time"])]
        if not s:
            s.update(own=[getattr(row, c) for c in names], frame=row.last_frame, time=row.last_ns, shown=Shown(comparator, row.features))
        elif s["shown"].alike(row.features):
            s.update(frame=row.frame_index, time=s["time"] if row.pts_ns is None else row.pts_ns)
            s["shown"].take(row.features)
        return []

    schema = ", ".join(f"{c} {started.schema[c].dataType.simpleString()}" for c in names)
    return fold_sorted(events, SPAN, ["frame_index"], dict, step, f"{schema}, end_frame bigint, end_ns bigint")


def plane_lifecycles(frames: DataFrame, regions: DataFrame, planes: DataFrame, comparator: Comparator) -> DataFrame:
    """As lifecycles, for planes (video_id, frame_index and what the comparator reads) that stay where they are stored.
    frames: video_id, frame_index, pts_ns, sampled. regions: those of sampled frames. Planes are read for the regions of samples, for the frames of the history
    before a span's first sample, and for those after its last one up to the sample that ends it."""
    lengths = S.history_lengths(S.fps_estimates(frames)).drop("pts_ns")
    known = P.kept(frames.select("video_id", "frame_index", "pts_ns", "sampled").join(lengths, ["video_id", "frame_index"]), "frames")
    in_order = Window.partitionBy("video_id").orderBy("frame_index")
    samples = known.where("sampled").withColumn("number", F.row_number().over(in_order).cast("long"))
    samples = samples.withColumn("closed_at", F.coalesce(F.lead("frame_index").over(in_order), F.col("frame_index")))

    def looked(wanted: DataFrame) -> DataFrame:
        return P.fetched(wanted, planes, comparator)

    rois = [F.col(c).cast("double").alias(c) for c in ROI]
    looks = looked(regions.select("video_id", "frame_index", "region_id", "label", *rois)).where("features is not null")
    spans = P.kept(_spans(looks, samples), "spans")
    first = spans.where("frame_index = opened_frame").select(*SPAN, "label", *ROI, "fps")
    reach = samples.select("video_id", F.col("frame_index").alias("opened_frame"), "ord", "length")
    past = S.history_pairs(first.join(reach, ["video_id", "opened_frame"]), known).where("past_index < opened_frame")
    earlier = looked(past.select(*SPAN, "label", *ROI, "fps", F.col("past_index").alias("frame_index"), F.col("past_pts_ns").alias("pts_ns")))
    started = P.kept(_started(spans, earlier, comparator), "started")

    last = spans.groupBy(*SPAN).agg(F.max("frame_index").alias("last_sample"))
    ends = last.join(samples.select("video_id", F.col("frame_index").alias("last_sample"), "closed_at"), ["video_id", "last_sample"]).drop("last_sample")
    ends = ends.join(samples.select("video_id", F.col("frame_index").alias("closed_at"), "ord", "length"), ["video_id", "closed_at"])
    after = S.history_pairs(started.select(*SPAN, *ROI, "last_frame").join(ends, SPAN), known).where("past_index > last_frame")
    later = looked(after.select(*SPAN, *ROI, F.col("past_index").alias("frame_index"), F.col("past_pts_ns").alias("pts_ns")))
    done = _ended(started, later, comparator).join(ends.select(*SPAN, "closed_at"), SPAN)
    # Spans that the end of the video ends come after those that its last sample does.
    done = done.join(last, SPAN).withColumn("flushed", F.col("closed_at") == F.col("last_sample"))
    order = Window.partitionBy("video_id").orderBy("closed_at", "flushed", "region_id")
    place = (F.row_number().over(order) - 1).cast("long")
    return done.withColumn("place", place).select("video_id", *[c.split()[0] for c in SEGMENT.split(", ")])


def valid(segments: DataFrame, width: int, height: int) -> DataFrame:
    roi = G.box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return segments.where(G.valid_region(roi, F.col("end_ns") - F.col("start_ns"), width, height))


def presented(segments: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """Segments with the columns of the frame that represents them, the region in pixels, its middle line (center) and
    its whole-pixel bounds; those without any pixel are left out."""
    roi = G.box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    shown = segments.withColumn("region", G.recogniser_region(roi, float(width), float(height))).withColumn("bounds", G.region_bounds(F.col("region"), width, height))
    shown = shown.where("bounds is not null").withColumn("center", F.col("region.y") + F.col("region.height") * 0.5)
    return shown.join(frames.withColumnRenamed("frame_index", "end_frame"), ["video_id", "end_frame"])
