"""From planes to subtitles: the whole flow over luma planes that are stored apart from the metadata of their frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import detect as D
from ..operators import lifecycle as L
from ..operators import recognise as R
from ..operators import sampling as S
from ..operators import segments as C
from ..operators.tracking import tracked
from ..session import table
from ..sources import planes as P
from ..sources import srt

WIDTH, HEIGHT = D.TITLE_SIZE
#: Frames are 40 ms apart.
FRAME_NS = 40_000_000


def _planes(spark, d):
    """Every vector as FRAMES frames, in which its numbers are shown as a title for a while; twenty vectors a video."""
    return P.stored(D.titled(table(spark, d, "embeddings").select("vec_id", "embedding")))


def _timeline(planes):
    """Metadata alone: which frames there are, and which are samples."""
    return S.with_sampled(planes.select("video_id", "frame_index", (F.col("frame_index") * FRAME_NS).alias("pts_ns")), tail=True).drop("second")


def _regions(planes, frames, detector="projection-band"):
    """Detected in the planes of samples only, then tracked."""
    sampled = frames.where("sampled").select("video_id", "frame_index")
    found = D.detected(planes.join(sampled.hint("shuffle_hash"), ["video_id", "frame_index"]), detector)
    share = [(F.col(c) / size).alias(c) for c, size in (("x", WIDTH), ("y", HEIGHT), ("width", WIDTH), ("height", HEIGHT))]
    return P.kept(tracked(found.select("video_id", "frame_index", "ord", *share)), "regions")


def _followed(spark, d, kind="bitset-cover"):
    planes = _planes(spark, d)
    frames = _timeline(planes)
    return planes, L.plane_lifecycles(frames, _regions(planes, frames), planes, L.plane_comparator(kind))


def _lifecycles(kind):
    def run(spark, d):
        out = _followed(spark, d, kind)[1]
        return out.select("video_id", "region_id", "opened_frame", "start_frame", "start_ns", "last_frame", "end_frame", "end_ns", "closed_at", "place")

    return run


def _read(spark, d):
    """Valid segments with the texts that the engine reads in the crop of the frame that represents them."""
    planes, segments = _followed(spark, d)
    shown = L.presented(L.valid(segments, WIDTH, HEIGHT), planes.select("video_id", "frame_index"), WIDTH, HEIGHT)
    crops = P.cropped(shown.select("video_id", "region_id", "place", "start_ns", "end_ns", "start_frame", "end_frame", "center", "bounds"), planes).drop("bounds")
    return R.with_engine(crops, R.bar_reader).drop("crop", "crop_width").withColumn("text", T.normalised_text(T.joined_texts(F.transform("texts", lambda t: t["text"]))))


def _texts(spark, d):
    return _read(spark, d).select("video_id", "region_id", "place", "start_frame", "end_frame", "text")


def _subtitles(spark, d):
    order = Window.partitionBy("video_id").orderBy("place")
    cues = _read(spark, d).where("text <> ''").withColumn("ord", F.row_number().over(order).cast("long"))
    rows = srt.numbered(C.merged_cues(cues)).where("block is not null")
    texts = F.array_join(F.transform("lines", lambda x: x["text"]), "|").alias("texts")
    return rows.select("video_id", "number", "start_ns", "end_ns", "start_frame", texts, "block")


QUERIES = {
    "plane_lifecycles": _lifecycles("bitset-cover"),
    "plane_lifecycles_chamfer": _lifecycles("sparse-chamfer"),
    "plane_texts": _texts,
    "plane_subtitles": _subtitles,
}
#: Detectors, comparators and a recogniser are beyond SQL; tests/test_planes.py holds the flow against a plain simulator.
ORACLES: dict[str, str] = {}
