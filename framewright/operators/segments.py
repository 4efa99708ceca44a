"""Segments: runs of presence, refined ends, and the merging of their texts into cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import fold_sorted

#: Cues merge when they overlap, or hold the same text and lie no more than this apart.
MERGE_GAP_NS = 120_000_000


def presence_runs(samples: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """group, item, start_frame, end_frame, start_ns, end_ns, n: maximal runs of consecutive samples that hold item.

    samples has one row for each sample and item, with frame_index and pts_ns; ``order`` counts a group's samples.
    """
    place = F.row_number().over(Window.partitionBy(group, item).orderBy(order))
    islands = samples.withColumn("island", F.col(order) - place)
    return islands.groupBy(group, item, "island").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.min("pts_ns").alias("start_ns"), F.max("pts_ns").alias("end_ns"), F.count(F.lit(1)).alias("n")
    ).drop("island")


def merged_cues(cues: DataFrame, group: str = "video_id", changelog: bool = False) -> DataFrame:
    """cues: group, ord (their order of arrival), start_ns, end_ns, start_frame, center, text.

    A cue joins the latest subtitle if it starts before that ends, or no later than MERGE_GAP_NS after it and with a
    text it holds. The fold runs over a group's cues in order and holds the latest subtitle only. With changelog, one row
    for each cue: kind new or updated, and the subtitle as it is then; else one row for each subtitle.
    """

    def shown(own, s: dict) -> tuple:
        head = (own, s["ord"], s["kind"]) if changelog else (own,)
        return (*head, s["id"], s["start"], s["end"], s["frame"], list(s["lines"]))

    def step(state: dict, c) -> list[tuple]:
        s = state.get("latest")
        if c is None:
            return [] if changelog else [shown(state["group"], s)]
        out = []
        if s and (c.start_ns <= s["end"] or (c.start_ns - s["end"] <= MERGE_GAP_NS and c.text in s["texts"])):
            s.update(kind="updated", ord=c.ord, start=min(s["start"], c.start_ns), end=max(s["end"], c.end_ns), frame=min(s["frame"], c.start_frame))
        else:
            if s and not changelog:
                out.append(shown(state["group"], s))
            s = {"kind": "new", "ord": c.ord, "id": s["id"] + 1 if s else 0, "start": c.start_ns, "end": c.end_ns, "frame": c.start_frame, "lines": [], "texts": set()}
            state.update(latest=s, group=c[0])
        if c.text not in s["texts"]:
            s["texts"].add(c.text)
            s["lines"].append({"center": c.center, "text": c.text})
        return [*out, shown(c[0], s)] if changelog else out

    kind = cues.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, " + ("ord bigint, kind string, " if changelog else "") + "id bigint, start_ns bigint, end_ns bigint, start_frame bigint, lines array<struct<center:double,text:string>>"
    rows = cues.select(group, "ord", "start_ns", "end_ns", "start_frame", F.col("center").cast("double").alias("center"), "text")
    return fold_sorted(rows, [group], ["ord"], dict, step, schema)


def overlap_islands(cues: DataFrame, group: str = "video_id") -> DataFrame:
    """Cues in order of start, joined while they overlap what came before: a window form of the merge by overlap."""
    order = Window.partitionBy(group).orderBy("start_ns", "ord")
    reach = F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = cues.withColumn("fresh", F.when(F.col("start_ns") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("n_cues"))


def latest_versions(changelog: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by ord: what an upsert of the changelog leaves. Partial maxima are taken map-side."""
    rest = [c for c in changelog.columns if c not in keys]
    return changelog.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("x")).select(*keys, "x.*")
