"""SubRip text as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ordered_lines, srt_time


def numbered(subtitles: DataFrame, group: str = "video_id") -> DataFrame:
    """number, from 1 by start, and block, the cue's text; null for a cue without lines, which still takes a number."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("start_ns", "start_frame", "id"))
    rows = subtitles.withColumn("number", place.cast("long")).withColumn("shown", ordered_lines(F.col("lines")))
    head = F.concat(F.when(F.col("number") > 1, "\n").otherwise(""), F.col("number").cast("string"), F.lit("\n"), srt_time(F.col("start_ns")), F.lit(" --> "), srt_time(F.col("end_ns")), F.lit("\n"))
    block = F.when(F.size("shown") > 0, F.concat(head, F.array_join("shown", "\n"), F.lit("\n")))
    return rows.withColumn("block", block).drop("shown")


def rendered(subtitles: DataFrame, group: str = "video_id") -> DataFrame:
    """group, srt: the whole text of each video."""
    blocks = numbered(subtitles, group).where("block is not null")
    ordered = F.array_sort(F.collect_list(F.struct("number", "block")))
    return blocks.groupBy(group).agg(ordered.alias("b")).select(group, F.array_join(F.transform("b", lambda x: x["block"]), "").alias("srt"))


def default_path(source: str) -> str:
    """The input's path with the extension of subtitles."""
    folder, _, name = source.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}.srt" if folder else f"{stem}.srt"


def write(subtitles: DataFrame, path: str, group: str = "video_id") -> None:
    """A folder for each video with one text file, whose last line end the writer adds."""
    text = rendered(subtitles, group).select(group, F.regexp_replace("srt", "\n$", "").alias("value"))
    text.repartition(group).write.partitionBy(group).mode("overwrite").text(path)
