"""SubRip files as a sink with commit: one <name>.srt a video.

A task writes each of its videos to a file beside its place and tells the driver; only when all tasks have ended are the files
moved to their names. So a failed or repeated task leaves nothing, and readers see whole files only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import srt
from .framefiles import opened


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, and where they go."""

    files: list[tuple[str, str]]


class SubRip(DataSource):
    """Rows: name, number, block, those of a name together and in order of number. Option: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "subrip"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SubRipWriter(self.options["path"], overwrite)


class SubRipWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        name, to = None, None
        try:
            for row in rows:
                if to is None or row["name"] != name:
                    if to is not None:
                        to.close()
                    name = row["name"]
                    if "/" in str(name):
                        raise ValueError(f"{name} is no name of a file")
                    files.append((f"{root}/.{name}-{uuid4().hex}", f"{root}/{name}.srt"))
                    to = system.open_output_stream(files[-1][0])
                to.write((row["block"] or "").encode())
            if to is not None:
                to.close()
        except BaseException:
            if to is not None:
                to.close()
            self._dropped([Written(files)])
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        moves = [f for m in messages if m is not None for f in m.files]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self._dropped(messages)
            raise ValueError("two tasks wrote one name: rows of a name must be together")
        for temporary, to in moves:
            system.move(temporary, to)

    def abort(self, messages: list[Written | None]) -> None:
        self._dropped(messages)

    def _dropped(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for temporary, _ in message.files if message is not None else ():
                if system.get_file_info(temporary).is_file:
                    system.delete_file(temporary)


def save(subtitles: DataFrame, path: str, group: str = "video_id", source: str | None = None) -> None:
    """Writes the subtitles of each video (those of srt.numbered) as <group>.srt, or, with source, the name of a column
    with the video's path, as the name of that file with the extension of subtitles. Videos without any cue get no file."""
    spark = subtitles.sparkSession
    spark.dataSource.register(SubRip)
    name = F.col(group).cast("string")
    if source:
        stem = F.regexp_extract(source, r"([^/]*?)(\.[^./]*)?$", 1)
        name = F.when(F.col(source).isNotNull(), stem).otherwise(name)
    blocks = srt.numbered(subtitles.withColumn("name", name), group).where("block is not null and name is not null")
    rows = blocks.select("name", "number", "block").repartition("name").sortWithinPartitions("name", "number")
    rows.write.format("subrip").mode("append").save(path)
