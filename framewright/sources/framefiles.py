"""Raw files of many frames as a data source, and their writer.

A file holds frames of one size, one after the other: Y, then UV of half the lines where the layout has it. The partitions of
a scan are ranges of bytes of a file, so one large file is read by many tasks, and a start frame, a seek or a filter on
frame_index or pts_ns becomes an offset: what lies before is not read.

Options: path (a file or a folder; files in order of their names), width, height, layout (nv12, or y without UV), step_ns (time
from frame to frame), start_frame, seek_ns and seek (fast: from the frame nearest to the time; accurate: from the frame below it,
and none before the time), partition_bytes, partitions (at least so many in all), suffix, truncated (error, or skip: a last frame that is cut off).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .frames import MOCK_STEP_NS

SCHEMA = "path string, frame_index bigint, pts_ns bigint, width int, height int, y_stride int, y_plane binary, uv_plane binary"
#: Bytes of planes that a batch holds, and of a partition unless an option tells otherwise.
BATCH_BYTES, PARTITION_BYTES = 1 << 25, 1 << 27


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Frames from first up to stop of a file."""

    path: str
    first: int
    stop: int


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(self.options) if self.options.get("filters") == "true" else FrameFileReader(self.options)


class FrameFileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.layout, self.suffix, self.truncated = options.get("layout", "nv12"), options.get("suffix", ".yuv"), options.get("truncated", "error")
        self.step, self.bytes, self.least = int(options.get("step_ns", MOCK_STEP_NS)), int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("partitions", 1))
        if min(self.width, self.height, self.step, self.bytes, self.least) <= 0 or self.layout not in ("nv12", "y"):
            raise ValueError("width, height, step_ns, partition_bytes and partitions must be positive, and layout nv12 or y")
        self.luma = self.width * self.height
        self.size = self.luma + (self.width * -(-self.height // 2) if self.layout == "nv12" else 0)
        self.first, self.stop = int(options.get("start_frame", 0)), 1 << 62
        if "seek_ns" in options:
            self._seek(int(options["seek_ns"]), options.get("seek", "accurate"))
        self.read_bytes = 0

    def _seek(self, to: int, mode: str) -> None:
        if mode not in ("fast", "accurate"):
            raise ValueError("seek must be fast or accurate")
        nearest = (to + self.step // 2) // self.step
        self.first = max(self.first, nearest if mode == "fast" else -(-to // self.step))

    def partitions(self) -> list[Part]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(self.suffix)]
        files = []
        for i in sorted(found, key=lambda i: i.path):
            if i.size % self.size and self.truncated != "skip":
                raise ValueError(f"{i.path}: {i.size} bytes are no whole number of frames of {self.size}")
            files.append((i.path, max(self.first, 0), min(self.stop, i.size // self.size)))
        wanted = sum(max(stop - first, 0) for _, first, stop in files)
        step = max(min(self.bytes // self.size, -(-wanted // self.least)), 1)
        return [Part(path, a, min(a + step, stop)) for path, first, stop in files for a in range(first, stop, step)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first >= part.stop:
            return
        names = ("path", "frame_index", "pts_ns", "width", "height", "y_stride", "y_plane", "uv_plane")
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        grey = bytes([128]) * (self.width * -(-self.height // 2))
        with opened(self.path)[0].open_input_file(part.path) as file:
            file.seek(part.first * self.size)
            at, together = part.first, max(BATCH_BYTES // self.size, 1)
            while at < part.stop:
                n = min(together, part.stop - at)
                data = file.read(n * self.size)
                self.read_bytes += len(data)
                if len(data) < n * self.size:
                    raise OSError(f"{part.path} became shorter while it was read")
                frames = [data[k * self.size : (k + 1) * self.size] for k in range(n)]
                index = range(at, at + n)
                columns = ([part.path] * n, index, [i * self.step for i in index], [self.width] * n, [self.height] * n, [self.width] * n, [f[: self.luma] for f in frames], [f[self.luma :] or grey for f in frames])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))
                at += n


class FilteredReader(FrameFileReader):
    """Takes filters too. Spark wants it only where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters):
        for f in filters:
            scale = {("frame_index",): 1, ("pts_ns",): self.step}.get(f.attribute) if hasattr(f, "attribute") else None
            if scale is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            up, down = -(-f.value // scale), f.value // scale
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, down + 1 if isinstance(f, GreaterThan) else up)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.stop = min(self.stop, up if isinstance(f, LessThan) else down + 1)


def write_frame_files(frames: DataFrame, folder: str) -> DataFrame:
    """path, frames, bytes: a file <video_id>.yuv for each video, its frames in order. frames: video_id, frame_index, width, height,
    y_stride, y_plane and uv_plane (without a stride). A file is written beside its place and moved there when it is whole, so
    a task that fails or runs twice leaves no half file. Written when the result is read; frames stream through."""
    schema = "path string, frames bigint, bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        video, out, told = None, None, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out["to"].close()
                path = f"{root}/{video}.yuv"
                system.move(out["path"], path)
                told.append((path, out["frames"], out["bytes"]))
                out = None

        try:
            for b in batches:
                for f in b.to_pylist():
                    if f["video_id"] != video or out is None:
                        close()
                        video, path = f["video_id"], f"{root}/.{f['video_id']}-{uuid4().hex}"
                        out = {"path": path, "to": system.open_output_stream(path), "frames": 0, "bytes": 0}
                    w, h, s = f["width"], f["height"], f["y_stride"]
                    data = b"".join(f["y_plane"][r * s : r * s + w] for r in range(h)) + (f["uv_plane"] or b"")
                    out["to"].write(data)
                    out["frames"], out["bytes"] = out["frames"] + 1, out["bytes"] + len(data)
            close()
        finally:
            if out is not None:  # the task failed
                out["to"].close()
                system.delete_file(out["path"])
        columns = list(zip(*told)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "frames", "bytes"])

    rows = frames.select("video_id", "frame_index", "width", "height", "y_stride", "y_plane", "uv_plane").where(F.col("video_id").isNotNull())
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(run, schema)


def frame_files(spark, path: str, width: int, height: int, **options) -> DataFrame:
    """The frames of a file or a folder; filters are pushed down where the session lets Python sources have them."""
    spark.dataSource.register(FrameFiles)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("frame_files").options(width=width, height=height, filters=filters, **options).load(path)
