"""Readers of raw frame files and region files, and the writers of their counterparts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .framefiles import opened

#: Sizes of frames that a file's length tells.
SIZES = ((1920, 1080), (1920, 824))


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame_index, width, height, y_stride, y_plane, uv_plane from NNNNN.yuv files: Y alone or Y and UV. UV is
    128 where a file has none; files of another length are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                for w, h in SIZES:
                    if len(data) in (w * h, w * h + w * (-(-h // 2))):
                        uv = data[w * h :] or bytes([128]) * (w * -(-h // 2))
                        name = path.rpartition("/")[2].removesuffix(".yuv")
                        out.append((path, int(name) if name.isdigit() else None, w, h, w, data[: w * h], uv))
                        break
                else:
                    raise ValueError(f"{path}: {len(data)} bytes fit no known size")
            yield pd.DataFrame(out, columns=["path", "frame_index", "width", "height", "y_stride", "y_plane", "uv_plane"]).astype({"frame_index": object})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yuv").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, frame_index bigint, width int, height int, y_stride int, y_plane binary, uv_plane binary")


REGION = "struct<index:int,x:double,y:double,width:double,height:double,score:double>"
REPORT = f"detector string, source string, frame struct<width:int,height:int>, roi struct<x:double,y:double,width:double,height:double>, luma_band struct<target:int,delta:int>, has_subtitle boolean, max_score double, regions array<{REGION}>"


def region_reports(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame, luma_band (235 and 12 where none is given) and rois: the regions as parts of the frame, or the
    whole roi where there are none."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.from_json("value", REPORT).alias("r"))
    r = F.col("r")
    parts = F.transform(r["regions"], lambda x: F.struct((x["x"] / r["frame"]["width"]).alias("x"), (x["y"] / r["frame"]["height"]).alias("y"), (x["width"] / r["frame"]["width"]).alias("width"), (x["height"] / r["frame"]["height"]).alias("height")))
    rois = F.when(F.coalesce(F.size(r["regions"]), F.lit(0)) > 0, parts).when(r["roi"].isNotNull(), F.array(r["roi"])).otherwise(F.array().cast("array<struct<x:double,y:double,width:double,height:double>>"))
    band = F.struct(F.coalesce(r["luma_band"]["target"], F.lit(235)).alias("target"), F.coalesce(r["luma_band"]["delta"], F.lit(12)).alias("delta"))
    return text.select("path", r["frame"].alias("frame"), band.alias("luma_band"), rois.alias("rois"))


def region_report_json(regions: DataFrame, detector: str, target: int, delta: int) -> DataFrame:
    """video_id, frame_index, json: one report a frame from detected regions."""
    one = F.struct("ord", "x", "y", "width", "height", "score")
    lists = regions.groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list(one)).alias("r"), F.first("frame_width").alias("fw"), F.first("frame_height").alias("fh"))
    items = F.transform("r", lambda x: F.struct(x["ord"].alias("index"), x["x"].alias("x"), x["y"].alias("y"), x["width"].alias("width"), x["height"].alias("height"), x["score"].alias("score")))
    body = F.struct(
        F.lit(detector).alias("detector"), F.concat(F.lpad(F.col("frame_index").cast("string"), 5, "0"), F.lit(".yuv")).alias("source"), F.struct(F.col("fw").alias("width"), F.col("fh").alias("height")).alias("frame"),
        F.struct(F.lit(target).alias("target"), F.lit(delta).alias("delta")).alias("luma_band"), (F.size("r") > 0).alias("has_subtitle"), F.get("r", F.lit(0))["score"].alias("max_score"), items.alias("regions"),
    )
    return lists.select("video_id", "frame_index", F.to_json(body).alias("json"))


def pair_report_lines(pairs: DataFrame, comparator: str) -> DataFrame:
    """prev_frame, curr_frame, json: a report for each pair of frames, from rows (prev_frame, curr_frame, skipped, description, similarity,
    same_segment) of their regions; a pair without regions tells why it was skipped. Written as text, in any number of
    files, it is JSON lines."""
    one = F.struct("description", F.col("similarity").cast("float").alias("similarity"), "same_segment")
    found = F.filter(F.array_sort(F.collect_list(one)), lambda x: x["description"].isNotNull())
    by_pair = pairs.groupBy("prev_frame", "curr_frame").agg(F.max("skipped").alias("skipped"), found.alias("roi_results"))
    body = F.struct(F.lit(comparator).alias("comparator"), "prev_frame", "curr_frame", "skipped", "roi_results")
    return by_pair.select("prev_frame", "curr_frame", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def png(luma: bytes, width: int, height: int, stride: int) -> bytes:
    """A grey picture of eight bits a pixel."""
    if stride < width or len(luma) < stride * (height - 1) + width or min(width, height) <= 0:
        raise ValueError("a plane is smaller than its frame")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + luma[y * stride : y * stride + width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def dumped(rows: DataFrame, folder: str, extension: str, content: Callable[[object], bytes]) -> DataFrame:
    """Writes a file NNNNN.<extension> for each row, by frame_index, to a folder that all executors reach; path and bytes of each
    are returned when the result is read. A file is moved to its name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for f in b.itertuples(index=False):
                data, path, beside = content(f), f"{root}/{f.frame_index:05d}.{extension}", f"{root}/.{uuid4().hex}"
                with system.open_output_stream(beside) as to:
                    to.write(data)
                system.move(beside, path)
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.mapInPandas(run, "path string, bytes bigint")


def write_pictures(frames: DataFrame, folder: str) -> DataFrame:
    """The luma of frames (frame_index, width, height, y_stride, y_plane) as PNG files."""
    return dumped(frames.select("frame_index", "width", "height", "y_stride", "y_plane"), folder, "png", lambda f: png(f.y_plane, f.width, f.height, f.y_stride))


def write_metadata(folder: str, name: str = "dump.txt", **values) -> str:
    """What a dump was made from, a line name=value each, in the order given, as a file beside the dump."""
    for k, v in values.items():
        if "\n" in f"{k}{v}" or "=" in k:
            raise ValueError(f"{k} can't be told in a line")
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as to:
        to.write("".join(f"{k}={v}\n" for k, v in values.items()).encode())
    return f"{root}/{name}"


def write_raw_frames(frames: DataFrame, folder: str) -> DataFrame:
    """Writes NNNNN.yuv files, Y then UV without their strides, to a folder that all executors reach; path and bytes of
    each are returned when the result is read. frames: frame_index, width, height, y_stride, y_plane, uv_stride, uv_plane."""

    def packed(data: bytes, width: int, rows: int, stride: int) -> bytes:
        if stride < width or len(data) < stride * rows:
            raise ValueError("a plane is smaller than its frame")
        return b"".join(data[r * stride : r * stride + width] for r in range(rows))

    def content(f) -> bytes:
        return packed(f.y_plane, f.width, f.height, f.y_stride) + packed(f.uv_plane, f.width, -(-f.height // 2), f.uv_stride)

    rows = frames.select("frame_index", "width", "height", "y_stride", "y_plane", "uv_stride", "uv_plane")
    return dumped(rows, folder, "yuv", content)
