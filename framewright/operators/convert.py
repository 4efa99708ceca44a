"""Pixel formats to NV12, with bilinear resampling where the size changes.

A frame is a row and is converted where it lies. Resampling is separable, a pass along lines and one along columns, in
integers: places and weights are in 256ths of a pixel, so results don't depend on the machine. Chroma is that of the mean colour of
2 x 2 pixels (what there is of them at odd edges).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .arrays import TO_U, TO_V, TO_Y

#: Bytes of a frame of width w and height h.
FORMATS = {
    "rgb24": lambda w, h: 3 * w * h,
    "bgr24": lambda w, h: 3 * w * h,
    "gray8": lambda w, h: w * h,
    "nv12": lambda w, h: w * h + 2 * -(-w // 2) * -(-h // 2),
    "nv21": lambda w, h: w * h + 2 * -(-w // 2) * -(-h // 2),
    "yuv420p": lambda w, h: w * h + 2 * -(-w // 2) * -(-h // 2),
}


def bilinear(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plane at another size; pixels are taken at their middles, and those beyond the edge are those at it."""

    def places(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(((2 * np.arange(to) + 1) * n * 128) // to - 128, 0, (n - 1) * 256)
        return at >> 8, np.minimum((at >> 8) + 1, n - 1), at & 255

    if plane.shape == (height, width):
        return plane
    (x0, x1, fx), (y0, y1, fy) = places(plane.shape[1], width), places(plane.shape[0], height)
    v = plane.astype(np.int64)
    lines = v[:, x0] * (256 - fx) + v[:, x1] * fx
    return ((lines[y0] * (256 - fy[:, None]) + lines[y1] * fy[:, None] + 32768) >> 16).astype(np.uint8)


def _part(rgb: list[np.ndarray], weights: tuple) -> np.ndarray:
    total = sum((k * c for k, c in zip(weights[:3], rgb)), np.full(rgb[0].shape, weights[3]))
    return np.clip(np.floor(total + 0.5), 0, 255).astype(np.uint8)


def _mean_of_blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    sums = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), np.arange(0, h, 2), axis=0), np.arange(0, w, 2), axis=1)
    n = np.minimum(2, h - np.arange(0, h, 2))[:, None] * np.minimum(2, w - np.arange(0, w, 2))[None]
    return (sums + n // 2) // n


def to_nv12(data: bytes, layout: str, width: int, height: int, to_width: int, to_height: int) -> tuple[bytes, bytes]:
    """Y and UV of a frame at the new size."""
    if len(data) != FORMATS[layout](width, height):
        raise ValueError(f"{len(data)} bytes are no {layout} frame of {width} x {height}")
    raw, (cw, ch), (tw, th) = np.frombuffer(data, np.uint8), (-(-width // 2), -(-height // 2)), (-(-to_width // 2), -(-to_height // 2))
    if layout in ("rgb24", "bgr24"):
        rgb = [bilinear(raw.reshape(height, width, 3)[:, :, c], to_width, to_height) for c in ((0, 1, 2) if layout == "rgb24" else (2, 1, 0))]
        small = [_mean_of_blocks(c) for c in rgb]
        y, u, v = _part(rgb, TO_Y), _part(small, TO_U), _part(small, TO_V)
    else:
        y = bilinear(raw[: width * height].reshape(height, width), to_width, to_height)
        if layout == "gray8":
            u = v = np.full((th, tw), 128, np.uint8)
        else:
            chroma = raw[width * height :]
            u, v = chroma.reshape(2, ch, cw) if layout == "yuv420p" else chroma.reshape(ch, cw, 2).transpose(2, 0, 1)[:: 1 if layout == "nv12" else -1]
            u, v = bilinear(u, tw, th), bilinear(v, tw, th)
    return y.tobytes(), np.stack([u, v], axis=2).tobytes()


def converted(frames: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """frames (layout, width, height, data, ...) as NV12: width, height, y_stride, y_plane, uv_stride, uv_plane in place of layout and data. Without a new
    size each frame keeps its own. A frame whose bytes don't fit its size is an error."""
    kept = [f for f in frames.schema if f.name not in ("layout", "width", "height", "data")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f in b.itertuples(index=False):
                w, h = width or f.width, height or f.height
                y, uv = to_nv12(f.data, f.layout, f.width, f.height, w, h)
                out.append((w, h, w, y, 2 * -(-w // 2), uv))
            made = pd.DataFrame(out, columns=["width", "height", "y_stride", "y_plane", "uv_stride", "uv_plane"])
            yield pd.concat([b[names].reset_index(drop=True), made], axis=1)

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return frames.select(*[f"`{n}`" for n in names], "layout", "width", "height", "data").mapInPandas(run, f"{own}width int, height int, y_stride int, y_plane binary, uv_stride int, uv_plane binary")
