"""Settings of a run: flags win over one configuration file, which wins over the defaults."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, replace
from pathlib import Path

FULL = (0.0, 0.0, 1.0, 1.0)


@dataclass(frozen=True)
class Settings:
    samples_per_second: int = 7
    target: int = 230
    delta: int = 12
    comparator: str = "bitset-cover"
    detector: str = "projection-band"
    roi: tuple[float, float, float, float] = FULL

    def __post_init__(self):
        if self.samples_per_second < 1:
            raise ValueError("at least one sample a second")
        if not 0 <= self.target <= 255 or not 0 <= self.delta <= 255:
            raise ValueError("target and delta are bytes")
        object.__setattr__(self, "roi", valid_roi(self.roi))


def parse_roi(text: str) -> tuple[float, float, float, float]:
    """Four numbers between commas or blanks, none of them negative."""
    parts = [p for p in re.split(r"[,\s]+", text.strip()) if p]
    if len(parts) != 4:
        raise ValueError("a region has four numbers")
    return valid_roi(tuple(map(float, parts)))


def valid_roi(roi) -> tuple[float, float, float, float]:
    """Cut to the frame and rounded to a millionth; a region without width or height is the whole frame."""
    x, y, w, h = roi
    if min(x, y, w, h) < 0:
        raise ValueError("a region's numbers are not negative")
    if w == 0 or h == 0:
        return FULL
    x, y = min(x, 1.0), min(y, 1.0)
    w, h = min(w, 1.0 - x), min(h, 1.0 - y)
    if w <= 0 or h <= 0:
        return FULL
    return tuple(round(v, 6) for v in (x, y, w, h))


def load(flags: dict, config: str | None = None, places: tuple[str, ...] = ("config.toml",)) -> Settings:
    """The named file, or else the first of places that exists; exactly one file is read."""
    path = Path(config) if config else next((Path(p) for p in places if Path(p).exists()), None)
    values = tomllib.loads(path.read_text()) if path else {}
    given = {**values, **{k: v for k, v in flags.items() if v is not None}}
    if unknown := sorted(given.keys() - Settings.__dataclass_fields__.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(Settings(), **given)
