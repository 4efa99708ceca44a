"""Choice of a frame source: by name, checked, with the next one tried where one is not available."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: The output formats: planes of luma and chroma, and handles that only a source on the same machine can give.
PLANES, HANDLES = "nv12", "native"


class Unavailable(Exception):
    """A source that cannot run here."""


@dataclass(frozen=True)
class SourceConfig:
    backend: str | None = None
    input: str | None = None
    capacity: int | None = None
    start_frame: int = 0
    output: str = PLANES

    def __post_init__(self):
        if self.capacity is not None and self.capacity <= 0:
            raise ValueError("the capacity must be greater than zero")
        if self.start_frame < 0:
            raise ValueError("the start frame must not be negative")
        if self.output not in (PLANES, HANDLES):
            raise ValueError(f"no output format {self.output!r}")

    def checked(self, with_handles: tuple[str, ...] = ()) -> SourceConfig:
        if self.output == HANDLES and self.backend not in with_handles:
            raise ValueError(f"output format {self.output!r} is not supported by backend {self.backend!r}")
        return self


def from_environment(values: Mapping[str, str] = os.environ, prefix: str = "FRAMEWRIGHT_") -> SourceConfig:
    """BACKEND, INPUT, CHANNEL_CAPACITY and START_FRAME, each after the prefix."""
    got = {k: values[prefix + k] for k in ("BACKEND", "INPUT", "CHANNEL_CAPACITY", "START_FRAME") if prefix + k in values}

    def number(key: str):
        try:
            return int(got[key])
        except ValueError:
            raise ValueError(f"{prefix}{key}={got[key]!r} is not a number") from None

    return SourceConfig(got.get("BACKEND"), got.get("INPUT"), number("CHANNEL_CAPACITY") if "CHANNEL_CAPACITY" in got else None, number("START_FRAME") if "START_FRAME" in got else 0)


def opened(config: SourceConfig, readers: Mapping[str, Callable[[SourceConfig], DataFrame]], probe: bool = False) -> tuple[str, DataFrame]:
    """The name and the frames of the configured source, or else of the first in readers that is available. A named
    source that is not available is an error: only an open choice falls through. With probe, a source whose first frame
    can't be read counts as not available, as nothing of it has been processed yet; a source without frames is one that can."""
    if config.backend is not None:
        if config.backend not in readers:
            raise ValueError(f"no backend {config.backend!r}")
        return config.backend, readers[config.backend](config)
    reasons = []
    for name, reader in readers.items():
        try:
            frames = reader(config)
        except Unavailable as e:
            reasons.append(f"{name}: {e}")
            continue
        try:
            if probe:
                frames.take(1)
            return name, frames
        except Exception as e:  # whatever a reader may raise inside a task
            reasons.append(f"{name}: {str(e).strip().partition(chr(10))[0]}")
    raise Unavailable("; ".join(reasons) or "no backend")
