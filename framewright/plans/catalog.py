"""All queries over the reference tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import arrays, frames, pixels, planes, segments, sources

_PARTS = (frames, pixels, segments, arrays, planes, sources)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
