"""A Python data source of generated frames, with the start frame pushed down."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition

from .frames import MOCK_FRAMES, MOCK_HEIGHT, MOCK_STEP_NS, MOCK_WIDTH


class _Span(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class MockFrames(DataSource):
    """Options: frames, width, height, start_frame, partitions. The luma of a row is (row + frame) % 256."""

    @classmethod
    def name(cls) -> str:
        return "mock_frames"

    def schema(self) -> str:
        return "frame_index bigint, pts_ns bigint, width int, height int, y_stride int, y_plane binary, uv_plane binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.n, self.width, self.height = (int(options.get(k, d)) for k, d in (("frames", MOCK_FRAMES), ("width", MOCK_WIDTH), ("height", MOCK_HEIGHT)))
        self.first, self.stop, self.parts = int(options.get("start_frame", 0)), self.n, int(options.get("partitions", 4))
        if min(self.n, self.width, self.height, self.parts) <= 0:
            raise ValueError("frames, width, height and partitions must be positive")

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("frame_index",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.stop = min(self.stop, f.value + 1)
            else:
                yield f

    def partitions(self):
        first, stop = min(self.first, self.stop), self.stop
        step = max(-(-(stop - first) // self.parts), 1)
        return [_Span(a, min(a + step, stop)) for a in range(first, max(stop, first + 1), step)]

    def read(self, span: _Span) -> Iterator[tuple]:
        uv = bytes([128]) * (self.width * -(-self.height // 2))
        for i in range(span.first, span.stop):
            y = b"".join(bytes([(r + i) % 256]) * self.width for r in range(self.height))
            yield i, i * MOCK_STEP_NS, self.width, self.height, self.width, y, uv
