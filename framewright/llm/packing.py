"""Best-fit packing: bounded-space online best fit over a bitset keyed by free space.

Each task packs the pieces of its own partition as they arrive: a piece goes to the open sequence with the least room
that holds it; when none does, a new one opens, and if ``max_open`` are open the fullest closes first. Open sequences
are counts only, so memory is ``max_open`` small integers. Texts are taken in rounds of ``ROUND``, a round's pieces from
the longest to the shortest, which leaves a tenth of the gaps that their own order leaves. What the tasks leave open at their ends is then packed by the
same rule, the longest first, as whole sequences: only their numbers and lengths are shuffled, not the pieces.

Tokens are those of ``tokenizers`` for byte_bpe_50k.json without special tokens. They are made by ``tiktoken`` from
the same vocabulary, which gives the same ids several times as fast; the tests hold both against each other.

Defined results: null and empty texts are the end token alone; each row is packed, repeated or not, with its doc_id
as given, null or not; texts of any length are encoded whole, by windows cut at places where the split pattern cuts too; an
empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frames
from .common import table, written

CAPACITY, END_ID, MAX_OPEN = 1024, 2, 512
#: Texts of a round; one round ends earlier if its tokens would fill as many sequences.
ROUND = 512
#: Open sequences of other tasks that one task packs again.
TOGETHER = 1 << 16
#: The special token of the vocabulary: it is found before the text is split.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class OpenBins:
    """Bit f of the mask is set while an open bin has f free."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.mask = self.count = self.made = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        x = at.pop()
        if not at:
            self.mask &= ~(1 << free)
        self.count -= 1
        return x

    def put(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        room = self.mask >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            x = self._take(free)
        else:
            if self.count >= self.max_open:
                self._take((self.mask & -self.mask).bit_length() - 1)
            x, free = self.made, self.capacity
            self.made += 1
        if free > length:
            self.by_free[free - length].append(x)
            self.mask |= 1 << (free - length)
            self.count += 1
        return x, self.capacity - free


@lru_cache(maxsize=2)
def _encoders(path: str):
    """Two encoders with one vocabulary. The second has no lookahead, and so runs on a faster engine; the two
    patterns differ only where white space follows white space."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ahead = r"|\s+(?!\S)|\s+"
    assert public_tokenizers.PATTERN.endswith(ahead)
    plain = public_tokenizers.PATTERN.removesuffix(ahead) + r"|\s+"
    return [tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("exact", public_tokenizers.PATTERN), ("plain", plain))]


_TWO_SPACES = re.compile(r"\s\s")
#: Between a letter and one blank before a letter the pattern always cuts, so a long text is encoded in windows.
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
WINDOW = 1 << 20


def encode(text: str, path: str) -> list[int]:
    exact, plain = _encoders(path)
    ids: list[int] = []
    for n, part in enumerate(text.split(SPECIAL)):
        if n:
            ids.append(SPECIAL_ID)
        encoder = exact if _TWO_SPACES.search(part) else plain
        at = 0
        while len(part) - at > WINDOW and (m := _CUT.search(part, at + WINDOW)):
            ids += encoder.encode_ordinary(part[at : m.start()])
            at = m.start()
        ids += encoder.encode_ordinary(part[at:] if at else part)
    return ids


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _rounds(texts: pd.Series, file: str, capacity: int, end_id: int) -> Iterator[tuple[int, list[tuple[int, int, int, np.ndarray]]]]:
    """The place of the first text of each round, and the round's pieces: text, piece, start, ids."""
    first, held, tokens = 0, [], 0
    for row, text in enumerate(texts):
        if row - first >= ROUND or tokens >= ROUND * capacity:
            yield first, held
            first, held, tokens = row, [], 0
        ids = np.array([*encode(text, file), end_id] if isinstance(text, str) else [end_id], "<u4")
        ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
        held += [(row - first, k, max(end - capacity, 0), ids[max(end - capacity, 0) : end]) for k, end in enumerate(ends)]
        tokens += len(ids)
    if held:
        yield first, held


def _pieces(docs: DataFrame, path: str | None, capacity: int, end_id: int, max_open: int, with_ids: bool) -> DataFrame:
    """The pieces, each task's in sequences of its own."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    last = ("ids", "array<int>") if with_ids else ("ids_crc32", "bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base, file = OpenBins(capacity, max_open), TaskContext.get().partitionId() << 40, path or tokenizer_path()
        for batch in batches:
            for first, pieces in _rounds(batch["text"], file, capacity, end_id):
                out = []
                for row, piece, start, own in sorted(pieces, key=lambda p: -len(p[3])):
                    number, place = bins.put(len(own))
                    out.append((first + row, piece, start, len(own), own.astype("<i4") if with_ids else zlib.crc32(own.tobytes()), base + number, place))
                made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", last[0], "sequence_id", "offset"])
                yield made.assign(doc_id=batch["doc_id"].to_numpy()[made["doc_id"].to_numpy(int)])

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, {last[0]} {last[1]}, sequence_id bigint, offset bigint"
    return frames(docs.select("doc_id", F.col("text")), run, schema)


def _joined(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id, into, base: what is left open at the ends of the tasks, packed again, the longest first. Only
    sequences with room for the shortest one are taken, a handful a task; each task here joins up to TOGETHER."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    used = written(used.where(F.col("used") < capacity), "loose")
    least = used.agg(F.min("used")).first()[0] or 0
    loose = used.where(F.col("used") + least <= capacity)
    tasks = 1 + loose.count() // TOGETHER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, MAX_OPEN), TaskContext.get().partitionId() << 40
        for b in batches:
            at = [bins.put(int(n)) for n in b["used"]]
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "into": [-1 - base - n for n, _ in at], "base": [place for _, place in at]})

    sorted_rows = loose.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")
    return frames(sorted_rows, run, "sequence_id bigint, into bigint, base bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, max_open: int = MAX_OPEN, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (or ids_crc32 only), sequence_id, offset."""
    pieces = written(_pieces(docs, path, capacity, end_id, max_open, with_ids), "pieces")
    moved = written(_joined(pieces, capacity), "joined")
    sequence = F.coalesce("into", "sequence_id").alias("sequence_id")
    place = (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    return pieces.join(moved, "sequence_id", "left").select(*[sequence if c == "sequence_id" else place if c == "offset" else c for c in pieces.columns])


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
