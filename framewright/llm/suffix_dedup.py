"""Suffix-array dedup: the places of every byte string of ``length`` that starts anywhere else too.

Distributed prefix doubling, with the positions thinned out before the first sort. Every window of ``length`` bytes
holds its least 32-byte gram (by hash, leftmost); consecutive windows with the same one form a stretch, which its gram
anchors. Equal windows have equal anchors at equal places, so only anchors need sorting:

1. Spark sorts all anchors by the rank of their grams, in range partitions that also split a hot gram. Anchors whose
   gram is unique drop out. Stretches that occur twice as a whole are done.
2. The rest are sorted again by gram with the bytes of their stretches. Within each set of buckets all positions get
   the rank of their first 100 bytes; unique ones drop out; the pairs of ranks at offset 100 give those of 200 bytes,
   and what is not unique then repeats. Buckets too large for one task have no task of their own: each of their
   windows becomes a row with its pair of ranks, Spark counts the pairs with map-side partials, and a semi-join, whose
   hot partitions Spark splits, finds the windows whose pair isn't unique.

Sorting every position instead, round after round, needs about 16 times the text on disk for each round.

Defined results: null and empty texts, and those shorter than ``length``, lose nothing; each row is a document, so a
repeated row repeats all its strings; rows with a null doc_id neither count nor lose bytes; rows that share a doc_id
are filtered each by its own text; long texts are cut into segments of windows, which changes no result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import runs
from .common import removed, table, text_or_empty, written

LENGTH, GRAM = 200, 32
#: Windows of a segment, and bytes that a task compares at once.
SEGMENT, TOGETHER = 1 << 20, 1 << 21
#: Stretches of one gram beyond which Spark counts its pairs of ranks.
HOT = 20_000

_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POSITION = _U((1 << 24) - 1)


def _mix(x):
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hashes:
    """Hashes of the substrings of a byte array, from one running sum."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @np.errstate(over="ignore")
    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers[0]) <= n:
            Hashes._powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 3), b)])) for b in (_BASE, _INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * Hashes._powers[0][:n], out=self.sums[1:])

    @np.errstate(over="ignore")
    def of(self, start, end):
        """start: an array of places or a slice; end the same, later."""
        back = Hashes._powers[1][start] if isinstance(start, np.ndarray) else Hashes._powers[1][: len(self.sums)][start]
        return _mix((self.sums[end] - self.sums[start]) * back)


@np.errstate(over="ignore")
def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """data: texts one after another, text i at bounds[i]:bounds[i + 1]. For each stretch: text, place of its first
    window, windows, place of its anchor from there, hash of the gram, hash of the whole stretch."""
    span = length - GRAM + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sizes = np.diff(bounds)
    if not (sizes >= length).any():
        return none
    h = Hashes(data)
    gram = h.of(slice(0, len(data) - GRAM + 1), slice(GRAM, None))
    ranked = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    pad = np.full(-len(ranked) % span + span, np.uint64(2**64 - 1))
    blocks = np.concatenate([ranked, pad]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _POSITION).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    real = np.repeat(bounds[1:], sizes)[:n] - np.arange(n) >= length
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~real[:-1]
    first = np.nonzero(fresh & real)[0]
    stop = np.nonzero(real & np.append(fresh[1:] | ~real[1:], True))[0] + 1
    anchor = least[first]
    whole = _mix(h.of(first, stop + length - 1) + (anchor - first).astype(np.uint64) * _BASE + (stop - first).astype(np.uint64))
    return text[first], first - bounds[text[first]], stop - first, anchor - first, gram[anchor], whole


def _segments(raw: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Batches of pieces of texts: which text, where its windows start, the bytes."""
    which, at, parts, total = [], [], [], 0
    for i, b in enumerate(raw):
        for s in range(0, max(len(b) - length + 1, 0), SEGMENT):
            part = b[s : s + SEGMENT + length - 1]
            which.append(i)
            at.append(s)
            parts.append(part)
            total += len(part)
            if total >= SEGMENT:
                yield which, at, parts
                which, at, parts, total = [], [], [], 0
    if parts:
        yield which, at, parts


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, tags = b["doc_id"].to_numpy(), b["tag"].to_numpy()
            for which, at, parts in _segments([t.encode() for t in b["text"]], length):
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                text, first, n, rel, gram, whole = stretches(np.frombuffer(b"".join(parts), np.uint8), bounds, length)
                of = np.array(which)[text]
                yield pd.DataFrame({"gram": gram.view(np.int64), "whole": whole.view(np.int64), "doc_id": ids[of], "tag": tags[of], "first": (first + np.array(at)[text]).astype(np.int32), "windows": n.astype(np.int32), "rel": rel.astype(np.int32)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"gram bigint, whole bigint, doc_id {id_type}, tag int, first int, windows int, rel int")


#: What a stretch is after the first sort.
REPEATED, OPEN, PARTNER = 1, 2, 3


def _reranked(anchors: DataFrame) -> DataFrame:
    """The anchors that are left, with state. At the ends of a partition, where a gram may go on in the next one,
    nothing counts as unique."""

    def judge(g: pd.DataFrame, edge: np.ndarray) -> pd.DataFrame:
        gram, whole = g["gram"].to_numpy(), g["whole"].to_numpy()
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new = new_gram | np.append(True, whole[1:] != whole[:-1])
        of_gram, of = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
        alike = np.bincount(of)[of]
        kinds = np.bincount(of_gram, new)[of_gram]
        mixed = (kinds > 1) | edge
        state = np.where(alike > 1, REPEATED, np.where(mixed, OPEN, 0))
        partner = (alike > 1) & mixed & new
        kept = g[state > 0].assign(state=state[state > 0])
        return pd.concat([kept, g[partner].assign(state=PARTNER)]) if partner.any() else kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, None
        for b in batches:
            if not len(b):
                continue
            g = pd.concat([held, b]) if held is not None else b
            gram = g["gram"].to_numpy()
            first = gram[0] if first is None else first
            cut = int(np.searchsorted(gram, gram[-1], side="left"))
            held = g.iloc[cut:]
            if cut:
                yield judge(g.iloc[:cut], gram[:cut] == first)
        if held is not None:
            yield judge(held, np.ones(len(held), bool))

    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchors.repartitionByRange(n, "gram", "whole", "doc_id").sortWithinPartitions("gram", "whole")
    return dealt.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema) + ", state int")


@np.errstate(over="ignore")
def repeated_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """data: stretches one after another from starts. The stretch and the place in it of each window that is equal
    to another one: ranks of half the length, unique ones dropped, then ranks of the pairs."""
    half = length // 2
    of = np.repeat(np.arange(len(starts)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[of] + place
    h = Hashes(data)
    rank = h.of(at, at + half)
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    left = count[inverse] > 1
    of, place, at, inverse = of[left], place[left], at[left], inverse[left]
    second = np.unique(h.of(at + length - half, at + length), return_inverse=True)[1]
    pairs = inverse.astype(np.uint64) * _U(max(len(second), 1)) + second.astype(np.uint64)
    if half * 2 < length:
        pairs = _mix(pairs) ^ h.of(at + half, at + length - half)
    _, inverse, count = np.unique(pairs, return_inverse=True, return_counts=True)
    left = count[inverse] > 1
    return of[left], place[left]


def _to_compare(docs: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the stretches that are to be compared: those in buckets of one task, and those in hot ones."""
    rows = left.where(F.col("state") != REPEATED)
    hot = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT).select(F.col("gram").alias("of"))

    def joined(some: DataFrame) -> DataFrame:
        lists = some.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "first", "windows", (F.col("state") == PARTNER).alias("partner"))).alias("open"))
        return docs.join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "open")

    return joined(rows.join(hot, F.col("gram") == F.col("of"), "left_anti")), joined(rows.join(hot, F.col("gram") == F.col("of"), "left_semi"))


def _opened(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches."""
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, tag, text, opened in zip(b["doc_id"], b["tag"], b["text"], b["open"], strict=True):
                raw = text.encode()
                for x in opened:
                    first, n = x["first"], x["windows"]
                    out.append((x["gram"], doc, tag, first, n, x["partner"], raw[first : first + n + length - 1]))
            yield pd.DataFrame(out, columns=["bucket", "doc_id", "tag", "first", "windows", "partner", "bytes"])

    return joined.mapInPandas(cut, f"bucket bigint, doc_id {id_type}, tag int, first int, windows int, partner boolean, bytes binary")


def _hot_spans(joined: DataFrame, length: int) -> DataFrame:
    """The repeated windows of hot buckets. No task holds a bucket, or all windows of one pair of ranks."""
    half = length // 2
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def ranked(held: list[tuple]) -> pd.DataFrame:
        doc, tag, first, n, partner, raw = zip(*held, strict=True)
        windows = np.array(n)
        starts = np.cumsum([0, *map(len, raw)])[:-1]
        of = np.repeat(np.arange(len(n)), windows)
        place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = starts[of] + place
        h = Hashes(np.frombuffer(b"".join(raw), np.uint8))
        r1, r2 = h.of(at, at + half), h.of(at + half, at + length)
        return pd.DataFrame({"r1": r1.view(np.int64), "r2": r2.view(np.int64), "doc_id": np.array(doc)[of], "tag": np.array(tag)[of], "start": np.array(first, np.int64)[of] + place, "partner": np.array(partner, bool)[of]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for b in batches:
            for doc, tag, text, opened in zip(b["doc_id"], b["tag"], b["text"], b["open"], strict=True):
                raw = text.encode()
                for x in opened:
                    first, n = x["first"], x["windows"]
                    held.append((doc, tag, first, n, x["partner"], raw[first : first + n + length - 1]))
                    total += len(held[-1][-1])
                    if total >= TOGETHER:
                        yield ranked(held)
                        held, total = [], 0
        if held:
            yield ranked(held)

    windows = joined.mapInPandas(run, f"r1 bigint, r2 bigint, doc_id {id_type}, tag int, start bigint, partner boolean")
    again = windows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("r1", "r2")
    found = windows.where("not partner").join(again, ["r1", "r2"], "left_semi")
    return found.select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))


def _spans_of(opened: DataFrame, length: int) -> DataFrame:
    id_type = opened.schema["doc_id"].dataType.simpleString()

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        raw, windows = g["bytes"].tolist(), g["windows"].to_numpy()
        starts = np.cumsum([0, *map(len, raw)])[:-1]
        of, place = repeated_windows(np.frombuffer(b"".join(raw), np.uint8), starts, windows, length)
        fresh = np.append(True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)) if len(of) else np.empty(0, bool)
        first = np.nonzero(fresh)[0]
        last = np.append(first[1:], len(of))[: len(first)] - 1
        i = of[first]
        at = g["first"].to_numpy()[i]
        out = pd.DataFrame({"doc_id": g["doc_id"].to_numpy()[i], "tag": g["tag"].to_numpy()[i], "start": (at + place[first]).astype(np.int64), "end": (at + place[last] + length).astype(np.int64)})
        return out[~g["partner"].to_numpy(bool)[i]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for g in runs(batches, "bucket"):
            if len(g) < 2:
                continue
            held.append(g)
            total += int(g["windows"].sum()) + LENGTH * len(g)
            if total >= TOGETHER:
                yield settle(pd.concat(held))
                held, total = [], 0
        if held:
            yield settle(pd.concat(held))

    return opened.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, f"doc_id {id_type}, tag int, start bigint, end bigint")


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, tag, text) and their repeated spans in bytes (doc_id, tag, spans); these may overlap."""
    named = docs.select("doc_id", F.hash(text_or_empty()).alias("tag"), text_or_empty().alias("text")).where(F.col("doc_id").isNotNull())
    anchors = written(_anchors(named, length), "anchors")
    left = written(_reranked(anchors), "ranks")
    removed(anchors)
    whole = left.where(F.col("state") == REPEATED).select("doc_id", "tag", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") + (length - 1)).cast("long").alias("end"))
    few, hot = _to_compare(named, left)
    spans = whole.unionByName(_spans_of(_opened(few, length), length)).unionByName(_hot_spans(hot, length))
    # A set: equal rows of one doc_id find the same spans, each once.
    return named, spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in bytes), kept (binary)."""
    named, spans = repeated_spans(docs, length)

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                raw = text.encode()
                gone = merged((s["start"], s["end"]) for s in found) if found is not None else []
                ends = [0, *(x for s in gone for x in s), len(raw)]
                out.append((doc, len(raw), [{"start": s, "end": e} for s, e in gone], b"".join(raw[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True))))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    joined = named.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    out = joined.mapInPandas(drop, f"doc_id {id_type}, n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary")
    bare = docs.where(F.col("doc_id").isNull())
    raw = F.encode(text_or_empty(), "UTF-8")
    return out.unionByName(bare.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.array().cast("array<struct<start bigint, end bigint>>").alias("spans"), raw.alias("kept")))


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
