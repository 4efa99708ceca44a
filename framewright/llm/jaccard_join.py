"""N-gram Jaccard join by chosen paths.

A text is its set of hashed five-word shingles. In each run a set goes down a tree: at each level it follows every token
whose hash for that run and level is below 1 / (threshold * size). Two sets at the threshold have threshold * size
common tokens at least, size being that of the larger one, so that they follow a common one with a probability of at
least 1 - 1/e, and meet at level k in a run with at least its k-th power. Sets that meet in a bucket are compared by
brute force if the bucket is small; larger buckets are split by the tokens of the next level, and those that are still
large at the last level are dealt out in pairs of blocks, so that no bucket is dropped or capped.

Runs are repeated until the target ``recall`` of pairs at the threshold is met (``needed_runs``): ten for 0.9999 in
buckets of the first level, and for sets that have met in a bucket which had to be split 32, those of the last level.

Buckets compare small sketches and only join sets into candidate groups. Each group is then compared exactly with its
whole texts: that decides every link and counts it once. Groups of up to ``BLOCK`` sets are compared in one task. In
larger ones each set is first compared with the group's reference, the set with the most copies. As the Jaccard distance
is a metric, two sets whose distances from it add up to no more than 1 - threshold are linked, and two whose distances
differ by more are not. Steps of ``STEP`` in distance are put together to zones of about ``BLOCK`` sets; pairs of zones
that are so told apart are counted, and only the others are compared, in pairs of blocks. Equal sets are one class with a count, so copies cost nothing.

Defined results: null and empty texts have no shingles and link with nothing; a text of one to four words is one
shingle; each row is a document, so a repeated row links with its copy, and rows that share a doc_id are compared one by
one; rows with a null doc_id link with nothing; an empty table gives an empty result; other columns are ignored by
``near_texts`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import chunks, runs
from .common import table, wanted, written
from .components import components

SHINGLE, THRESHOLD, LEVELS, RECALL = 5, 0.8, 3, 0.9999
#: Sets in a bucket that are compared by brute force, and in a block of the exact comparison.
BUCKET, BLOCK = 4096, 512
#: Bytes of a sketch, and how many must agree: at the threshold fewer do with probability 10^-5.
SKETCH, AGREE = 48, 26
#: Width of the classes of distance from a large group's reference.
STEP = 0.02

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def needed_runs(recall: float, level: int) -> int:
    """Runs after which a pair at the threshold has met at a level with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.exp(-1)) ** level))


@np.errstate(over="ignore")
def _seed(k: int) -> np.uint64:
    return _mix(np.array([k + 1], np.uint64) * _PRIME)[0] | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.split() if isinstance(t, str) else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.array([w for ws in words for w in ws], object)
    if not len(flat):
        return [np.empty(0, np.uint64) for _ in words]
    h = pd.util.hash_array(flat)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        g = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for i in range(k):
            g = g * _PRIME + h[i : len(h) - k + 1 + i] if len(g) else g
        g = _mix(g)
        out = []
        for end, n in zip(ends, sizes):
            if n >= k:
                out.append(np.unique(g[end - n : end - k + 1]))
            elif n:
                x = _U(n)
                for w in h[end - n : end]:
                    x = x * _PRIME + w
                out.append(_mix(np.array([x], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


@np.errstate(over="ignore")
def set_hash(tokens: np.ndarray) -> int:
    return int(_mix(_mix(tokens).sum(keepdims=True)).view(np.int64)[0]) if len(tokens) else 0


def _sketched(docs: DataFrame, threshold: float, some: range) -> DataFrame:
    """A row for each text with shingles: s1, s2 tell its set; paths of the three levels, of some runs, with their parents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in chunks(b["text"]):
                part = b.iloc[x:y]
                sets = shingle_sets(part["text"])
                kept = [i for i, s in enumerate(sets) if len(s)]
                if kept:
                    yield _paths(part["doc_id"].to_numpy()[kept], [sets[i] for i in kept], threshold, some)

    longs = ", ".join(f"{c} array<bigint>" for c in ("l1", "p2", "l2", "p3", "l3"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, s1 bigint, s2 bigint, n int, sketch binary, {longs}")


@np.errstate(over="ignore")
def _paths(ids, sets, threshold: float, some: range) -> pd.DataFrame:
    n = np.array([len(s) for s in sets])
    tok = np.concatenate(sets)
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    total = lambda v: np.add.reduceat(v, starts)
    s1, s2 = _mix(total(_mix(tok))).view(np.int64), _mix(total(_mix(tok ^ _PRIME)) ^ n.astype(np.uint64)).view(np.int64)
    sketch = np.empty((len(n), SKETCH), np.uint8)
    for k in range(SKETCH):
        sketch[:, k] = (_mix(np.minimum.reduceat(_mix(tok * _seed(k)), starts)) >> _U(56)).astype(np.uint8)
    bar = np.repeat(np.minimum(1.0, 1 / (threshold * n)), n) * 2.0**53
    out = [[[] for _ in n] for _ in range(5)]
    for r in some:
        picked = []
        for level in range(LEVELS):
            h = _mix(tok * _seed(SKETCH + r * LEVELS + level))
            at = np.nonzero((h >> _U(11)) < bar)[0]
            by: dict[int, list[int]] = {}
            for d, t in zip(doc[at], h[at]):
                by.setdefault(d, []).append(int(t))
            picked.append(by)
        for d, first in picked[0].items():
            l1, p2, l2, p3, l3 = (o[d] for o in out)
            for a in first:
                path = hash((r, a))
                l1.append(path)
                for c in picked[1].get(d, ()):
                    longer = hash((path, c))
                    p2.append(path)
                    l2.append(longer)
                    for e in picked[2].get(d, ()):
                        p3.append(longer)
                        l3.append(hash((longer, e)))
    return pd.DataFrame({"doc_id": ids, "s1": s1, "s2": s2, "n": n.astype(np.int32), "sketch": [s.tobytes() for s in sketch], **dict(zip(("l1", "p2", "l2", "p3", "l3"), out, strict=True))})


def _buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, node, n, sketch): level by level, the buckets that are small enough, then blocks of the rest. Then
    the buckets of the first level that were split."""
    rows = reps.select("node", "n", "sketch", F.explode("l1").alias("bucket"))
    done, large, split = None, None, None
    for level in range(1, LEVELS + 1):
        if level > 1:
            pairs = F.explode(F.arrays_zip(F.col(f"p{level}").alias("p"), F.col(f"l{level}").alias("l")))
            rows = reps.select("node", "n", "sketch", pairs.alias("x")).select("node", "n", "sketch", F.col("x.p").alias("parent"), F.col("x.l").alias("bucket"))
            rows = rows.join(large.select(F.col("of").alias("parent")), "parent", "left_semi").drop("parent")
        sizes = rows.groupBy(F.col("bucket").alias("of")).agg(F.count(F.lit(1)).alias("size"))
        large = written(sizes.where(F.col("size") > BUCKET), "large")
        split = large if split is None else split
        small = rows.join(large, F.col("bucket") == F.col("of"), "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done, split
    rest = rows.join(large, F.col("bucket") == F.col("of"))
    return done.unionByName(_in_blocks(rest, "bucket", "node", BUCKET).select("node", "n", "sketch", F.xxhash64("bucket", "lo", "hi").alias("bucket"))), split


def _met(docs: DataFrame, reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Buckets of all runs: sets that were in a bucket which was split have more runs."""
    buckets, split = _buckets(reps)
    if split.isEmpty():
        return buckets
    hot = reps.select("node", "rep", "s1", "s2", F.explode("l1").alias("bucket")).join(split, F.col("bucket") == F.col("of"), "left_semi").select("node", "rep", "s1", "s2").distinct()
    ids = written(hot.select(F.col("rep").alias("doc_id")).distinct(), "again")
    texts = wanted(docs.select("doc_id", "text"), ids, "doc_id").join(ids, "doc_id", "left_semi")
    again = _sketched(texts, threshold, range(needed_runs(recall, 1), needed_runs(recall, LEVELS)))
    more = written(again.join(hot.select("node", "s1", "s2"), ["s1", "s2"]).dropDuplicates(["node"]), "more")
    return buckets.unionByName(_buckets(more)[0])


def _in_blocks(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """rows has size, the rows of a group. Each row goes to every pair (lo, hi) of blocks that holds its own."""
    n = F.ceil(F.col("size") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.hash(member), n)).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("lo", F.least("own", "j")).withColumn("hi", F.greatest("own", "j")).drop("j")


def _stars(near: np.ndarray) -> np.ndarray:
    """The component of each member, as the least index, from a symmetric matrix."""
    label = np.arange(len(near), dtype=np.int32)
    while True:
        least = label.copy()
        for i in range(0, len(near), 256):
            least[i : i + 256] = np.minimum(label[i : i + 256], np.where(near[i : i + 256], label[None, :], len(near)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _candidates(buckets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join the members of a bucket with like sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in runs(batches, "bucket"):
            if len(g) < 2:
                continue
            s = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), SKETCH)
            n, rep = g["n"].to_numpy(), g["node"].to_numpy()
            near = np.empty((len(g), len(g)), bool)
            for i in range(0, len(g), 64):
                near[i : i + 64] = (s[i : i + 64, None, :] == s[None, :, :]).sum(axis=2) >= AGREE
            near &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
            label = _stars(near)
            moved = label != np.arange(len(g))
            a.append(rep[moved])
            b.append(rep[label[moved]])
            if sum(map(len, a)) > 100_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "a bigint, b bigint").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections."""
    if len(sets) == 2:
        x = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]])
    tok, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(tok, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    width = max(256, (1 << 22) // len(sets))
    for x in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [x, x + width])
        m = np.zeros((len(sets), width), np.float32)
        m[of[lo:hi], column[lo:hi] - x] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return np.rint(out).astype(np.int64)


def _compared(texts: DataFrame, threshold: float) -> DataFrame:
    """texts: task, own, lo, hi, node, s1, copies, text. Rows with n >= 0: node a links with n documents of other
    sets; rows with n < 0: a and b are in one group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, "task"):
            sets = shingle_sets(g["text"])
            of = [set_hash(x) for x in sets]
            keep = {r: i for i, (r, x, y) in enumerate(zip(g["node"], of, g["s1"])) if x == y}  # doc_ids may repeat
            g, sets = g.iloc[list(keep.values())], [sets[i] for i in keep.values()]
            if len(g) < 2:
                continue
            n, node, copies, own = np.array([len(s) for s in sets]), g["node"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
            both = _overlaps(sets)
            near = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
            if g["lo"].iloc[0] != g["hi"].iloc[0]:
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            links, label = near @ copies, _stars(near)
            found, moved = links > 0, label != np.arange(len(g))
            yield pd.DataFrame({"a": np.concatenate([node[found], node[moved]]), "b": np.concatenate([node[found], node[label[moved]]]), "n": np.concatenate([links[found], np.full(moved.sum(), -1)])})

    return texts.repartition("task").sortWithinPartitions("task").mapInPandas(run, "a bigint, b bigint, n bigint")


def _from_reference(texts: DataFrame, members: DataFrame) -> DataFrame:
    """group, node, rep, s1, copies, ref, d for the members of large groups: the distance from the group's reference."""
    best = F.max_by(F.struct("node", "rep", "s1"), F.struct("copies", -F.col("node")))
    refs = members.groupBy("group").agg(best.alias("x")).select("group", F.col("x.node").alias("ref"), F.col("x.rep").alias("rep"), F.col("x.s1").alias("s1"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[set_hash(x) == y for x, y in zip(shingle_sets(b["text"]), b["s1"])]][["group", "ref", "text"]]

    texts = wanted(texts, members, "rep")
    shown = texts.join(refs, "rep").select("group", "ref", "s1", "text").mapInPandas(told, "group bigint, ref bigint, text string")
    shown = written(shown.dropDuplicates(["group"]), "references").withColumnRenamed("text", "against")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, against = None, None
        for b in batches:
            for x, y in chunks(b["text"]):
                part, d = b.iloc[x:y], []
                for own, s1, ref, text in zip(shingle_sets(part["text"]), part["s1"], part["ref"], part["against"]):
                    if ref != of:
                        of, against = ref, shingle_sets([text])[0]
                    common = len(np.intersect1d(own, against, assume_unique=True))
                    d.append(1 - common / (len(own) + len(against) - common) if set_hash(own) == s1 else -1.0)
                yield part.assign(d=d)[["group", "node", "rep", "s1", "copies", "ref", "d"]]

    id_type = members.schema["rep"].dataType.simpleString()
    rows = texts.join(members.select("group", "node", "rep", "s1", "copies"), "rep").join(shown, "group")
    out = rows.select("group", "node", "rep", "s1", "copies", "ref", "text", "against").mapInPandas(measured, f"group bigint, node bigint, rep {id_type}, s1 bigint, copies bigint, ref bigint, d double")
    return out.where("d >= 0").dropDuplicates(["node"])


def _large(texts: DataFrame, members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of large groups: what the distances from the references tell, in the form of _compared, and the rows that it must
    still compare."""
    reach = 1 - threshold
    told = _from_reference(texts, members).withColumn("q", F.floor(F.col("d") / STEP).cast("long"))
    told = written(told, "distances")
    cells = told.groupBy("group", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c"))  # at most 51 a group
    before = F.sum("n").over(Window.partitionBy("group").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    cells = written(cells.withColumn("zone", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).cast("long")), "cells")
    zones = cells.groupBy("group", "zone").agg(F.min("q").alias("low"), F.max("q").alias("high"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    zones = zones.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    placed = told.join(cells.select("group", "q", "zone"), ["group", "q"]).join(zones.select("group", "zone", "high", "blocks"), ["group", "zone"])
    a = zones.select("group", "zone", "low", "high")
    b = zones.select("group", F.col("zone").alias("to"), F.col("low").alias("to_low"), F.col("high").alias("to_high"), "c", F.col("blocks").alias("to_blocks"))
    pairs = a.join(b, "group")
    sure = (F.col("high") + F.col("to_high") + 2) * STEP <= reach - 1e-9
    never = (F.greatest(F.col("low") - F.col("to_high"), F.col("to_low") - F.col("high")) - 1) * STEP > reach + 1e-9
    totals = pairs.where(sure).groupBy("group", "zone").agg(F.sum("c").alias("total"))
    own = F.when((2 * F.col("high") + 2) * STEP <= reach - 1e-9, F.col("copies")).otherwise(0)
    counted = placed.join(totals, ["group", "zone"]).select(F.col("node").alias("a"), F.col("node").alias("b"), (F.col("total") - own).alias("n")).where("n > 0")
    joined = placed.where(F.col("d") <= reach + 1e-9).where("node <> ref").select(F.col("node").alias("a"), F.col("ref").alias("b"), F.lit(-1).cast("long").alias("n"))
    code = placed.withColumn("own", F.col("zone") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))).select("group", "zone", "node", "rep", "s1", "copies", "own")
    open_pairs = pairs.where(~sure & ~never).select("group", "zone", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_blocks") - 1)).alias("k"))
    dealt = code.join(open_pairs.select("group", "zone", (F.col("to") * (1 << 32) + F.col("k")).alias("other")), ["group", "zone"])
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return counted.unionByName(joined), dealt.select("node", "rep", "s1", "copies", "own", "lo", "hi", F.xxhash64("group", "lo", "hi").alias("task"))


def near_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id that links reach, itself included), n_links, for each row of docs."""
    sketched = written(_sketched(docs, threshold, range(needed_runs(recall, 1))), "sketches")
    parts = ["n", "sketch", "l1", "p2", "l2", "p3", "l3"]
    sets = sketched.groupBy("s1", "s2").agg(F.min_by(F.struct(*parts), "doc_id").alias("x"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(sets.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "rep", "copies", "x.*"), "sets")
    groups = components(_candidates(_met(docs, reps, threshold, recall), threshold)).select("node", F.col("component").alias("group"))
    groups = groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "group")
    members = written(groups.join(reps.select("node", "rep", "s1", "copies"), "node"), "members")
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    zero = F.lit(0).cast("long")
    dealt = members.where(F.col("size") <= BLOCK).select("node", "rep", "s1", "copies", zero.alias("own"), zero.alias("lo"), zero.alias("hi"), F.col("group").alias("task"))
    large, told = written(members.where(F.col("size") > BLOCK), "crowds"), None
    if not large.isEmpty():
        told, rest = _large(texts, large, threshold)
        dealt = dealt.unionByName(rest)
    # Texts and rows meet by a shuffle at every size, so that costs seen on small tables hold on large ones. Only texts
    # that some row asks for take part.
    texts = wanted(texts, members, "rep")
    found = _compared(texts.join(dealt.hint("merge"), "rep").select("task", "own", "lo", "hi", "node", "s1", "copies", "text"), threshold)
    found = written(found if told is None else found.unionByName(told), "links")
    links = found.where("n >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    classes = components(found.where("n < 0").select("a", "b"))
    names = classes.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = classes.join(names, "component").select("node", "class_id")
    of_set = reps.select("node", "s1", "s2", "rep", "copies").join(links, "node", "left").join(classes, "node", "left")
    of_set = of_set.select("s1", "s2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = sketched.select("doc_id", "s1", "s2").join(of_set, ["s1", "s2"]).select("doc_id", "class_id", "n_links")
    return named.unionByName(_without_words(docs))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are the first of their group, by doc_id, and all that belong to none. Rows that share
    a doc_id stay or go together."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    others = near_texts(docs, threshold).where(F.col("class_id") < F.col("doc_id")).select(F.col("doc_id").alias("of")).distinct()
    first = rows.join(others, F.col("row.doc_id") == F.col("of"), "left_anti")
    return first.select("row.*")


def _without_words(docs: DataFrame) -> DataFrame:
    bare = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)[^\s\x1C-\x1F]")
    return docs.where(bare).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
