"""Embedding near-dedup: an exact metric range join over pivots.

Two vectors link when their cosine, in double precision, is at least ``min_cosine``, that is when their angle is at
most r. Each vector's home is the cell of its nearest pivot. A vector y is replicated to another cell only if none of
these bounds tells that it is further than r from all that the cell holds:

* the triangle inequality with each of the first ``REFERENCES`` pivots q: the cell's vectors lie at angles between
  lo and hi from q, so y must lie between lo - r and hi + r; and with the cell's own pivot;
* the bisecting hyperplane of y's pivot q and the cell's pivot p, which separates the cells: y must lie no further
  from it than the chord of r, that is cos(y, q) - cos(y, p) <= chord(r) * chord(p, q).

Neighbouring cells are joined into blocks, large cells are split into several, and each pair of blocks has one host,
so that a pair of vectors meets once. A task holds the vectors of its own block, the others stream past in Arrow
batches. There are twice as many blocks as the cluster has cores, and more only if they would pass ``BLOCK`` vectors or
``BYTES``; rows dealt out are therefore at most the vectors times half the blocks. Products are taken in single
precision, with all within the rounding error of the limit decided again in double precision.

Vectors of each length join by themselves. Equal vectors are one class with a count, so copies cost nothing. The
pivots come from a bounded sample of ``SAMPLE`` vectors, at most ``MAX_PIVOTS``; they decide the cost only, never the
result. Lengths that the sample lacks are a cell each, with no bounds. The driver holds ``REFERENCES`` numbers for each
pivot and a row for each length; n lengths need vectors of n^2 / 2 numbers, so these are few.

Defined results: null vectors, those with null or non-finite components, zero ones and empty ones link with nothing;
each row is a vector, so a repeated row links with its copy, and rows that share a vec_id are compared one by one;
a row with a null vec_id is a vector like others, but names no component: the component of a group is the least vec_id
that isn't null, and null where there is none (kept is then true); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frames
from .common import table, written
from .components import components

SAMPLE, MAX_PIVOTS, REFERENCES = 4096, 1024, 32
#: Vectors, and their bytes, that a task holds at most beside a batch.
BLOCK, BYTES = 16384, 1 << 26
#: Slack in radians and in cosines, far above the rounding of either; it only replicates a little more.
SLACK = 1e-5


def _unit(blobs) -> np.ndarray:
    """Rows of length 1, all of one size. A power of two first brings each row near 1, so that no square overflows
    or vanishes."""
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(unit: np.ndarray, k: int) -> np.ndarray:
    """Farthest first."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which neighbours are near, so that blocks of several cells are compact."""
    cos, left, order = pivots @ pivots.T, set(range(1, len(pivots))), [0]
    while left:
        rest = np.fromiter(left, int)
        order.append(int(rest[cos[order[-1], rest].argmax()]))
        left.remove(order[-1])
    return pivots[order]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class key, and one row for each class of equal usable vectors: node, rep, copies, size, x, where
    x is the vector at length 1."""
    usable = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))).alias("e"))
    some = F.col("e").isNotNull()
    keyed = rows.select("vec_id", F.when(some, F.xxhash64(F.lit(1), F.size("e"), "e")).alias("h1"), F.when(some, F.xxhash64(F.lit(2), "e", F.size("e"))).alias("h2"), "e")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["e"].map(len).to_numpy(int)
            x = np.empty(len(b), object)
            for n in np.unique(size):
                at = np.nonzero(size == n)[0]
                x[at] = [v.tobytes() for v in _unit([np.asarray(e, "<f8").tobytes() for e in b["e"].iloc[at]])]
            yield pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "rep": b["rep"], "copies": b["copies"], "size": size, "x": x})

    reps = keyed.where("e is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e"))
    made = frames(reps, packed, "h1 bigint, h2 bigint, rep bigint, copies bigint, size int, x binary")
    return keyed.drop("e"), made.withColumn("node", F.monotonically_increasing_id())


def _by_size(b: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for n, part in b.groupby("size", sort=False):
        yield int(n), part, np.frombuffer(b"".join(part["x"]), "<f8").reshape(len(part), -1)


@dataclass
class Layout:
    """The cells of the vectors of one size, in order, and the blocks they make. Cell c has blocks first[c] up to
    first[c] + parts[c]; a block of several cells is shared by them."""

    pivots: np.ndarray
    far: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    total: int = 0
    base: int = 0

    def homes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cosines with all pivots and the cell of each row; one cell where there are no pivots."""
        if not len(self.pivots):
            return np.ones((len(unit), 1)), np.zeros(len(unit), int)
        cos = unit @ self.pivots.T
        return cos, cos.argmax(axis=1)

    def meets(self, cos: np.ndarray, home: np.ndarray, r: float) -> np.ndarray:
        """For each row and cell, whether the cell may hold a vector within r."""
        if not len(self.pivots):
            return np.ones((len(cos), 1), bool)
        angle = np.arccos(np.clip(cos, -1, 1))
        chord = np.sqrt(np.maximum(2 - 2 * self.pivots[home] @ self.pivots.T, 0))
        to = angle <= self.far[None, :] + r + SLACK
        to &= cos[np.arange(len(cos)), home][:, None] - cos <= np.sqrt(2 - 2 * np.cos(r)) * chord + SLACK
        for j in range(self.lo.shape[1]):
            to &= (angle[:, j, None] >= self.lo[None, :, j] - r - SLACK) & (angle[:, j, None] <= self.hi[None, :, j] + r + SLACK)
        return to

    def blocks(self, to: np.ndarray) -> np.ndarray:
        """For each row and block, whether one of the block's cells is met."""
        wide = np.repeat(to, self.parts, axis=1)
        of = np.repeat(self.first, self.parts) + np.concatenate([np.arange(p) for p in self.parts])
        starts = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
        return np.logical_or.reduceat(wide, starts, axis=1)


def _hosts(host: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """Of each pair of blocks one hosts the other, and each hosts half of them."""
    return np.where(host < guest, (host + guest) % 2 == 0, (host + guest) % 2 == 1) & (host != guest)


def layouts(reps: DataFrame, n: int, cores: int) -> dict[int, Layout]:
    """By the size of the vectors."""
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    sample = reps.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("size", "x").limit(SAMPLE).collect()
    k = min(MAX_PIVOTS, max(1, int(np.sqrt(n) / 4)))
    by_size: dict[int, list] = {}
    for s in sample:
        by_size.setdefault(s["size"], []).append(s["x"])
    none = np.empty((0, 0))
    pivots = {d: _chained(choose_pivots(_unit(x), max(1, k * len(x) // len(sample)))) for d, x in by_size.items()}

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for d, _, unit in _by_size(b):
                own = Layout(pivots.get(d, none), *[none] * 5)
                cos, cell = own.homes(unit)
                angle = np.arccos(np.clip(cos, -1, 1))
                near = angle[np.arange(len(unit)), cell]
                for c in np.unique(cell):
                    at = cell == c
                    got = at.sum(), near[at].max(), angle[at, :REFERENCES].min(axis=0), angle[at, :REFERENCES].max(axis=0)
                    was = held.get((d, int(c)))
                    held[d, int(c)] = got if was is None else (got[0] + was[0], max(got[1], was[1]), np.minimum(got[2], was[2]), np.maximum(got[3], was[3]))
        rows = [(d, c, j, int(n), float(far), float(lo[j]), float(hi[j])) for (d, c), (n, far, lo, hi) in held.items() for j in range(len(lo))]
        yield pd.DataFrame(rows, columns=["size", "cell", "j", "n", "far", "lo", "hi"])

    seen = frames(reps.select("size", "x"), home, "size int, cell int, j int, n bigint, far double, lo double, hi double")
    told = seen.groupBy("size", "cell", "j").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row for each cell and reference
    out: dict[int, Layout] = {}
    base = 0
    for d in sorted({t["size"] for t in told}):
        p = pivots.get(d, none)
        cells, refs = max(len(p), 1), min(max(len(p), 1), REFERENCES)
        count, far = np.zeros(cells, int), np.full(cells, -np.inf)
        lo, hi = np.full((cells, refs), np.inf), np.full((cells, refs), -np.inf)
        for t in (t for t in told if t["size"] == d):
            c, j = t["cell"], t["j"]
            count[c], far[c], lo[c, j], hi[c, j] = t["n"], t["far"], t["lo"], t["hi"]
        room = max(1, min(BLOCK, BYTES // (8 * max(d, 1)), -(-n // (2 * cores))))
        first, parts, at, used = np.zeros(cells, int), np.ones(cells, int), 0, 0
        for c in range(cells):
            if used and used + count[c] > room:
                at, used = at + 1, 0
            first[c], parts[c] = at, max(1, -(-count[c] // room))
            at, used = (at + parts[c], 0) if parts[c] > 1 else (at, used + count[c])
        total = int((first + parts).max())
        out[d] = Layout(p, far, lo, hi, first, parts, total, base)
        base += total
    return out


def _dealt(reps: DataFrame, plan: dict[int, Layout], r: float) -> DataFrame:
    """Rows (task, other, size, node, copies, x): other is false for the task's own vectors."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, some, _ in _by_size(batch):
                of = plan[d]
                step = max(1, (1 << 22) // max(of.total, len(of.first)))
                for at in range(0, len(some), step):
                    b = some.iloc[at : at + step]
                    unit = np.frombuffer(b"".join(b["x"]), "<f8").reshape(len(b), -1)
                    cos, home = of.homes(unit)
                    own = of.first[home] + b["h2"].to_numpy() % of.parts[home]
                    to = of.blocks(of.meets(cos, home, r)) & _hosts(np.arange(of.total)[None, :], own[:, None])
                    to[np.arange(len(b)), own] = True
                    row, block = np.nonzero(to)
                    part = b.iloc[row]
                    yield pd.DataFrame({"task": of.base + block, "other": block != own[row], "size": d, "node": part["node"].to_numpy(), "copies": part["copies"].to_numpy(), "x": part["x"].to_numpy()})

    return frames(reps.select("h2", "node", "copies", "size", "x"), deal, "task int, other boolean, size int, node bigint, copies bigint, x binary")


class _Block:
    """The vectors of one block. label: the component of each, within what has been seen."""

    def __init__(self, limit: float):
        self.limit, self.parts, self.x = limit, [], None

    def close(self):
        own = pd.concat(self.parts)
        self.node, self.copies = own["node"].to_numpy(), own["copies"].to_numpy()
        self.x = np.frombuffer(b"".join(own["x"]), "<f8").reshape(len(own), -1)
        self.low = self.x.astype(np.float32)
        #: Beyond the rounding error of a product in single precision.
        self.slack = np.float32((self.x.shape[1] + 8) * 2.5e-7)
        self.label = np.arange(len(own))
        self.links = np.zeros(len(own), np.int64)
        self.told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 22) // len(own))
        for at in range(0, len(own), step):
            i, j = self._near(self.x[at : at + step])
            i, j = i[i != j + at], j[i != j + at] + at
            np.add.at(self.links, i, self.copies[j])
            self._join(i, j)

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = self.low @ x.astype(np.float32).T
        i, j = np.nonzero(cos >= np.float32(self.limit) - self.slack)
        close = np.nonzero(cos[i, j] < np.float32(self.limit) + self.slack)[0]
        if len(close):
            exact = np.einsum("ij,ij->i", self.x[i[close]], x[j[close]]) >= self.limit
            gone = close[~exact]
            i, j = np.delete(i, gone), np.delete(j, gone)
        return i, j

    def _join(self, i: np.ndarray, j: np.ndarray):
        """Own vectors i and j are in one component."""
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def meet(self, rest: pd.DataFrame):
        x = np.frombuffer(b"".join(rest["x"]), "<f8").reshape(len(rest), -1)
        node, copies = rest["node"].to_numpy(), rest["copies"].to_numpy()
        step = max(1, (1 << 22) // len(self.x))
        for at in range(0, len(x), step):
            i, j = self._near(x[at : at + step])
            if not len(i):
                continue
            np.add.at(self.links, i, copies[at + j])
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            starts = np.nonzero(np.append(True, j[1:] != j[:-1]))[0]
            self.told.append((node[at + j[starts]], self.node[i[starts]], np.add.reduceat(self.copies[i], starts)))
            self._join(i, np.repeat(i[starts], np.diff(np.append(starts, len(i)))))

    def out(self) -> pd.DataFrame:
        """Rows (a, b, n): a links with n vectors; a and b are in one component."""
        found = np.nonzero(self.links > 0)[0]
        a, b, n = (np.concatenate(c) for c in zip((self.node[found], self.node[self.label[found]], self.links[found]), *self.told))
        return pd.DataFrame({"a": a, "b": b, "n": n})


def _joined(dealt: DataFrame, tasks: int, min_cosine: float) -> DataFrame:
    """Rows (a, b, n): a links with n vectors of other classes in one task, and is in one component with b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, block = None, _Block(min_cosine)
        for b in batches:
            for t, part in b.groupby("task", sort=False):
                if t != task:
                    if block.parts:
                        if block.x is None:
                            block.close()
                        yield block.out()
                    task, block = t, _Block(min_cosine)
                own, rest = part[~part["other"]], part[part["other"]]
                if len(own):
                    block.parts.append(own)
                if len(rest) and block.parts:
                    if block.x is None:
                        block.close()
                    block.meet(rest)
        if block.parts:
            if block.x is None:
                block.close()
            yield block.out()

    sorted_rows = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "other")
    return frames(sorted_rows, run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, min_cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    keyed, reps = classes(vectors)
    reps = written(reps, "vectors")
    plan = layouts(reps, reps.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, sum(p.total for p in plan.values()))
    found = written(_joined(_dealt(reps, plan, float(np.arccos(min_cosine))), tasks, min_cosine), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = components(found.select("a", "b"))
    names = reps.select("node", "h1", "h2", "rep", "copies").join(counts, "node", "left").join(groups, "node", "left")
    names = names.withColumn("component", F.coalesce("component", "node"))
    least = names.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("component_id"))
    classed = names.join(least, F.col("component") == F.col("of")).select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    some = keyed.where("h1 is not null").join(classed, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    bare = keyed.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(bare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, so for small tables only. The rows hold lists of one length.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a
"""
