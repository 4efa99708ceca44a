"""Centroid clustering in whole numbers, by annulus search.

Vectors become integers, centroids are exact floors of means, and distances are squared Euclidean in 64-bit integers, so a run
has one result whatever the partitions. A vector x that lies at most u from some centroid has its nearest one among those whose
norm is within u of its own, by the triangle inequality. The centroids are therefore sorted by norm, two binary searches
give each vector's range of them, and only these are compared, exactly. The bound u is the distance to the centroid that the vector
had in the round before, or in the first round to the one with the nearest norm. The ends of a range are widened by
more than the rounding of a norm, so that ties on the edge are compared as well.

A round is one pass: it reads the vectors with their clusters, writes them with the new ones to the shared folder, and adds up
the components of each cluster, first within partitions as longs, then as decimals. ``k`` rows of sums come to the driver,
and ``k`` centroids go out with the next round, whatever the number of vectors. Tables of earlier rounds are deleted.

Defined results: vectors that are null, have another length than ``size``, hold null or non-finite components or ones above
``LARGEST`` in integers (squared distances would not fit 64 bits) are not kept; each row is a vector, so repeated rows count each; a null
vec_id hashes as an empty one; among equal hashes the lesser vector comes first, and equal vectors may both become centroids, of which
the smaller number takes all; fewer vectors than ``k`` give fewer centroids; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frames
from .common import removed, table, written

SIZE, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LARGEST = 1 << 27


def kept_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the vectors as integers."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST / scale)
    usable = F.coalesce((F.size("embedding") == size) & F.forall("embedding", fits), F.lit(False))
    return vectors.where(usable).select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of their ids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


class Annuli:
    """Nearest centroids by norm."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted, self.compared = norms[self.order], centroids[self.order], 0

    def nearest(self, x: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, the smaller of ties, and the squared distance."""
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        if before is None:
            right = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
            left = (right - 1).clip(0)
            guess = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        else:
            guess = np.argsort(self.order)[before]  # number to place
        best, distance = self.order[guess], ((x - self.sorted[guess]) ** 2).sum(axis=1)
        far = np.sqrt(distance.astype(float)) * (1 + 1e-9) + norm * 1e-9 + 1e-6
        lo, hi = np.searchsorted(self.norms, norm - far), np.searchsorted(self.norms, norm + far, side="right")
        for place, number in enumerate(self.order):
            at = np.nonzero((lo <= place) & (place < hi) & (guess != place))[0]
            self.compared += len(at)
            d = ((x[at] - self.sorted[place]) ** 2).sum(axis=1)
            nearer = (d < distance[at]) | ((d == distance[at]) & (number < best[at]))
            best[at[nearer]], distance[at[nearer]] = number, d[nearer]
        return best, distance


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, x and maybe cluster) with the cluster and the squared distance under these centroids."""
    known = "cluster" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annuli = Annuli(centroids)
        for b in batches:
            if len(b):
                cluster, distance = annuli.nearest(np.array(b["x"].tolist(), np.int64), b["cluster"].to_numpy(int) if known else None)
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": b["x"], "cluster": cluster, "distance": distance})

    columns = ["vec_id", "x", *["cluster"] * known]
    id_type = rows.schema["vec_id"].dataType.simpleString()
    return frames(rows.select(*columns), run, f"vec_id {id_type}, x array<bigint>, cluster int, distance bigint")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; empty ones keep their centroid."""
    size = centroids.shape[1]
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(size)]
    parts = rows.groupBy("cluster", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), *sums)
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    new = centroids.copy()
    for r in total.collect():  # at most k rows
        new[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return new


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster, distance after the last assignment; the final centroids."""
    rows = written(kept_vectors(vectors, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), centroids
    for turn in range(rounds + 1):
        last, rows = rows, written(assigned(rows, centroids), "assigned")
        removed(last)
        if turn < rounds:
            centroids = moved(rows, centroids)
    return rows, centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    own = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(own)]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assignment_sql(turn: int) -> str:
    return f"""
d{turn} AS (SELECT v.row, c.number, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT AS d FROM v, c{turn} c),
a{turn} AS MATERIALIZED (SELECT row, arg_min(number, d::HUGEINT * {K} + number) AS number, min(d) AS distance FROM d{turn} GROUP BY row)"""


def _means_sql(turn: int) -> str:
    return f"""
m{turn} AS (SELECT a.number, i, sum(v.x[i]) AS s, count(*) AS n FROM a{turn} a JOIN v USING (row), range(1, {SIZE + 1}) AS r(i) GROUP BY a.number, i),
f{turn} AS (SELECT number, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{turn} GROUP BY number),
c{turn + 1} AS MATERIALIZED (SELECT c.number, coalesce(f.x, c.x) AS x FROM c{turn} c LEFT JOIN f{turn} f USING (number))"""


OP11_SQL = f"""
WITH u AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM u),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name, x) - 1 AS number, x FROM (SELECT sha256('{SEED}:' || vec_id) AS name, x FROM v ORDER BY name, x LIMIT {K})),
{",".join(_assignment_sql(t) + "," + _means_sql(t) for t in range(ROUNDS))},{_assignment_sql(ROUNDS)},
t AS (SELECT number, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY number)
SELECT v.vec_id, a.number::INTEGER AS cluster, a.distance, t.cluster_inertia, (SELECT sum(cluster_inertia) FROM t)::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (row) JOIN t USING (number) JOIN c{ROUNDS} c USING (number)
"""
