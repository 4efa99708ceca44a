import hashlib

import numpy as np
import pytest

from framewright.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int"


def plainly(rows, k=40, rounds=5, size=64):
    """Sorted rows of the result by all distances, in Python's integers."""
    own = [(v, np.floor(256 * np.array(e, np.float32).astype(float))) for v, e in rows if e is not None and len(e) == size and all(y is not None and np.isfinite(y) for y in e)]
    own = [(v, e.astype(np.int64)) for v, e in own]
    if not own:
        return []
    x = np.array([e for _, e in own])
    first = sorted(range(len(own)), key=lambda i: (hashlib.sha256(f"2:{'' if own[i][0] is None else own[i][0]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[first]
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        if turn < rounds:
            c = np.array([[int(s) // (best == j).sum() for s in x[best == j].sum(axis=0)] if (best == j).any() else c[j] for j in range(len(c))], np.int64)
    near = d[np.arange(len(x)), best]
    told = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted(((v, int(b), int(n), int(near[best == b].sum()), int(near.sum()), told[b]) for (v, _), b, n in zip(own, best, near)), key=repr)


def result(monkeypatch, spark, rows, **how):
    table = spark.createDataFrame([(v, e, 1, "mine", 7) for v, e in rows], SCHEMA)
    monkeypatch.setattr(C, "table", lambda *_: table)
    for name, value in how.items():
        monkeypatch.setattr(C, name, value)
    return sorted((tuple(r) for r in C.op11_centroid_clustering(spark, "").collect()), key=repr)


def test_query_is_the_definition(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = C.op11_centroid_clustering(spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plainly(rows)


def test_odd_vectors(monkeypatch, spark):
    rng = np.random.default_rng(3)
    near = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(120)]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (None, [0.5] * 64), (None, [0.5] * 64)]
    same = [(300, near[5][1])] * 60 + [(301 + k, near[5][1]) for k in range(30)]  # a third of all rows
    ties = [(400 + k, [float((k >> j) & 1) for j in range(64)]) for k in range(64)]  # equal norms and distances
    rows = near + odd + same + ties
    assert result(monkeypatch, spark, rows) == plainly(rows)


def test_few_vectors_and_none(monkeypatch, spark):
    few = [(k, [float(k % 3)] * 64) for k in range(7)]
    assert result(monkeypatch, spark, few) == plainly(few)
    assert result(monkeypatch, spark, [(1, None)]) == [] and result(monkeypatch, spark, []) == []


def test_large_components(monkeypatch, spark):
    """What 64 bits can't hold is left out; what they can is exact."""
    rows = [(k, [float((-1) ** (j * k) * (500_000 + 100 * k)) for j in range(64)]) for k in range(50)]
    assert result(monkeypatch, spark, rows + [(99, [1e30] * 64)]) == plainly(rows)


@pytest.mark.parametrize("spread", [0.0, 1.0, 30.0])
def test_annuli_find_the_nearest_with_few_comparisons(spread):
    rng = np.random.default_rng(4)
    centroids = np.floor(rng.normal(size=(40, 8)) * 100 * (1 + spread * rng.random((40, 1)))).astype(np.int64)
    centroids[7] = centroids[3]
    x = np.concatenate([centroids, np.floor(centroids[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 5).astype(np.int64)])
    d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    plain = C.Annuli(centroids)
    for before in (None, rng.integers(0, 40, len(x)), d.argmin(axis=1)):
        best, distance = plain.nearest(x, before)
        assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    tight = C.Annuli(centroids)
    tight.nearest(x, d.argmin(axis=1))
    assert tight.compared < len(x) * 40 / 4
