import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import components as C
from framewright.llm import jaccard_join as J
from framewright.llm import metric_join as M
from framewright.llm import suffix_dedup as S
from framewright.llm.common import wanted


def groups(edges, nodes):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + k) for k in range(200)]
    want = groups(edges, {n for e in edges for n in e})
    got = C.components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(4)
    base = r.normal(size=(120, 8))
    near = base[0] + r.normal(size=(60, 8)) * 0.15
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:20], base[:10] * 3.0]).astype(np.float32))]
    other = [[1.0] * 3] * 2 + [[2.0] * 3, [-1.0, 0.0, 0.0], [5.0], [-5.0], [7.0]] + [(r.normal(size=5) + 3).tolist() for _ in range(20)]  # of other lengths
    odd = other + [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 7, [], [1e-30] * 8, [1e30] * 8]
    return [(i, [float(x) for x in v], 1) for i, v in rows] + [(1000 + k, v, 1) for k, v in enumerate(odd)]


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SAMPLE", 4096 if block > 16 else 12)
    rows = vectors()
    good = {i: np.array(v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    edges = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    links, of = Counter(a for a, _ in edges), groups(edges, [i for i, _, _ in rows])
    out = M.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (links[i], of[i], of[i] == i) for i, _, _ in rows}


def test_no_vectors(spark):
    assert M.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    out = M.near_vectors(spark.createDataFrame([(5, None), (6, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(5, 0, 5, True), (6, 0, 6, True)]


def near_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    shared = " ".join(word() for _ in range(40))
    rows = []
    for k in range(60):
        base = [word() for _ in range(80)]
        rows.append((len(rows), " ".join(base) + (" " + shared if k % 2 else "")))
        for _ in range(k % 4):
            copy = base[:]
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(80)] = word()
            rows.append((len(rows), " ".join(copy) + (" " + shared if k % 2 else "")))
    base = [word() for _ in range(90)]
    for _ in range(80):
        copy = base[:]
        copy[r.randrange(90)] = word()
        rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one two"), (905, "one two three"), (906, rows[0][1]), (None, rows[0][1]), (907, "w " * 4000)]


@pytest.mark.parametrize("bucket", [4096, 8])
def test_texts_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(J, "BUCKET", bucket)
    monkeypatch.setattr(J, "BLOCK", max(bucket // 2, 4))
    rows = near_rows()
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None and w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    edges = [(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    links, of = Counter(a for a, _ in edges), groups(edges, [i for i, _ in rows if i is not None])
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, rep int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_texts(docs).collect()}
    assert got == {i: (of[i], links[i]) for i in of} | {None: (None, 0)}
    if bucket > 8:
        kept = J.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in of if of[i] == i)
        assert J.near_texts(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark):
    r = random.Random(11)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60))
    a, b = text(), text()
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a)]
    out = J.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in out) == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1)]


@pytest.mark.parametrize("copies", [2, 60])
def test_recall_where_all_buckets_are_split(spark, monkeypatch, copies):
    """Texts made of passages that many share; also groups whose sets lie at any distance from their reference."""
    monkeypatch.setattr(J, "BUCKET", 12)
    monkeypatch.setattr(J, "BLOCK", 16)
    r = random.Random(copies)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for k in range(120 // copies):
        base, chosen = [word() for _ in range(12)], r.sample(shared, 2 + k % 3)
        for c in range(copies):
            body = base[:]
            for _ in range(r.randint(0, 1)):
                body[r.randrange(12)] = word()
            rows.append((len(rows), " ".join([*chosen, *body]) if copies == 2 else " ".join([*shared[:2], *body, *[word() for _ in range(c % 9)]])))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    links = {i: sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for j, s in sets.items() if j != i) for i in sets}
    out = {x.doc_id: x.n_links for x in J.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] <= links[i] for i in links)
    assert sum(out.values()) >= 0.999 * sum(links.values()) and sum(links.values()) > 40


def test_runs_follow_the_target():
    assert [J.needed_runs(0.9999, k) for k in (1, 2, 3)] == [10, 19, 32] and J.needed_runs(0.9, 1) == 3


def lost(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for (d, _), b in zip(rows, raw) if d is not None for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_suffixes_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(S, "SEGMENT", 700)
        monkeypatch.setattr(S, "TOGETHER", 3000)
        monkeypatch.setattr(S, "HOT", 2)
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choices("abcdéf", k=4)) for _ in range(n))
    shared, line = words(60), words(42)
    rows = [(k, words(30) + shared[k : 150 + 8 * k] + words(20)) for k in range(25)]
    rows += [(100, None), (101, ""), (102, "z" * 199), (103, "z" * 700), (104, line), (105, line), (105, line + "!"), (106, "é" * 150), (107, words(5) + line[3:] + line[3:]), (None, shared), (108, shared[:199]), (109, shared[:200])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")
    out = S.without_repeats(docs).collect()
    got = sorted(((x.doc_id, x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in out), key=repr)
    assert got == lost(rows)
    assert S.without_repeats(docs.limit(0)).count() == 0


def clusters():
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 16))
    return np.concatenate([centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16)) * 0.25, r.normal(size=(500, 16))])


def test_bounds_prune_clusters_and_lose_nothing(spark):
    x = clusters()
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    out = {r.vec_id: r.n_links for r in M.near_vectors(docs).collect()}
    assert out == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    from framewright.llm.common import written

    reps = written(M.classes(docs)[1], "vectors")
    plan = M.layouts(reps, len(x), 16)
    dealt = M._dealt(reps, plan, float(np.arccos(0.9))).count()
    assert dealt < 0.75 * len(x) * (plan[16].total + 1) / 2  # less than all pairs of blocks


def test_wanted_rows_all_pass(spark):
    rows = spark.range(20000).selectExpr("if(id = 7, null, id) doc_id", "id page", "'x' bits")
    keys = spark.range(20000).where("id % 17 = 3").select(F.col("id").alias("doc_id"))
    got = wanted(rows, keys, "doc_id")
    assert got.columns == rows.columns
    assert got.join(keys, "doc_id").count() == keys.count() <= got.count() < keys.count() + 100
    assert wanted(rows, keys.where("false"), "doc_id").count() == 0
    assert wanted(rows.where("false"), keys, "doc_id").count() == 0
