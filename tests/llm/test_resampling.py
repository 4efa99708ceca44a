import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from framewright.llm import resampling as R

SCHEMA = "doc_id long, text string, score int, rank string"


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plainly(docs, target, min_words=20, percent=25):
    """rows of (doc_id, n_features, weight, score, rank), by the definition."""
    own = [(d, *_features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in _features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0], -r[2], -r[3]))
    rank = {id(r): k for k, r in enumerate(able, 1) if k <= percent * len(able) // 100}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_is_the_definition(spark, sf):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("text",))).collect()]
    assert got(R.op12_importance_resampling(spark, sf)) == plainly(read("documents"), [x for (x,) in read("benchmark")])


@pytest.fixture(scope="module")
def odd():
    words = "alpha BETA gamma Ärger ſtraße 日本 x1 2y"
    rows = [(1, None), (2, ""), (3, "..."), (4, words * 4), (4, words * 4), (4, words * 5), (5, " ".join([words] * 3)), (6, "one"), (7, "É É é"), (None, words + " a" * 30), (None, words + " a" * 30), (8, "w " * 20), (9, "w " * 19)]
    rows += [(k, " ".join(f"t{(k * j) % 13}" for j in range(25))) for k in range(20, 60)]
    rows += [(100, "same text " * 12)] * 30  # a third of all rows, one doc_id
    rows += [(200, "long " * 200_000)]
    return rows


def test_odd_rows(spark, odd):
    docs = spark.createDataFrame([(d, t, 5, "mine") for d, t in odd], SCHEMA)
    target = ["alpha beta gamma", None, "", "t1 t2 t3 long long"]
    other = spark.createDataFrame([(k, t, 0, "") for k, t in enumerate(target)], SCHEMA)
    for percent in (25, 0, 100):
        assert got(R.drawn(R.scored(docs, other), percent=percent)) == plainly(odd, target, percent=percent)


def test_empty_tables(spark, odd):
    docs = spark.createDataFrame([(d, t, 5, "mine") for d, t in odd], SCHEMA)
    none = docs.limit(0)
    assert got(R.drawn(R.scored(none, docs))) == []
    assert got(R.drawn(R.scored(docs, none))) == plainly(odd, [])


def test_scoring_explodes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = R.scored(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
