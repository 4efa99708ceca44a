"""Ids beside nulls, very long roles and texts, and thousands of equal rows."""

import time

import pytest

from framewright.llm import boosting as B
from framewright.llm import chat as C
from framewright.llm import metric_join as M
from framewright.llm import packing as P
from framewright.llm import secrets as S
from framewright.llm import sentence_pieces as T
from framewright.llm import suffix_dedup as X

BIG = 2**60 + 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None, "one"), (BIG, "password = abcdef012345 two"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)


def test_ids_beside_nulls(docs):
    want = {None, BIG, BIG + 2}
    assert {r.doc_id for r in P.pack_documents(docs).collect()} == want
    assert {r.doc_id for r in P.pack_documents(docs, with_ids=False).collect()} == want
    assert {r.doc_id for r in T.encode_documents(docs, digest=True).collect()} == want
    assert {r.doc_id: r.text for r in T.decode_ids(T.encode_documents(docs)).collect()} == {None: "one", BIG: "password = abcdef012345 two", BIG + 2: ""}
    found = {r.doc_id: len(r.spans) for r in S.find_secrets(docs).collect()}
    assert set(found) == want and found[BIG] > 0 == found[None]


def test_vector_ids_beside_nulls(spark):
    rows = [(None, [1.0, 2.0]), (BIG, [1.0, 2.1]), (BIG + 2, [1.0, 2.0]), (None, [-1.0, 0.0]), (7, None), (None, None)]
    out = M.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=repr)
    assert got == sorted([(None, 2, BIG, False), (BIG, 2, BIG, True), (BIG + 2, 2, BIG, False), (None, 0, None, True), (7, 0, 7, True), (None, 0, None, True)], key=repr)


def test_roles_of_any_length(spark):
    long, odd = "r" * 1_000_000, "\\:" * 20_000
    rows = [(1, 0, long, "a"), (1, 1, odd, "b"), (1, 2, "assistant", "c:" * 1000)]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select(C.read_turns(out.formatted).alias("t")).first().t
    assert [(x.role, x.text) for x in back] == [(r[2], r[3]) for r in rows]


def test_long_runs_of_blanks():
    t = T.compiled(T.model_path())
    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        for text in (" " * n, " " * n + "word", "=" * n):
            assert t.decode(t.encode(text)) == text
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_thousands_of_equal_rows(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.range(10_000).selectExpr("5L AS doc_id", f"'{text}' AS text")
    named, spans = X.repeated_spans(docs)
    assert [len(r.spans) for r in spans.collect()] == [len({(s.start, s.end) for s in spans.first().spans})]
    out = X.without_repeats(docs).groupBy("doc_id", "kept").count().collect()
    assert [(r.doc_id, bytes(r.kept), r["count"]) for r in out] == [(5, b"", 10_000)]
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    seen = []
    fit, B.fit = B.fit, lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k)
    try:
        B.fit_quality(docs, labels)
    finally:
        B.fit = fit
    assert seen == [1]


def test_components_with_paths_and_hot_nodes(spark):
    from framewright.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 3000)] + [(5000 + k, 6000) for k in range(500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000, 5000} and len(got) == 301 + 3000 + 501
