"""The pipeline against plainer versions of its stages."""

import corpus_pipeline as P
from framewright.llm import quality_rules as Q
from framewright.llm import secrets as S
from framewright.llm.common import written
from framewright.llm.text_stats import with_stats

from .test_line_dedup import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    columns, held = docs.columns, docs
    for name, stage in P.STAGES:
        was, held = held, written(stage(spark, held, sf), name)
        if name == "quality_rules":
            failed = {r.doc_id for r in written(with_stats(was.select("doc_id", "text")), "stats").where(Q.base_failed()).collect()}
            assert {r.doc_id for r in held.collect()} <= {r.doc_id for r in was.collect()} - failed
        if name == "line_dedup":
            lines = {i: n - lost for i, n, lost, _ in brute([(r.doc_id, r.text) for r in was.collect()])}
            assert {r.doc_id: len(r.text.split("\n")) for r in held.collect()} == {i: max(n, 1) for i, n in lines.items()}
        if name == "near_duplicates":
            sets = {}
            for r in sorted(was.collect(), key=lambda r: r.doc_id):
                w = r.text.split()
                s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
                sets[r.doc_id] = s
            kept = {r.doc_id for r in held.collect()}
            for i in set(sets) - kept:  # each lost document has a like one before it or in its group
                assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)
            for i in kept:
                assert not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept if j != i and sets[i] and sets[j])
        if name == "secret_scan":
            assert all(not S.base_spans(r.text) for r in held.collect())
            assert held.count() == was.count()
        if name != "packing":
            assert held.columns == columns
            assert all(r.n_chars == len(r.text) for r in held.collect())
    assert {r.doc_id for r in held.collect()} == {r.doc_id for r in was.collect()}


def test_pipeline_is_registered(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is P.run
    assert [sum(q.startswith(f"op{n}_") for q in e.queries()) for n in range(1, 14)] == [1] * 13


ODD = "doc_id long, text string, lang string, source string, n_chars long, tag long, words string, row int, lines string"


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns: each stage gives the columns of documents, and
    each text is kept, lost or changed by its own rules only."""
    prose = lambda k: " ".join(f"w{(k * 31 + j * j) % 977}x{k}" for j in range(60))
    rows = [(k, prose(k), "en", "a", 1, k, "w", 1, "l") for k in range(40)]
    rows += [(7, prose(7), "en", "a", 1, 7, "w", 1, "l")]  # a repeated row
    rows += [(100, prose(3) + " tail", None, None, None, 0, None, None, None)]  # a near copy
    rows += [(101, None, "en", "a", 5, 0, "", 0, ""), (102, "", "en", "a", 5, 0, "", 0, ""), (None, prose(200), "en", "a", 1, 0, "", 0, ""), (103, "short", "en", "a", 1, 0, "", 0, "")]
    rows += [(104, " ".join(prose(k) for k in range(300, 2300)), "en", "a", 1, 0, "", 0, "")]  # 120,000 words
    rows += [(105, prose(201) + " password = hunter2hunter2hunter2", "en", "a", 1, 0, "", 0, "")]
    held = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    for name, stage in P.STAGES:
        held = written(stage(spark, held, str(tmp_path)), name)
        seen[name] = held.collect()
        if name != "packing":
            assert held.columns == P.COLUMNS
    ids = {name: sorted((r.doc_id for r in found), key=repr) for name, found in seen.items()}
    assert not {101, 102, 103} & set(ids["quality_rules"]) and {100, 104, 105, None} <= set(ids["quality_rules"])
    assert ids["line_dedup"] == ids["quality_rules"]  # no line is in five documents
    kept = ids["near_duplicates"]
    assert kept.count(7) == 2 and 100 not in kept  # rows of one doc_id stay together and 3 in kept and {104, 105} <= set(kept)
    texts = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert "hunter2hunter2" not in texts[105] and "[SECRET]" in texts[105] and texts[104] == rows[-2][1]
    assert {r.doc_id for r in seen["packing"]} == set(kept)


def test_no_documents(spark, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("documents", "doc_id long, text string, lang string, source string, n_chars long")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
