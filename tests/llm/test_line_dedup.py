import hashlib
from collections import defaultdict

from framewright.llm import line_dedup as L

LINE = "x" * 45
STRIP = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans(L.UPPER, L.LOWER)
    key = lambda x: x.strip(STRIP).translate(low)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not i < last.get(key(x), i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "other") for i, t in rows], "doc_id long, text string, n_lines int, kept string")
    from pyspark.sql import functions as F

    out = L.filtered(docs, L.keep_bitmaps(docs)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=repr), docs


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, LINE), (3, f"a\n{LINE}\n\nb"), (4, f"  {LINE.upper()}\t\n"), (5, f"{LINE}\n{LINE}"), (6, LINE), (7, f"É{LINE}\n{LINE}\r\nq\n{LINE}"), (7, f"{LINE}\nother"), (8, "y" * 39), (6, LINE)]
    rows += [(20 + k, "z" * 50 + "\n" + "\n".join(f"{k} {j}" for j in range(200))) for k in range(6)]
    got, docs = run(spark, rows)
    assert got == brute(rows)
    assert L.dedup_lines(docs).columns == docs.columns
    assert {r.text for r in L.dedup_lines(docs).where("doc_id = 1").collect()} == {None}


def test_long_documents_cross_bitmap_words(spark):
    shared = [f"line {k} " + "w" * 40 for k in range(300)]
    rows = [(d, "\n".join(shared[d:] + [f"own {d}"])) for d in range(8)]
    assert run(spark, rows)[0] == brute(rows)


def test_empty(spark):
    assert run(spark, [])[0] == []


def test_whole_table(spark, sf):
    from framewright.llm.common import table

    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, L.op1_line_dedup(spark, sf).collect()), key=repr) == brute(rows)
