import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framewright.llm import packing as P

ODD = ["", "a  b", "  x\n\n y", "tab\t\tq ", " it's I'LL we're 12345 x1y2", "<|endoftext|>hi <|endoftext|>", "Ünïcode ñ 你好  　 z", "a" * 500 + " b" * 300, "\r\n\r\nx  y", "'s's 's\n", "🙂🙂 🙂", "e\u0301 \u200b\u2028x"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(exact, spark, sf, monkeypatch):
    texts = ODD + [(x + " ") * 3 for x in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for window in (1 << 20, 200):
        monkeypatch.setattr(P, "WINDOW", window)
        for x in texts:
            assert P.encode(x, P.tokenizer_path()) == exact(x), x


def test_pieces(spark, exact):
    rows = [(k, t, "n") for k, t in enumerate(ODD)] + [(100, None, "n"), (101, "word " * 3000, "n"), (101, "word " * 3000, "n"), (None, "q", "n"), (102, "x " * 1023, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = P.pack_documents(docs).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        if i == 101:
            continue
        want = [*(exact(t) if t else []), 2]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == want
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
        assert len(got) == -(-len(want) // 1024) and all(r.length == 1024 for r in got[1:])
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    crc = P.pack_documents(docs, with_ids=False).where("doc_id = 4").first()
    assert crc.ids_crc32 == zlib.crc32(np.array([*exact(ODD[4]), 2], "<u4").tobytes())
    assert P.pack_documents(docs.limit(0)).count() == 0


def plain_best_fit(pieces, capacity, max_open):
    """The rule without a bitset: (bin, place) of each piece in order."""
    free: dict[int, int] = {}
    out, made = [], 0
    for n in pieces:
        fits = [(f, b) for b, f in free.items() if f >= n]
        if fits:
            f = min(fits)[0]
            at = max(b for x, b in fits if x == f)
        else:
            if len(free) >= max_open:
                least = min(free.values())
                del free[max(b for b, f in free.items() if f == least)]
            at, made = made, made + 1
            free[at] = capacity
        out.append((at, capacity - free[at]))
        free[at] -= n
        if not free[at]:
            del free[at]
    return out


def test_bins_against_the_plain_rule():
    r = np.random.default_rng(3)
    for max_open in (2, 5, 40):
        sizes = r.integers(1, 65, 3000).tolist()
        bins, free = P.OpenBins(64, max_open), {}
        got = [bins.put(n) for n in sizes]
        want = plain_best_fit(sizes, 64, max_open)
        # Which of equally full bins is taken is open: the places and the number of bins are not.
        assert [p for _, p in got] == [p for _, p in want] and len({b for b, _ in got}) == len({b for b, _ in want})


def test_the_query(spark, exact):
    """Whole table: every piece of every document once, sequences without gaps, and hardly more of them than needed."""
    sf = "/root/testdata/sf0.01"
    rows = P.op5_best_fit_packing(spark, sf).collect()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*(exact(r.text) if r.text else []), 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update({(r.doc_id, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))})
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    total = sum(at.values())
    assert max(at.values()) <= 1024 and len(at) <= 1.01 * -(-total // 1024) + 1


def test_open_sequences_of_tasks_are_joined(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "'word word' AS text").repartition(16)
    out = P.pack_documents(docs, with_ids=False)
    assert out.select("sequence_id").distinct().count() == 1
    assert sorted(r.offset for r in out.collect()) == [3 * k for k in range(64)]


def test_bins_are_best_fit_and_bounded():
    b = P.OpenBins(10, 3)
    assert [b.put(n) for n in (7, 6, 3, 4, 5, 9)] == [(0, 0), (1, 0), (0, 7), (1, 6), (2, 0), (3, 0)]
    b = P.OpenBins(10, 2)
    b.put(6)
    b.put(7)
    b.put(8)  # closes the fullest: the one with 3 free
    assert b.count == 2 and b.put(3)[0] == 0
    r = np.random.default_rng(0)
    sizes = r.integers(1, 1025, 20000)
    b = P.OpenBins(1024, P.MAX_OPEN)
    for n in sizes:
        b.put(int(n))
    assert b.count <= P.MAX_OPEN and b.made * 1024 < 1.04 * sizes.sum()
