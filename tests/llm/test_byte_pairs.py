import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framewright.llm import byte_pairs as B

SCHEMA = "doc_id long, text string, ids string, words int"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.vocabulary_path()), special_tokens={})


def _encoded(spark, texts, **how):
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    ranks = B.rank_map(spark)
    out = B.decoded(B.encoded(rows, ranks, **how), ranks, lambda ids, text: F.struct(ids.alias("ids"), text.alias("back")), "d")
    got = out.select("row.doc_id", "d.ids", "d.back").collect()
    return {r.doc_id: (list(r.ids), bytes(r.back)) for r in got}


def _odd_texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n\n  a", "don't they'LL", "<|endoftext|> x", "a b  c\x85", "日本語のテキスト、そして中国語文本", "haha hahaha ababababa nananana aaaaaaa", " xy ", "ſt ǅ ࡰࡱ x\U00031350 \U0001e4f0\U0001e4f1"]
    points = [c for c in range(1, 0x33000) if not 0xD800 <= c < 0xE000]
    odd += ["".join(map(chr, rng.choices(points, k=60))) for _ in range(40)]
    odd += ["".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(60)]
    odd += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 14))) for _ in range(30)) for _ in range(30)]
    return odd


@pytest.mark.parametrize("known", [0, 8, 1 << 17])
def test_ids_are_those_of_the_library(spark, library, known):
    texts = _odd_texts()
    for k, (ids, back) in _encoded(spark, texts, known=known).items():
        assert ids == library.encode_ordinary(texts[k] or ""), texts[k]
        assert back == (texts[k] or "").encode()


def test_long_words_go_by_windows(spark, library):
    rng = random.Random(6)
    vocabulary = [p.decode() for p in B.read_ranks(B.vocabulary_path()) if p.isalpha() and p.isascii()]
    texts = ["a" * 3000, "ab" * 900, "-=" * 700, "文" * 500, " " * 900 + "x", "".join(rng.choices("abcdefghij", k=2500)), "".join(rng.choices(vocabulary, k=400))]
    texts += ["".join(rng.choices(alphabet, k=400)) for alphabet in ("ab", "aab", "hna", "tion", "0123456789") for _ in range(6)]
    for window in (40, 512):
        for k, (ids, back) in _encoded(spark, texts, known=0, window=window).items():
            assert ids == library.encode_ordinary(texts[k]), (window, texts[k][:80])
            assert back == texts[k].encode()


def test_windows_that_do_not_meet_fold_the_word(spark, library):
    """A window of 3 bytes is too short for any agreement; the fold of the whole word takes over."""
    texts = ["internationalization", "Donaudampfschiff", "ababababab"]
    for k, (ids, _) in _encoded(spark, texts, known=0, window=3).items():
        assert ids == library.encode_ordinary(texts[k])


def test_very_long_texts(spark, library):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(60_000)), "a" * 60_000, "\n".join(["same line again"] * 30_000)]
    for k, (ids, back) in _encoded(spark, texts, known=128).items():
        assert ids == library.encode_ordinary(texts[k]) and back == texts[k].encode()


def test_decoding_of_any_ids(spark):
    pieces = {r: p for p, r in B.read_ranks(B.vocabulary_path()).items()}
    rows = spark.createDataFrame([([255, 0, 40_000, 128],), (None,), ([],), ([50_256, -1, 7],)], "ids array<int>")
    got = [bytes(r[0]) for r in B.decoded(rows, B.rank_map(spark), lambda ids, text: text, "text").collect()]
    assert got == [pieces[255] + pieces[0] + pieces[40_000] + pieces[128], b"", b"", pieces[7]]


def test_other_columns_pass_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b", "mine", 3), (None, "a b", "mine", 3)], SCHEMA)
    out = B.encoded(rows).collect()
    assert [r.row.asDict() for r in out] == [{"doc_id": None, "text": "a b", "ids": "mine", "words": 3}] * 2
    assert B.encoded(rows.limit(0)).collect() == []


def test_query_on_the_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in B.op13_byte_pair_encoding(spark, sf).collect():
        text = texts.pop(r.doc_id)
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    assert not texts


def test_plan_is_one_scan(spark, sf):
    """Projections over a scan, none of which carries the rank map or the table of words as a column, and a short text."""
    df = B.op13_byte_pair_encoding(spark, sf)
    node, names, columns = df._jdf.queryExecution().sparkPlan(), [], []
    while True:
        names.append(node.nodeName())
        columns += [node.output().apply(i).name() for i in range(node.output().size())]
        if not node.children().size():
            break
        node = node.children().head()
    assert set(names[:-1]) == {"Project"} and names[-1].startswith("Scan parquet"), names
    assert not {"m", "k"} & set(columns)
    assert len(df._jdf.queryExecution().toString()) < 1_000_000


def test_table_of_known_words(spark, library):
    """A place for the most frequent words of each hash, none for a word found once, and places enough for far more words than before."""
    texts = [" ".join(f"w{k}x" for k in range(40) for _ in range(1 + k % 5))]
    words = spark.createDataFrame([(t,) for t in texts], "text string").select(B.words_of(F.col("text")).alias("words"))
    counts = {r.word: r.n for r in words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = B.known_words(words, B.rank_map(spark), 8).select("m.known", "m.known_ids", F.transform(F.array(*map(F.lit, counts)), lambda w: B._first_place(w, 8)).alias("first")).first()
    by_set = {}
    for word, first in zip(counts, held.first):
        by_set.setdefault(first, []).append(word)
    assert len(held.known) == len(held.known_ids) == 8
    for first in range(0, 8, B.WAYS):
        best = sorted((-counts[w], w) for w in by_set.get(first, ()) if counts[w] > 1)[: B.WAYS]
        assert [w for w in held.known[first : first + B.WAYS] if w] == [w for _, w in best]
    for word, ids in zip(held.known, held.known_ids):
        assert word is None or ids == ",".join(map(str, library.encode_ordinary(word)))
    assert B.KNOWN >= 1 << 19


def test_early_merges_are_the_first_of_the_fold(library):
    """All merges of the vocabulary, replaced one after the other, give the ids of the library."""
    ranks = B.read_ranks(B.vocabulary_path())
    every, rng = B.early_merges(ranks, len(ranks)), random.Random(8)
    assert B.early_merges(ranks) == every[: B.EARLY] and len(every) > 49_000
    words = [" thatreorhation", " Ciónostado", "ere", " but", "aaaaaaa", " verschäberein", "ababababab"] + ["".join(rng.choices("etaoinshr", k=rng.randint(2, 14))) for _ in range(60)]
    for word in words:
        s = word.encode().decode("latin-1")
        for pair, piece in every:
            s = s.replace(pair, piece)
        assert [ord(c) - 256 if ord(c) > 255 else ranks[bytes([ord(c)])] for c in s] == library.encode_ordinary(word), word


def test_early_merges_end_before_a_piece_that_comes_late():
    """In abc the pair bc has a higher rank than abc itself: replacing by rank would miss that it comes at once."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"cd": 4, b"abc": 5, b"bc": 6}
    assert B.early_merges(ranks) == [("cd", chr(256 + 4))]


def test_rare_words_stand_in_their_places(spark, library):
    """Rare and frequent words in turn, long ones, the mark itself, and texts without rare words."""
    frequent = " ".join(f"the w{k}" for k in range(4)) + " "
    texts = [frequent * 5, f"{frequent}qzxthering {frequent}", "qzx1 erinon  the ", "the", "", "ererere" * 90 + " the inonther " + frequent, ""]
    for known in (0, 8):
        for k, (ids, back) in _encoded(spark, texts, known=known).items():
            assert ids == library.encode_ordinary(texts[k]) and back == texts[k].encode()


def test_ids_are_joined_once_and_absent_merges_are_passed_over(spark, sf, library):
    """The text of the ids comes with them, so that the digest needn't make it again; a merge is asked for before it is replaced."""
    texts = [None, "", "the", "qzx1 erinon  the ererere", "\ue000 the"]
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    for r in B.encoded(rows).collect():
        ids = library.encode_ordinary(r.row.text or "")
        assert list(r.ids) == ids and r.told == ",".join(map(str, ids))
    plan = B.op13_byte_pair_encoding(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    replaced = plan.count("replace(")
    assert replaced and replaced == plan.lower().count("case when contains(")
