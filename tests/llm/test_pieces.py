import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from framewright.llm import sentence_pieces as S


def test_ids_are_those_of_the_library(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    t = S.compiled(S.model_path())
    r = random.Random(1)
    alphabet = "  aabcdeéü🙂ñ\n\tthe ing of 1234 ßh漢字、。<>{}()\"'"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(4000)]
    texts += [" " * k + x for k in range(1, 40) for x in ("", "the")] + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    for x in texts:
        ids = t.encode(x)
        assert ids == lib.encode(x), x
        assert t.decode(ids) == lib.decode(ids) == x


def test_one_state_of_finite_cost_at_a_place():
    t, r = S.compiled(S.model_path()), random.Random(5)
    for _ in range(3000):
        text = "".join(r.choices([S.BLANK, S.BLANK * 2, "the", "a", "aa", "..", "==", "-", "0", "er", "_"], k=r.randint(1, 20)))
        ends: dict = {0: [""]}
        for end, (piece, _, n, _) in t.arcs.iter(text):
            ends.setdefault(end + 1, []).extend(piece for was in ends.get(end + 1 - n, ()) if t._link(was, piece) == 0)
        assert all(len(x) <= 1 for x in ends.values()) and ends[len(text)]


def field(number: int, value: bytes | int) -> bytes:
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram(byte_pieces: bool) -> bytes:
    """A made-up model: pieces with scores, of which none is the best everywhere."""
    r = random.Random(8)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_pieces:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    names = {S.BLANK, *"abcd", *("".join(r.choices("abcd", k=r.randint(2, 4))) for _ in range(60)), *(S.BLANK + "".join(r.choices("abcd", k=r.randint(1, 3))) for _ in range(20))}
    pieces += [(n, -r.uniform(1, 12), 1) for n in sorted(names)]
    body = b"".join(field(1, field(1, n.encode()) + b"\x15" + struct.pack("<f", s) + field(3, k)) for n, s, k in pieces)
    trainer = field(3, 1) + (field(35, 1) if byte_pieces else b"")
    normaliser = field(1, b"nmt_nfkc") + dict(S._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())).get(3, b"")
    return body + field(2, trainer) + field(3, normaliser)


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_unigram_models_with_a_normaliser(byte_pieces):
    model = unigram(byte_pieces)
    lib, t, r = sentencepiece.SentencePieceProcessor(model_proto=model), S.Transducer(model), random.Random(2)
    assert not t.pairs and t.normal.units
    for _ in range(2000):
        text = "".join(r.choices("aabbccdd  ａﬁ½é\u3000", k=r.randint(0, 30)))
        assert t.encode(text) == lib.encode(text), text


def test_the_query(spark):
    """Its rows against the library, over the whole table."""
    sf = "/root/testdata/sf0.01"
    lib = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    want = {r.doc_id: lib.encode(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_ids, r.ids_crc32, r.round_trip) for r in S.op9_sentence_pieces(spark, sf).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, x in want.items()}


def test_operator(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "naïve  text\n🙂", 0), (3, "naïve  text\n🙂", 0), (None, "q " * 5000, 0)], "doc_id long, text string, ids int")
    back = sorted(((r.doc_id or 0), r.text) for r in S.decode_ids(S.encode_documents(docs)).collect())
    assert back == sorted(((r.doc_id or 0), r.text or "") for r in docs.collect())
    assert all(r.round_trip for r in S.encode_documents(docs, digest=True).collect())
    assert S.encode_documents(docs.limit(0)).count() == 0
