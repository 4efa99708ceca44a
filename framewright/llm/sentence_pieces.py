"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file: the normaliser; the pieces, a trie with failure arcs whose final states
put out a piece's id; and, for each character that is no piece, arcs that put out the ids of its UTF-8 bytes. Composed
with an input, that gives a lattice of arcs between the places of the input, of which the shortest path in the tropical
semiring is taken: costs are relaxed by (min, +) from left to right.

Arc weights of a unigram model are its pieces' negative scores. In a byte-pair model an arc's weight depends on the
state it leaves, which is the piece before: 0 if the model's own rule, given the two pieces' characters, gives these two
pieces again, infinite otherwise. A segmentation is the model's own exactly if no neighbouring pair has infinite weight,
so that a place has one state of finite cost at most. Pair weights are computed when first met and kept.

Inputs are composed unit by unit, a unit being a run of blanks and what follows up to the next blank: no piece holds
a blank after another character, which compiling checks. Equal units share one result. Time grows in proportion to a
unit's length, also for runs of blanks.

Defined results: null and empty texts have no ids and decode to the empty text; each row is encoded, repeated or not,
with its doc_id as given, null or not; texts are encoded whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frames
from .common import table

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Units and pairs that a worker keeps.
KEPT = 300_000
INFINITE = float("inf")


def _fields(data: bytes):
    """The fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


class Normaliser:
    """A transducer over characters, compiled from a model's normaliser: the longest rule of its character map that
    matches is taken, other characters stay; then blanks are added, dropped and shown as the model asks."""

    def __init__(self, spec: bytes = b""):
        fields = dict(_fields(spec))
        self.prefix, self.tidy, self.shown = (bool(fields.get(k, 1)) for k in (3, 4, 5))
        blob = fields.get(2, b"")
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def _rule(self, raw: bytes, at: int) -> tuple[int, int]:
        """Of the longest rule that matches at a place: its length, and the place of its output; length 0 for none."""
        units, node, best = self.units, self.units[0], (0, 0)
        node = (node >> 10) << ((node & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def mapped(self, text: str) -> str:
        if not self.units:
            return text
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            n, to = self._rule(raw, at)
            if n:
                out.append(self.texts[to : self.texts.index(b"\0", to)])
            else:
                n = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                out.append(raw[at : at + n])
            at += n
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.tidy:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", BLANK) if self.shown else text


class Transducer:
    """Compiled from a model: the normaliser, an arc for each piece, and byte arcs. Kinds of pieces: 1 normal,
    3 control, 4 user-defined, 5 unused, 6 byte; kinds of models: 1 unigram, 2 byte-pair."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[str] = []
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.unknown, self.pairs, self.normal = 0, False, Normaliser()
        out: list[bytes] = []
        for field, value in _fields(model):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: 1, **dict(_fields(value))}
                i, s, kind = len(self.text), piece[1].decode(), piece[3]
                self.text.append(s)
                out.append(s.replace(BLANK, " ").encode())
                if kind == 6:
                    self.byte_of[i] = int(s[3:5], 16)
                    self.bytes[self.byte_of[i]] = i
                    out[-1] = bytes([self.byte_of[i]])
                elif kind == 2:
                    self.unknown, out[-1] = i, " ⁇ ".encode()
                elif kind == 3:
                    out[-1] = b""
                elif kind != 5:
                    self.ids[s], self.score[s] = i, float(np.frombuffer(piece[2], "<f4")[0])
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and byte-pair models are compiled")
                self.pairs = kind == 2
            elif field == 3:
                self.normal = Normaliser(value)
        if any(BLANK in s.lstrip(BLANK) for s in self.ids):
            raise ValueError("a piece holds a blank after another character")
        self.out = out.__getitem__
        self.chars = {s for s in self.ids if len(s) == 1}
        #: The weight of a character that is no piece.
        self.odd = 10.0 - min(self.score.values(), default=0.0)
        self.arcs = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.arcs.add_word(s, (s, i, len(s), 0.0 if self.pairs else -self.score[s]))
        self.arcs.make_automaton()
        self.weights: dict[tuple[str, str], float] = {}
        self.units: dict[str, tuple[int, ...]] = {}

    def _alone(self, chars: str) -> list[str]:
        """A byte-pair model's own rule: the best-scored neighbours merge first, the leftmost among equals."""
        parts = list(chars)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _link(self, before: str, piece: str) -> float:
        """The weight of a piece's arc out of the state that the piece before leads to: 0 if the model's rule gives
        these two for the two together, else infinite."""
        key = before, piece
        w = self.weights.get(key)
        if w is None:
            if len(self.weights) >= KEPT:
                self.weights.clear()
            w = self.weights[key] = 0.0 if self._alone(before + piece) == ([before, piece] if before else [piece]) else INFINITE
        return w

    def _composed(self, unit: str) -> Iterator[tuple[int, tuple]]:
        """The arcs of the transducer composed with a unit, by the place where they end."""
        if self.chars.issuperset(unit):
            return self.arcs.iter(unit)
        odd = [(i, (c, None, 1, self.odd)) for i, c in enumerate(unit) if c not in self.chars]
        return iter(sorted([*self.arcs.iter(unit), *odd], key=itemgetter(0)))

    def _unit(self, unit: str) -> tuple[int, ...]:
        """The output of the shortest path: relaxed in (min, +) over the arcs, from left to right."""
        n, pairs, weights = len(unit), self.pairs, self.weights
        cost, back, state = [0.0] + [INFINITE] * n, [None] * (n + 1), [""] * (n + 1)
        for end, arc in self._composed(unit):
            piece, ident, size, weight = arc
            end += 1
            total = cost[end - size] + weight
            if total >= cost[end]:
                continue
            if ident is None:
                piece = ""
            elif pairs:
                before = state[end - size]
                weight = weights.get((before, piece))
                total += self._link(before, piece) if weight is None else weight
                if total >= cost[end]:
                    continue
            cost[end], back[end], state[end] = total, arc, piece
        out: list[tuple] = []
        while n:
            arc = back[n]
            if arc is None:
                raise AssertionError(f"no path through {unit[:40]!r}")
            out.append(arc)
            n -= arc[2]
        ids: list[int] = []
        for piece, ident, _, _ in reversed(out):
            if ident is not None:
                ids.append(ident)
            elif self.byte_of:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        units = self.units
        for u in UNIT.findall(self.normal(text)):
            ids = units.get(u)
            if ids is None:
                if len(units) >= KEPT:
                    units.clear()
                ids = self._unit(u)
                if len(u) <= 64:
                    units[u] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.out, ids)).decode("utf-8", "replace")
        return text[1:] if self.normal.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, ids; or with digest: doc_id, n_ids, ids_crc32 (of unsigned 32-bit little-endian ids), round_trip."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(path or model_path())
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            ids = [t.encode(x) for x in texts]
            if digest:
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_ids": [len(x) for x in ids], "ids_crc32": [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], "round_trip": [t.decode(i) == x for i, x in zip(ids, texts, strict=True)]})
            else:
                yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids})

    return frames(docs.select("doc_id", "text"), run, f"doc_id {id_type}, " + ("n_ids bigint, ids_crc32 bigint, round_trip boolean" if digest else "ids array<int>"))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(path or model_path())
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t.decode(x) if x is not None else "" for x in b["ids"]]})

    return frames(rows.select("doc_id", "ids"), run, f"doc_id {id_type}, text string")


def op9_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)
