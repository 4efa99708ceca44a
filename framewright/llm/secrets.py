"""Secret scans: base patterns, and a linear-chain conditional random field over all tokens of a text.

A token is a stretch without white space; its pieces are its alphanumeric stretches and single other characters. Each
piece is tagged secret-begin, inside or outside from its shape, its neighbours, the cue words before it and features of
the whole text. No secret goes over white space, so each token is a chain of its own, decoded by Viterbi. No length,
digit or alphabet is asked for: the field alone decides.

Most tokens are words without a cue before them. Those that stay outside under the most favourable features of a text
are told apart for many texts at once, in arrays (``PlainTokens``), and only the others are decoded in their place. The sums
of the arrays may differ from those of ``Field.decode`` in the last digits, so what they leave within ``CLOSE`` of each other goes by
``Field.plain``, as do tokens with a cue or a character outside ``SIGNS`` and Latin-1: the result is the same.

The field is trained here, on the driver, by maximum likelihood on made-up texts (``training_runs`` and
``training_tokens``), which hold the common forms of keys and passwords and the usual look-alikes: words, identifiers,
markup, addresses, hosts, dates, versions, numbers, names and paths.

Defined results: null and empty texts have no spans; texts are scanned whole; each row is scanned, repeated or not,
with its doc_id as given, null or not; an empty table gives an empty result; other columns, whatever their names, pass through
``redacted``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, frames
from .common import table

KINDS = ("assign", "access", "hex", "field")
_either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that count as features of what follows within 40 characters.
CUES = frozenset(
    (*KEYWORDS, "key", "pwd", "pass", "passphrase", "passcode", "pin", "psk", "bearer", "basic", "auth", "authorization", "credential", "credentials", "private", "access", "login")
    + ("passwort", "kennwort", "passe", "clave", "secrets", "tokens", "passwords", "is", "ist", "est", "es", "of", "the", ":", "=")
)
#: Without one of these in reach a token has no cue; "is" and the like count beside them only.
PARTS = (":", "=", "pass", "secret", "token", "key", "pwd", "kennwort", "pin", "psk", "bearer", "basic", "auth", "credential", "private", "access", "login", "clave")
CUE = re.compile("[:=]|pass|secret|token|api_?key|key|pwd|kennwort|pin|psk|bearer|basic|auth|credential|private|access|login|clave", re.IGNORECASE | re.ASCII)
_SAYS = re.compile("|".join(sorted(k for k in CUES if len(k) > 3 or k in ("key", "pwd"))))
_SAYS_BYTES = re.compile(_SAYS.pattern.encode())
TOKEN = re.compile(r"\S+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PIECE = re.compile(r"[^\W_]+|[\W_]")
HARD = re.compile("[b-df-hj-np-tv-xzß]+", re.IGNORECASE)
REACH, LONG = 40, 80
#: Tokens and characters that are looked at together, and the least distance of two sums that are told apart.
TOKENS_AT_ONCE, TEXT_AT_ONCE, CLOSE = 1 << 15, 1 << 20, 1e-6
#: Signs beyond Latin-1 that have a code of one byte in PlainTokens, from 128.
SIGNS = "‘’‚“”„–—…€•‹›†‡™"
#: What a worker remembers, whatever the size of the corpus: plain tokens, entries of each generation of the memo, kinds of pieces, and
#: pieces of each other cache.
PLAIN, MEMO, KINDS_HELD, PIECES = 1 << 18, 1 << 17, 1 << 17, 1 << 15
DIGIT = re.compile("[0-9]")
BEFORE = re.compile(r"[A-Za-z_]+|[^\sA-Za-z_]")
WEIGHTS = 1 << 15
OUT, BEGIN, INSIDE = range(3)
#: Inside follows begin or inside only.
MOVES = np.array([[0.0, 0.0, -np.inf], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
FIRST = np.array([0.0, 0.0, -np.inf])
#: Pieces of one chain; a longer run is decoded in full, this only pads the training batch.
PAD = 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for run in RUN.finditer(text) if DIGIT.search(text) or _LONG_HEX.search(text) else ():
        if run.end() - run.start() >= 16:
            out += [(run.start() + m.start(), 2, run.start() + m.end()) for m in HEX.finditer(run[0]) if m.end() - m.start() >= 16]
    return sorted(out)


_LONG_HEX = re.compile("[a-f]{16}")


@lru_cache(maxsize=PIECES)
def _shape(piece: str) -> str:
    return _AGAIN.sub(r"\1", piece.translate(_CLASS))[:10]


_AGAIN = re.compile(r"(.)\1+")
_CLASS = {ord(c): k for of, k in ((string.ascii_lowercase, "a"), (string.ascii_uppercase, "A"), (string.digits, "9")) for c in of}


@lru_cache(maxsize=1 << 16)
def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WEIGHTS


def _bucket(n: int) -> int:
    return n.bit_length() if n < 8 else 4 + n // 8 if n < 64 else 12


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    """How common pairs of letters are in words, as logarithms; 26 stands for all but a to z."""
    n, r = np.full((27, 27), 3.0), random.Random(5)
    for k in range(6000):
        w = WORDS[k % len(WORDS)] if k % 2 else "".join(r.choices(SYLLABLES, k=3))
        x = _letters(w)
        np.add.at(n, (x[:-1], x[1:]), 1)
    return np.log(n / n.sum(axis=1, keepdims=True))


def _letters(p: str) -> np.ndarray:
    return np.array([ord(c) - 97 if "a" <= c <= "z" else 26 for c in p.lower()], int)


@lru_cache(maxsize=PIECES)
def _odd(p: str) -> int:
    """How unlike a word a stretch of letters is, from 0; -1 for those of fewer than four characters."""
    if len(p) < 4:
        return -1
    x, of = [_LETTER.get(c, 26) for c in p.lower()], _pair_rows()
    return int(-3 * sum(of[a][b] for a, b in zip(x, x[1:])) / (len(x) - 1))


_LETTER = {c: i for i, c in enumerate(string.ascii_lowercase)}


@lru_cache(maxsize=1)
def _pair_rows() -> list[list[float]]:
    return _pairs().tolist()


@lru_cache(maxsize=PIECES)
def _kinds(p: str) -> str:
    return f"{any(map(str.isdigit, p))}{any(map(str.islower, p))}{any(map(str.isupper, p))},{_bucket(len(p))},{_odd(p)}"


@lru_cache(maxsize=256)
def _stats(p: str) -> tuple:
    """All that the features of a piece are made from."""
    n = len(p)
    if p.isalpha() and p.islower():  # most pieces
        digits, lower, upper = 0, n, 0
    else:
        digits, lower, upper = (sum(map(f, p)) for f in (str.isdigit, str.islower, str.isupper))
    changes = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(p, p[1:])) if digits or upper else 0
    turns = changes - (n > 1 and p[0].isupper() and p[1].islower())
    hard = max(map(len, HARD.findall(p)), default=0)
    low = p.lower()
    return (
        _bucket(n), _shape(p), f"{digits > 0}{lower > 0}{upper > 0}", 10 * digits // n, 10 * changes // n, n >= 8 and not p.strip("0123456789abcdef"), 10 * len(set(p)) // n, 10 * sum(map(low.count, "aeiou")) // n,
        p[:4] if n <= 6 else "", min(turns, 9), min(hard, 12), _odd(p), low if low in CUES else "", p if n == 1 and not p.isalnum() else "",
    )


@lru_cache(maxsize=PIECES)
def _piece(p: str) -> tuple[int, ...]:
    """The features of a piece by itself."""
    size, shape, kinds, digits, changes, hexed, distinct, vowels, head, turns, hard, odd, cue, sign = _stats(p)
    return tuple(
        _hashed(f)
        for f in (
            "bias", f"len:{size}", f"shape:{shape}", f"kinds:{kinds}", f"digits:{digits}", f"changes:{changes}", f"hex:{hexed}", f"distinct:{distinct}", f"vowels:{vowels}", f"len,kinds:{size},{kinds}", f"head:{head}",
            f"turns:{turns}", f"hard:{hard}", f"len,hard:{size},{hard}", f"len,turns:{size},{turns}", f"cue:{cue}", f"sign:{sign}", f"odd:{odd}", f"len,odd:{size},{odd}",
        )
    )


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


@lru_cache(maxsize=KINDS_HELD)
def _kind(p: str) -> bytes:
    """A digest for all pieces that the field cannot tell apart; empty for those that hold a cue."""
    return b"" if _says(p) else _digest(repr((p if len(p) == 1 else "", _stats(p))).encode())


def _whole(token: str, pieces: list[str]) -> tuple[int, ...]:
    return _hashed(f"run:{_bucket(len(token))}"), _hashed(f"pieces:{min(len(pieces), 8)}")


def _beside(shapes: list[str], pieces: list[str], i: int) -> tuple[int, ...]:
    """The features of piece i from those beside it. shapes has one more at either end."""
    p = pieces[i]
    f = [f"prev:{shapes[i]}", f"next:{shapes[i + 2]}", f"prev,shape:{shapes[i]},{shapes[i + 1]}"]
    if len(p) == 1 and not p.isalnum():
        f += [f"sign,before:{p},{_bucket(len(pieces[i - 1])) if i else '^'}", f"sign,next:{p},{shapes[i + 2]}", f"sign,place:{p},{i == 0},{i + 1 == len(pieces)}", f"sign,first:{p},{pieces[0] if len(pieces[0]) == 1 else ''}"]
    return tuple(map(_hashed, f))


def _says(token: str) -> bool:
    return _SAYS.search(token.lower()) is not None


def _token(token: str, pieces: list[str]) -> list[tuple[int, ...]]:
    """The features of each piece from the token alone."""
    shapes = ["^", *map(_shape, pieces), "$"]
    whole, said = _whole(token, pieces), _says(token)
    out, cue = [], ""
    for i, p in enumerate(pieces):
        f = []
        if said:
            f = [f"after:{cue}", f"after,prev:{cue != ''},{shapes[i]}", f"after,kinds:{cue not in ('', 'used')},{_kinds(p)}", f"after,sign:{cue not in ('', 'used')},{p if len(p) == 1 else ''}"]
        out.append(_piece(p) + whole + _beside(shapes, pieces, i) + tuple(map(_hashed, f)))
        cue = next((k for k in KEYWORDS + ("key", "pwd", "pass") if p.lower().endswith(k)), cue if p in "_:=\"'@[](){}-" else "used" if cue else "")
    return out


def _context(text: str, start: int) -> tuple[str, ...]:
    """The words before a token that count, the nearest first, then how the last cue is linked: none without one in reach."""
    before = text[max(0, start - REACH) : start]
    if not CUE.search(before):
        return ()
    low = [w.lower() for w in reversed(BEFORE.findall(before)[-4:])]
    cues = [k for k in KEYWORDS + ("key", "pwd", "pass", "bearer", "login") if any(k in w for w in low)]
    at = next((k for k, w in enumerate(low) if any(c in w for c in cues)), -1)
    link = f"{at},{low[0] if at > 0 and low[0] in CUES else ''}" if at >= 0 else ""
    return (*(f"w{k}:{w}" for k, w in enumerate(low) if w in CUES), *(f"has:{k}" for k in cues), f"link:{link}")


def chain(text: str, start: int, end: int, file: tuple[str, ...]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The pieces of a token as spans, and the features of each."""
    token = text[start:end]
    spans = [(start + m.start(), start + m.end()) for m in PIECE.finditer(token)]
    pieces, said = [text[a:b] for a, b in spans], _context(text, start)
    rest = [_hashed(f) for f in (*said, *file)]
    linked = [[_hashed(f"{said[-1]},{x}") for x in (_kinds(p), _shape(p), f"{i},{len(p) > 1}")] if said else [] for i, p in enumerate(pieces)]
    return spans, [[*f, *rest, *x] for f, x in zip(_token(token, pieces), linked, strict=True)]


def file_features(text: str) -> tuple[str, ...]:
    low = text.lower()
    return (f"keys:{sum(k in low for k in KEYWORDS)}", f"lines:{_bucket(text.count(chr(10)))}")


#: For each field, by its key: plain tokens, the first that were seen.
_plain: dict[int, set[str]] = {}
#: The same: whether tokens are plain, by a digest of the kinds of their pieces, in a younger and an older generation. It
#: outlives a task of a worker.
_memo: dict[int, list[dict[bytes, bool]]] = {}


class Field:
    """w: emission weights by feature and tag. t: transition weights."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t + MOVES
        self.rows, self.moves = [tuple(r) for r in w.tolist()], self.t.tolist()
        self.key = zlib.crc32(w.tobytes() + t.tobytes())
        self.arrays: PlainTokens | None = None
        files = [w[[_hashed(f"keys:{k}"), _hashed(f"lines:{n}")]].sum(axis=0) for k in range(len(KEYWORDS) + 1) for n in range(13)]
        #: The most that features of the whole text can add to begin and inside over outside.
        self.most = [0.0, *np.max([f[1:] - f[0] for f in files], axis=0).tolist()]

    def __reduce__(self):
        return Field, (self.w, self.t)

    def decode(self, features: list[list[int]], more: tuple | list = (0.0, 0.0, 0.0)) -> list[int]:
        best, back = None, []
        for f in features:
            o, b, i = more
            for x in f:
                u, v, w = self.rows[x]
                o, b, i = o + u, b + v, i + w
            if best is None:
                best = [o, b, -np.inf]
                continue
            step, last = [], []
            for y, e in enumerate((o, b, i)):
                paths = [best[x] + self.moves[x][y] for x in range(3)]
                top = max(paths)
                step.append(top + e)
                last.append(paths.index(top))
            back.append(last)
            best = step
        tags = [best.index(max(best))]
        for b in reversed(back):
            tags.append(b[tags[-1]])
        return tags[::-1]

    def plain(self, token: str) -> bool:
        """Whether a token without a cue before it is outside in any text."""
        pieces = PIECE.findall(token)
        kinds = list(map(_kind, pieces))
        if b"" in kinds:
            return not any(self.decode(_token(token, pieces), self.most))
        held = _memo.setdefault(self.key, [{}, {}])
        key = (kinds[0] if len(kinds) == 1 else _digest(b"".join(kinds))) + bytes([_bucket(len(token))])
        known = held[0].get(key)
        if known is None:
            known = held[1].get(key)
            if known is None:
                known = not any(self.decode(_token(token, pieces), self.most))
            if len(held[0]) >= MEMO:
                held[:] = {}, held[0]
            held[0][key] = known
        return known


    def plain_tokens(self, tokens: list[str]) -> list[bool]:
        """As plain, for many tokens at once."""
        if self.arrays is None:
            self.arrays = PlainTokens(self)
        out = []
        for k in range(0, len(tokens), TOKENS_AT_ONCE):
            part = tokens[k : k + TOKENS_AT_ONCE]
            over = self.arrays.over(part)
            told = (over > 0).tolist()
            for i in np.flatnonzero(~(np.abs(over) > CLOSE)).tolist():
                told[i] = self.plain(part[i])
            out += told
        return out


class PlainTokens:
    """By how much the path that stays outside beats all others, for many tokens. The characters of all tokens lie in one array of
    codes, those of a piece beside each other, so that what _stats counts is a sum or a maximum over a stretch."""

    def __init__(self, field: Field):
        self.w, self.moves, self.most = field.w, field.moves, np.array(field.most)
        codes = {chr(c): c for c in (*range(33, 127), *range(0xA1, 256)) if not (chr(c).isalnum() and c in range(0xA1, 0xC0))} | {c: 128 + k for k, c in enumerate(SIGNS)}
        self.code = np.zeros(0x110000, np.uint8)  # 0: none; a line feed ends a token
        self.char = ["\n"] * 256
        for c, k in codes.items():
            self.code[ord(c)], self.char[k] = k, c
        self.code[10] = 10
        of = lambda say: np.array([c != "\n" and say(c) for c in self.char])
        self.alnum, self.digit, self.upper = of(str.isalnum), of(str.isdigit), of(str.isupper)
        self.hard = of(lambda c: HARD.fullmatch(c) is not None)
        #: Counts of digits, small letters, capitals, vowels and signs of hexadecimal numbers, 10 bits each: a piece has LONG characters at most.
        says = (self.digit, of(str.islower), self.upper, of(lambda c: c.lower() in "aeiou"), of(lambda c: c in "0123456789abcdef"))
        self.counts = sum(x.astype(np.int64) << (10 * k) for k, x in enumerate(says))
        self.lower = np.array([codes.get(c.lower(), 0) for c in self.char], np.uint32)
        self.letter = np.array([_LETTER.get(c.lower(), 26) for c in self.char])
        self.shape = np.array([codes.get(c.translate(_CLASS), 0) for c in self.char], np.uint64)
        bits = np.array([1 << k for k in range(64)], np.uint64)
        self.low_bits, self.high_bits = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
        for k, c in enumerate(string.digits + string.ascii_letters):
            self.low_bits[codes[c]] = bits[k]
        self.high_bits[0xC0:] = bits
        self.pairs = _pairs()
        self.size = np.array([_bucket(n) for n in range(LONG + 1)])
        sizes, bools, tens = range(13), (False, True), range(11)
        self.odd = int(-3 * self.pairs.min()) + 2
        kinds = [f"{a}{b}{c}" for a in bools for b in bools for c in bools]
        each = self._each
        self.by = {
            "len": each(f"len:{k}" for k in sizes), "kinds": each(f"kinds:{k}" for k in kinds), "digits": each(f"digits:{k}" for k in tens), "changes": each(f"changes:{k}" for k in tens),
            "hex": each(f"hex:{k}" for k in bools), "distinct": each(f"distinct:{k}" for k in tens), "vowels": each(f"vowels:{k}" for k in tens), "len,kinds": each(f"len,kinds:{n},{k}" for n in sizes for k in kinds),
            "turns": each(f"turns:{k}" for k in tens), "hard": each(f"hard:{k}" for k in sizes), "len,hard": each(f"len,hard:{n},{k}" for n in sizes for k in sizes), "len,turns": each(f"len,turns:{n},{k}" for n in sizes for k in tens),
            "odd": each(f"odd:{k}" for k in range(-1, self.odd)), "len,odd": each(f"len,odd:{n},{k}" for n in sizes for k in range(-1, self.odd)), "run": each(f"run:{k}" for k in sizes), "pieces": each(f"pieces:{k}" for k in range(9)),
        }
        self.always = each(("bias", "sign:"))  # of all pieces of letters and digits
        self.no_cue, self.no_head = each(("cue:", "head:"))
        self.cues = {sum(ord(c) << (8 * k) for k, c in enumerate(w)): each((f"cue:{w}",))[0] for w in CUES if w.isalnum() and not _says(w)}  # of three letters at most
        self.signs = np.array([self.w[list(_piece(c))].sum(axis=0) if c != "\n" and not c.isalnum() else (0, 0, 0) for c in self.char])

    def _each(self, features) -> np.ndarray:
        return self.w[[_hashed(f) for f in features]]

    def _told(self, keys: np.ndarray, name) -> np.ndarray:
        """The weights of the features that name makes from keys, each made once."""
        each, at = np.unique(keys, return_inverse=True)
        return self._each(map(name, each.tolist()))[at]

    def _word(self, key: int) -> str:
        return "".join(self.char[b] for b in key.to_bytes(8, "little") if b)

    def over(self, tokens: list[str]) -> np.ndarray:
        """nan for tokens that are not told."""
        code = self.code[np.frombuffer(("\n".join(tokens) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = code == 10
        token = np.cumsum(ends) - ends
        untold = np.zeros(len(tokens), bool)
        untold[token[code == 0]] = True
        untold[token[[m.start() for m in _SAYS_BYTES.finditer(code.tobytes().lower())]]] = True

        # Pieces: stretches of alnum, and single signs. A stretch ends where the next one or the end of the token stands.
        alnum = self.alnum[code]
        begins = ~ends & ~(alnum & np.r_[False, alnum[:-1]])
        cuts = np.flatnonzero(begins | ends)
        is_piece = begins[cuts]
        over = lambda how, x: how.reduceat(x, cuts)[is_piece]
        at = cuts[is_piece]
        n = np.diff(np.r_[cuts, len(code)])[is_piece]
        of, is_word = token[at], alnum[at]
        first = np.searchsorted(of, np.arange(len(tokens)))
        many = np.diff(np.r_[first, len(of)])
        place = np.arange(len(of)) - first[of]
        last = place + 1 == many[of]
        size = self.size[n]

        # Shapes: a character counts where its class is another than the one before.
        shape = self.shape[code]
        turn = begins | (shape != np.r_[shape[:1], shape[:-1]])
        turn_no = np.cumsum(turn)
        turn_no -= np.repeat(turn_no[cuts], np.diff(np.r_[cuts, len(code)]))
        untold[token[turn & (turn_no > 7) & ~ends]] = True
        shapes = over(np.add, np.where(turn & (turn_no < 8), shape << (8 * np.clip(turn_no, 0, 7)).astype(np.uint64), np.uint64(0)))
        names, own = np.unique(shapes, return_inverse=True)
        names = [*map(self._word, names.tolist()), "^", "$"]
        prev = np.where(place == 0, len(names) - 2, np.r_[own[:1], own[:-1]])
        after = np.where(last, len(names) - 1, np.r_[own[1:], own[-1:]])
        e = self._each(f"prev:{x}" for x in names)[prev] + self._each(f"next:{x}" for x in names)[after]
        e += self._told(prev * len(names) + own, lambda k: f"prev,shape:{names[k // len(names)]},{names[k % len(names)]}")
        e += self.by["run"][self.size[np.bincount(token)[of] - 1]] + self.by["pieces"][np.minimum(many, 8)[of]] + self.most

        sign = np.flatnonzero(~is_word)
        c = code[at[sign]].astype(np.int64)
        before = np.where(place[sign] == 0, 13, size[np.maximum(sign - 1, 0)])
        start = np.where(n[first[of[sign]]] == 1, code[at[first[of[sign]]]], 0)
        e[sign] += self.signs[c]
        e[sign] += self._told(c * 16 + before, lambda k: f"sign,before:{self.char[k >> 4]},{k & 15 if k & 15 != 13 else '^'}")
        e[sign] += self._told(c * len(names) + after[sign], lambda k: f"sign,next:{self.char[k // len(names)]},{names[k % len(names)]}")
        e[sign] += self._told(c * 4 + 2 * (place[sign] == 0) + last[sign], lambda k: f"sign,place:{self.char[k >> 2]},{k & 2 > 0},{k & 1 > 0}")
        e[sign] += self._told(c * 256 + start, lambda k: f"sign,first:{self.char[k >> 8]},{self.char[k & 255] if k & 255 else ''}")

        # Words and numbers, as in _stats.
        is_digit, is_upper = self.digit[code], self.upper[code]
        changed = np.r_[False, (is_digit[1:] != is_digit[:-1]) | (is_upper[1:] != is_upper[:-1])] & ~begins
        letter = self.letter[code]
        pair = np.where(begins, 0.0, self.pairs[np.r_[26, letter[:-1]], letter])
        soft = np.where(self.hard[code], 0, np.arange(1, len(code) + 1))
        run = np.arange(1, len(code) + 1) - np.maximum.accumulate(soft)
        word = np.flatnonzero(is_word)
        over = lambda how, x: how.reduceat(x, cuts)[is_piece][word]
        at, n, size, of = at[word], n[word], size[word], of[word]
        counts = over(np.add, self.counts[code])
        digits, lower, upper, vowels, hexes = (counts >> (10 * k) & 1023 for k in range(5))
        changes, hard = over(np.add, changed.astype(np.int64)), np.minimum(over(np.maximum, run), 12)
        turns = np.minimum(changes - ((n > 1) & is_upper[at] & (self.counts[code[at + 1]] >> 10 & 1 > 0)), 9)
        distinct = (np.bitwise_count(over(np.bitwise_or, x[code])).astype(np.int64) for x in (self.low_bits, self.high_bits))
        worth = -3 * over(np.add, pair) / np.maximum(n - 1, 1)
        untold[of[(n > 3) & (np.abs(worth - np.round(worth)) < CLOSE)]] = True
        odd = np.where(n < 4, 0, worth.astype(np.int64) + 1)
        kinds = 4 * (digits > 0) + 2 * (lower > 0) + (upper > 0)
        by = self.by
        x = self.always.sum(axis=0) + self._told(shapes[word], lambda k: f"shape:{self._word(k)}")
        x += by["len"][size] + by["kinds"][kinds] + by["digits"][10 * digits // n] + by["changes"][10 * changes // n] + by["hex"][((n >= 8) & (hexes == n)).astype(int)]
        x += by["distinct"][10 * sum(distinct) // n] + by["vowels"][10 * vowels // n] + by["len,kinds"][8 * size + kinds] + by["turns"][turns] + by["hard"][hard]
        x += by["len,hard"][13 * size + hard] + by["len,turns"][11 * size + turns] + by["odd"][odd] + by["len,odd"][(self.odd + 1) * size + odd]
        head, low = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
        for k in range(4):
            c = np.where(k < n, code[np.minimum(at + k, len(code) - 1)], 0)
            head |= c.astype(np.uint32) << np.uint32(8 * k)
            low |= self.lower[c] << np.uint32(8 * k)
        short = n <= 6
        x += np.where(short[:, None], 0, self.no_head) + self.no_cue
        x[short] += self._told(head[short], lambda k: f"head:{self._word(k)}")
        for key, worth in self.cues.items():
            x[(low == key) & (n <= 3)] += worth - self.no_cue
        e[word] += x
        found = self._best(e, first, many)
        found[untold] = np.nan
        return found

    def _best(self, e: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The path outside less the best of the others, by Viterbi over the pieces of all tokens."""
        order = np.argsort(-many, kind="stable")
        t = self.moves
        out, b = e[first[order], 0], e[first[order], 1]
        o, i = np.full(len(order), -np.inf), np.full(len(order), -np.inf)
        for j in range(1, int(many.max())):
            m = int((many > j).sum())
            f = e[first[order[:m]] + j]
            x, y, z = o[:m], b[:m], i[:m]
            begin = np.maximum(np.maximum(np.maximum(out[:m], x) + t[0][1], y + t[1][1]), z + t[2][1]) + f[:, 1]
            inside = np.maximum(y + t[1][2], z + t[2][2]) + f[:, 2]
            o[:m] = np.maximum(np.maximum(x + t[0][0], y + t[1][0]), z + t[2][0]) + f[:, 0]
            b[:m], i[:m] = begin, inside
            out[:m] += t[0][0] + f[:, 0]
        told = np.empty(len(order))
        told[order] = out - np.maximum(np.maximum(o, b), i)
        return told


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(chains: list[list[list[int]]], tags: list[list[int]], rounds: int = 80, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; forward and backward sums over all chains at once, the longest first."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    chains, tags = [chains[i][:PAD] for i in order], [tags[i][:PAD] for i in order]
    n, sizes = len(chains), np.array([len(c) for c in chains])
    row, col = np.repeat(np.arange(n), sizes), np.concatenate([np.arange(k) for k in sizes])
    pieces = [f for c in chains for f in c]
    width = max(map(len, pieces))
    ids = np.array([[*f, *[WEIGHTS] * (width - len(f))] for f in pieces])  # the last row of weights stays 0
    gold = np.concatenate(tags)
    deep = int(sizes.max())
    live = [int((sizes > j).sum()) for j in range(deep)]
    w, t = np.zeros((WEIGHTS + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    one = np.eye(3)
    low = -1e9
    moves, first = np.maximum(MOVES, low), np.maximum(FIRST, low)
    both = np.nonzero(col > 0)[0]
    seen = one[gold[both - 1]].T @ one[gold[both]]
    for k in range(1, rounds + 1):
        e = np.zeros((n, deep, 3))
        e[row, col] = w[ids].sum(axis=1)
        a, b = np.zeros((n, deep, 3)), np.zeros((n, deep, 3))
        a[:, 0] = first + e[:, 0]
        for j in range(1, deep):
            m = live[j]
            a[:m, j] = _log_sum(a[:m, j - 1, :, None] + t + moves, 1) + e[:m, j]
        for j in range(deep - 2, -1, -1):
            m = live[j + 1]
            b[:m, j] = _log_sum(t + moves + (e[:m, j + 1] + b[:m, j + 1])[:, None, :], 2)
        z = _log_sum(a[np.arange(n), sizes - 1], 1)
        post = np.exp(np.minimum(a[row, col] + b[row, col] - z[row, None], 0))
        diff = (post - one[gold]) / n
        gw = np.stack([np.bincount(ids.ravel(), np.repeat(diff[:, y], width), WEIGHTS + 1) for y in range(3)], 1) + ridge * w
        gw[-1] = 0
        at, of = row[both], col[both]
        pair = np.exp(np.minimum(a[at, of - 1][:, :, None] + t + moves + (e[at, of] + b[at, of])[:, None, :] - z[at, None, None], 0))
        gt = (pair.sum(axis=0) - seen) / n + ridge * t
        for x, g, m, v in ((w, gw, *state[:2]), (t, gt, *state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(w, t)


def training_runs(seed: int = 7, n: int = 1200) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts, each with the spans of its secrets: half of them hold one, half a look-alike."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    alnum, hexes, base64_chars = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: "".join(r.choices(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es", "ver", "ung", "ment", "que", "ción", "los"), k=r.randint(1, 5)))
    mixed = lambda k: "".join((some(string.ascii_lowercase, 1), some(string.digits, 1), some(string.ascii_uppercase, 1), some(alnum, k)))
    secrets = (
        lambda: some(hexes, r.choice((32, 40, 64))),
        lambda: mixed(r.randint(17, 40)),
        lambda: some("gsprx", 2) + r.choice(("p_", "k_live_", "k-", "-")) + mixed(r.randint(20, 36)),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: mixed(1) + some(base64_chars, r.randint(24, 44)) + r.choice(("", "=", "==")),
        lambda: ".".join(("eyJ" + some(alnum, r.randint(17, 30)) + "9", "eyJ" + some(alnum, r.randint(20, 60)), some(alnum + "_", r.randint(30, 43)))),
    )
    safe = (
        lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
        lambda: f"mail{r.randint(1, 99)}.{word()}.example.com",
        lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)),
        lambda: some(string.digits, r.randint(12, 19)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
        lambda: f"{word()}_{word()}_v{r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"{word()}/{word()}/{word()}{r.randint(1, 99)}.html",
        lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000000, 9999999)}",
        lambda: word() + word() + word() + str(r.randint(0, 2030)),
        lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}-{r.randint(10, 99)}",
        lambda: f"{r.randint(10, 99)}.{word()}{word()}{word()}",
        lambda: f"{word()}{word()}{word()}.{r.randint(10, 99)}",
    )
    before = ("", "", "key = ", 'token = "', "token: ", "Authorization: Bearer ", "pwd=", "secret ", "the key is ", "password: '", "id ", "see ")
    plain = ("", "", "", "the ", "from ", "see ", "key ", "id = ", "version: ", "at ", 'href="', "(")
    out = []
    for k in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 6))) + " "
        tail = r.choice((" ", '" ', "' ", ". ", "\n")) + " ".join(word() for _ in range(3))
        if k % 2:
            value, intro = r.choice(secrets)(), r.choice(before)
            at = len(lead) + len(intro)
            out.append((lead + intro + value + tail, [(at, at + len(value))]))
        else:
            out.append((lead + r.choice(plain) + r.choice(safe)() + tail, []))
    return out


SYLLABLES = (
    "th er on an re he in ed nd ha en es ver ung ment que ción los st ou at or ti tion ing the that and wh ly ble hat his der die sch ein ich keit lich heit zu über ge be pf tz au ö ü ä le la les des eau aux "
    "é è ê ç oi eur ai ez ado mente ña ía ó ra co bo ja ll ka mo su ni ta po li wa ro mi do ne fi gu ro str ck ght ph ous ism ist per con pro com de ex un dis ex ation ness ful less man land stein burg"
).split()
WORDS = (
    "about after again against always another because before between brother building business called change children city close company computer could country course different does down each early earth enough even every "
    "example family father feet figure first follow found friend from government great group grow hand head help high house important information interest international know language large learn letter light little live long "
    "make many might money mother mountain move much must name nature never night nothing number often only order other over own paper part people picture place plant point power problem public question quick read really "
    "right river room school science second sentence several should side simple small something song sound space special start state still story street strong study system table teacher their there these thing think though "
    "thought through time together took travel tree under understand until usually very voice walk water week weight which while white whole without woman word work world would write year young abend arbeit aufgabe beispiel "
    "bereich dabei deutsch dorf durch entwicklung erste fenster freund gegen gemeinde geschichte gesellschaft gesetz grund heute jahr jetzt kinder krankenhaus leben mensch möglich morgen nächste regierung schule schon sprache "
    "straße stadt versicherung verschiedene wasser weg wichtig wirtschaft wohnung zeit zusammen alors année après aujourd autre avec beaucoup bonjour chaque chose comme deux donc enfant entre français gouvernement homme "
    "jamais jour lorsque maintenant monde nouveau parce personne petit peut plusieurs pourquoi premier quelque toujours travail trois ville agua ahora algunos amigo antes aunque casa ciudad cuando desarrollo desde después "
    "donde empresa entonces español estado fuerza gente gobierno grande hacer hasta hombre lugar mayor mejor mientras mujer mundo mucho noche nuestro nuevo parte porque primero pueblo siempre sociedad también tiempo "
    "trabajo vida string value function return class import define include static void public private boolean integer index object request response server client config default database username"
).split()


def training_tokens(seed: int = 11, n: int = 4000) -> list[tuple[str, list[tuple[int, int]]]]:
    """As training_runs, with keys of letters only, passwords with other signs and short ones, and more look-alikes."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    letters, digits, signs = string.ascii_letters, string.digits, "!@#$%^&*?+-_~"
    base = lambda: "".join(r.choices(SYLLABLES, k=r.choice((1, 1, 2, 2, 3, 3, 4, 5, 7)))) if r.random() < 0.6 else "".join(r.choices(WORDS, k=r.choice((1, 1, 1, 1, 2, 3))))
    word = lambda: r.choice((str, str, str, str.capitalize, str.upper))(base())
    ascii_word = lambda: "".join(c for c in base() if c.isascii()) or "data"
    num = lambda a, b: str(r.randint(a, b))

    def shuffled(*parts):
        out = list("".join(parts))
        r.shuffle(out)
        return "".join(out)

    loose = (  # told by themselves
        lambda: some(letters, r.randint(20, 44)),
        lambda: some(letters, r.randint(20, 44)),
        lambda: some(string.ascii_lowercase, r.randint(24, 44)),
        lambda: some(string.ascii_lowercase, r.randint(20, 44)),
        lambda: some(string.ascii_uppercase, r.randint(24, 44)),
        lambda: some(letters + digits, r.randint(18, 40)),
        lambda: some("gsprx", r.randint(2, 3)) + r.choice(("p_", "k_live_", "k-", "-")) + some(letters + digits, r.randint(20, 36)),
        lambda: some(letters + digits + "+/", r.randint(24, 44)) + r.choice(("", "=", "==")),
        lambda: shuffled(some(letters, r.randint(6, 10)), some(digits, r.randint(2, 5)), some(signs, r.randint(2, 4))),
    )
    bound = (  # told by the word before
        *loose,
        lambda: shuffled(some(letters, r.randint(3, 8)), some(digits, r.randint(1, 4)), some(signs, r.randint(1, 4))),
        lambda: shuffled(some(letters, r.randint(3, 8)), some(digits, r.randint(1, 4)), some(signs, r.randint(1, 4))),
        lambda: shuffled(some(letters, r.randint(6, 12)), some(signs, r.randint(2, 4))),
        lambda: ascii_word().capitalize() + num(1, 2030) + some(signs, r.randint(1, 2)),
        lambda: ascii_word()[: r.randint(4, 9)] + num(1, 999) + some(signs, r.randint(0, 2)),
        lambda: ascii_word() + some("@#$_-", 1) + num(10, 9999) + some("!?*", r.randint(0, 1)),
        lambda: shuffled(some(letters, r.randint(3, 6)), some(digits, r.randint(2, 5))),
        lambda: shuffled(some(letters, r.randint(4, 6)), some(digits, r.randint(2, 5))),
        lambda: some(letters, r.randint(12, 19)),
    )
    keys = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "API_KEY", "Password", "DB_PASSWORD", "access_token", "client_secret", "SECRET_KEY", "PASSWORD", "Passwort", "Token")

    def intro() -> tuple[str, str]:
        k = r.choice(keys)
        return r.choice(((f"{k}: ", ""), (f"{k} = ", ""), (f"{k}=", ""), (f"{k}:", ""), (f'{k} = "', '"'), (f'{k} = "', r.choice(('",', '")', '");', '"###', '"!!', '".', '"***'))), (f"{k}='", "'"), (f'"{k}": "', '",'), (f'{{"{k}":"', '"}'), (f"{k} is ", ""), (f"{k} ", ""), (f"--{k}=", ""), (f"--{k} ", ""), (f"https://example.com/{base()}?{k}=", "&x=1"), ("Authorization: Bearer ", ""), ("Bearer ", ""), (f"the {k} for {base()} is ", ""), (f"the {k} is ", "."), (f"{k}: ", ","), (f"{k}={base()}; {k}=", ";"), (f"{k}: '", "'")))

    safe = (
        lambda: word(),
        lambda: word() + r.choice((",", ".", "!", "?", ";", ":", "!!", "...", "%%%", "###", "***", "$$$", "&&&", ",###", ".%%%", ")", "”")),
        lambda: r.choice(("(", '"', "'", "“", "«", "[", "###", "***", "--")) + word() + r.choice((")", '"', "'", "”", "»", "]", "###", "***", "")),
        lambda: f"{word()}-{word()}" + r.choice(("", "", f"-{word()}")),
        lambda: word() + r.choice(("'s", "n't", "'re", "'ll", "’s")),
        lambda: "".join(ascii_word().capitalize() for _ in range(r.randint(2, 4))) + r.choice(("", "()", "();", ".java", "[]", "2")),
        lambda: ascii_word() + "".join(ascii_word().capitalize() for _ in range(r.randint(1, 3))) + r.choice(("", "()", "(x)", ";")),
        lambda: "_".join(ascii_word() for _ in range(r.randint(2, 5))) + r.choice(("", "()", "=1", "=None,", ":")),
        lambda: f"{ascii_word()[:2]}{num(0, 99)}_{ascii_word()}_{ascii_word()}" + r.choice(("", "", "`", "()", ",")),
        lambda: f"{ascii_word()[:3]}{num(1, 999)}" + r.choice(("", "p", "x", "b")),
        lambda: "0x" + some("0123456789ABCDEF", r.choice((8, 16))),
        lambda: "_".join(ascii_word().upper() for _ in range(r.randint(2, 4))),
        lambda: f"<{ascii_word()}>{word()}</{ascii_word()}>",
        lambda: f'class="{ascii_word()}-{ascii_word()}">{word()}',
        lambda: f"https://www.{ascii_word()}.com/{ascii_word()}/{ascii_word()}-{ascii_word()}" + r.choice(("", "/", ".html", f"?id={num(1, 9999)}", f"?{ascii_word()}={ascii_word()}&page={num(1, 9)}")),
        lambda: f"/{ascii_word()}/{ascii_word()}/{ascii_word()}.{r.choice(('py', 'txt', 'json', 'so'))}",
        lambda: f"{ascii_word()}.{num(1, 99)}@mail{num(0, 9)}.{ascii_word()}.com",
        lambda: f"{ascii_word()}@{ascii_word()}.org",
        lambda: f"${num(1, 999)},{num(100, 999)}.{num(10, 99)}",
        lambda: num(0, 10 ** r.randint(1, 16)) + r.choice(("", "", "%", ",", ".", "th", "km", "€")),
        lambda: ".".join(num(0, 255) for _ in range(4)),
        lambda: f"({num(200, 999)})",
        lambda: f"{num(200, 999)}-{num(1000, 9999)}",
        lambda: f"{num(1, 12)}/{num(1, 28)}/{num(1950, 2030)}",
        lambda: f"{num(1990, 2030)}-{num(10, 12)}-{num(10, 28)}" + r.choice(("", f"T{num(10, 23)}:{num(10, 59)}:{num(10, 59)}Z")),
        lambda: f"{num(0, 23)}:{num(10, 59)}",
        lambda: f"v{num(0, 9)}.{num(0, 20)}.{num(0, 20)}",
        lambda: f"{ascii_word()}({ascii_word()},{num(0, 99)});",
        lambda: f"{ascii_word()}={ascii_word()}",
        lambda: f"{ascii_word()}[{num(0, 9)}]+={num(0, 99)};",
        lambda: r.choice(("==", "=>", "->", "{", "}", "//", "/*", "&&", "||", "---", "****", "#", "$", "&", "...", "=", ":", "i++", "#ff00aa", "0x1F", "=====", "__________", "I", "a", "A.", "U.S.", "e.g.,", "1st", "COVID-19", "H2O", "MP3", "x86_64", "UTF-8")),
    )
    prose = lambda: r.choice(safe[:5])()
    #: After a cue, but no secret.
    spoken = ("is required", "must be set", "of the house", "to success", "was lost", "and user", "field", "string", "None", "null", "true", "= None", ": str", "= getToken()", "= os.environ", "for the user", "= input()", "=", ": string,", "reset", "has expired", "in the garden", "= true", "*", "(optional)")
    out = []
    for k in range(n):
        gap = lambda: r.choice((" ", " ", " ", " ", "\n", "\t"))
        lead = "".join((prose() if r.random() < 0.8 else r.choice(safe)()) + gap() for _ in range(r.randint(0, 6)))
        tail = "".join(gap() + prose() for _ in range(r.randint(0, 4))) + "\n" * r.choice((0, 0, 0, 1, 3, 9, 20, 40, 70))
        if k % 4 == 1:
            before, after = intro()
            value = r.choice(bound)()
        elif k % 8 == 3:
            (before, after), value = r.choice((("", ""), ("", "."), ("", ","), ('"', '"'), ("(", ")"), ("key ", ""), ("id = ", ""))), r.choice(loose)()
        else:
            shown = r.choice(safe)() if k % 16 else r.choice(("", "the ", "a ", "his ")) + r.choice((*keys, "key", "tokens", "secrets")) + " " + r.choice(spoken)
            out.append((lead + shown + tail, []))
            continue
        at = len(lead) + len(before)
        out.append((lead + before + value + after + tail, [(at, at + len(value))]))
    return out


def _labelled(texts) -> tuple[list[list[list[int]]], list[list[int]]]:
    """The chains of all tokens and their tags."""
    chains, tags = [], []
    for text, held in texts:
        file = file_features(text)
        for m in TOKEN.finditer(text):
            spans, features = chain(text, m.start(), m.end(), file)
            inside = [next((h for h in held if h[0] <= a and b <= h[1]), None) for a, b in spans]
            chains.append(features)
            tags.append([OUT if h is None else BEGIN if i == 0 or inside[i - 1] != h else INSIDE for i, h in enumerate(inside)])
    return chains, tags


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(*_labelled([*training_runs(), *training_tokens()]))


def _tagged(text: str, start: int, end: int, file: tuple[str, ...], field: Field) -> Iterator[tuple[int, int]]:
    """The spans of a token."""
    spans, features = chain(text, start, end, file)
    begin = None
    for (a, b), tag in zip([*spans, (end, end)], [*field.decode(features), OUT], strict=True):
        if begin is not None and tag != INSIDE:
            yield begin, last  # noqa: F821
            begin = None
        if tag == BEGIN:
            begin = a
        last = b  # noqa: F841


def _in_reach(text: str) -> Iterator[tuple[int, int]]:
    """The tokens that start within reach of a cue."""
    at = 0
    for m in CUE.finditer(text):
        lo = max(m.end(), at)
        if lo > 0 and not text[lo - 1].isspace():  # a token that begins before lo
            lo = next((x for x in range(lo, len(text)) if text[x].isspace()), len(text))
        for t in TOKEN.finditer(text, lo):
            if t.start() - m.start() > REACH:
                break
            yield t.span()
            at = t.end()


def _hot(texts: Iterable[str], field: Field) -> set[str]:
    """The tokens of texts that may be secrets without a cue."""
    known = _plain.setdefault(field.key, set())
    new = set().union(*(t.split() for t in texts)) - known
    hot = {t for t in new if len(t) > LONG}
    tokens = list(new - hot)
    for t, plain in zip(tokens, field.plain_tokens(tokens), strict=True):
        if not plain:
            hot.add(t)
        elif len(known) < PLAIN:
            known.add(t)
    return hot


def field_spans(text: str, field: Field, hot: set[str] | None = None) -> list[tuple[int, int]]:
    """hot: as by _hot, of this text or of more."""
    file = file_features(text)
    low = text.lower()
    todo = set(_in_reach(text)) if any(k in low for k in PARTS) else set()
    hot = (_hot((text,), field) if hot is None else hot).intersection(text.split())
    if hot:
        todo.update(m.span() for m in TOKEN.finditer(text) if m[0] in hot)
    return [s for a, b in sorted(todo) for s in _tagged(text, a, b, file, field)]


def scan(text: str | None, field: Field, hot: set[str] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans, as (start, kind, end). Spans of the field stand beside the base ones, which they may overlap."""
    if not isinstance(text, str) or not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + [(a, 3, b) for a, b in field_spans(text, field, hot)])


def scans(texts: list[str | None], field: Field) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """As scan, for the texts of a batch."""
    for a, b in chunks(texts, TEXT_AT_ONCE):
        part = texts[a:b]
        hot = _hot([t for t in part if isinstance(t, str)], field)
        yield from (scan(t, field, hot) for t in part)


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: array<struct<kind, start, end>>, in code points, end exclusive."""
    field = trained()
    kind = "array<struct<kind string, start int, end int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shown = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for b in batches:
            found = list(scans(b["text"].tolist(), field))
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": [shown(x) for x, _ in found], "spans": [shown(y) for _, y in found]})

    return frames(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of overlapping spans replaced. Rows and columns stay as they are."""
    field = trained()

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def of(text, spans):
            if not spans:
                return text
            out, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]])

        for texts in batches:
            held = texts.tolist()
            yield pd.Series([of(t, spans) for t, (_, spans) in zip(held, scans(held, field), strict=True)], texts.index, object)

    return docs.select(*[clean(F.col("`text`")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
