"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

A text is cut into words by the split pattern. The bytes of a word are folded: the adjacent pair of the least rank, the
leftmost of equals, becomes one piece until no pair has a rank. Ids are ranks. Decoding joins the bytes of the pieces.

Distinct words: all words are counted (each task sends each word once). A table of ``KNOWN`` places keeps the ``WAYS`` most
frequent of each hash, of at most ``KNOWN_BYTES`` bytes, which are folded once. Other words are folded where they stand. So nothing but counts is shuffled, the table has a fixed bound, and ids don't depend on which
words it holds.

The rank map is one constant that all lambdas share, made of flat arrays, since Spark searches a map literal entry by entry.
It and the table of frequent words are written as tables of one row, which scalar subqueries put into the plan as literal
values: so they aren't part of the plan's text, which Spark keeps and logs for each query.


* ``base`` and ``cells`` hold the pairs that have a rank: the pair (a, b) owns the cell base[a] + b if that cell names a,
  and the cell's number is the rank. Rows are laid over each other so that no two pairs own one cell.
* ``pieces`` holds the bytes of each piece as characters U+0000 to U+00FF, so that joining them and encoding the result as
  ISO-8859-1 gives the bytes; ``width`` their number; ``single`` the rank of each byte, then that of each piece, 256 places up.
* ``early`` holds the merges of the lowest ranks. Rare words of a text take these together, as one string in which a byte is
  a character up to U+00FF and a piece one 256 above its rank; the fold of each word goes on from there.
* ``known`` holds the frequent words, at places told by their hash, ``known_ids`` their ids; the word found is compared with the
  one sought.

The fold is quadratic in the length of a word, so a word above ``WINDOW`` bytes is taken window by window: each window
begins where a piece of the last one begins, in its second half, and must begin with that same piece. Then every adjacent
pair of pieces stands as in the encoding of some window, which makes the whole the encoding of the word. Should a window
begin with another piece, the word is folded as a whole.

Defined results: null and empty texts have no ids; control strings of special tokens are ordinary text; each row is
encoded by itself, so ties and repeated rows change nothing, and a null doc_id stays null; texts and words of any length
are encoded whole; an empty table gives an empty result; other columns, whatever their names, pass through ``encoded``
untouched; null ids decode to nothing, and an id outside the vocabulary has no bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Longest word, in bytes, that is folded at once.
WINDOW = 512
#: Words of the table of frequent ones, a power of two, the longest of them, and words of one hash: about 25 MB at any size of the corpus.
KNOWN, KNOWN_BYTES, WAYS = 1 << 19, 64, 2
#: Merges of the lowest ranks that the rare words of a text take together, at most.
EARLY = 256
#: Stands between the rare words of a text, and around one among ids. Bytes and pieces have lower code points.
MARK = "\uE000"
#: More than any rank: no pair.
NONE = 1 << 20
#: The same in the 19 bits that the fold has for a rank.
UNRANKED = (1 << 19) - 1
#: The letters and the digits that Unicode 14 to 16 added, which the libraries know and Java 17 doesn't.
NEW_LETTERS = """
0870-0887 0889-088E 08B5-08B5 08C8-08C9 0C5D-0C5D 0CDD-0CDD 170D-170D 171F-171F 1B4C-1B4C 1C89-1C8A 2C2F-2C2F
2C5F-2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3-A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592
10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA
10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075-11075 1123F-11240 11380-11389 1138B-1138B
1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02-11F02
11F04-11F10 11F12-11F33 12F90-12FF0 1342F-1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C
18CFF-18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132-1B132 1B155-1B155 1DF00-1DF1E 1DF25-1DF2A
1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0-1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE
2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
NEW_DIGITS = """
10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3
1E4F0-1E4F9 1E5F1-1E5FA
"""
#: What \s means in the pattern.
BLANKS = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _ranges(of: str) -> str:
    return "".join(rf"\x{{{x}}}-\x{{{y}}}" for x, y in (r.split("-") for r in of.split()))


def split_pattern(new: bool = True) -> str:
    """The public pattern for Java, whose \\s knows ASCII only and whose letters are those of an older Unicode: without
    ``new`` the letters and digits added since are left out."""
    import public_tokenizers

    classes = {"L": r"\p{L}" + _ranges(NEW_LETTERS) * new, "N": r"\p{N}" + _ranges(NEW_DIGITS) * new}
    before, after = public_tokenizers.PATTERN.split(r"[^\s\p{L}\p{N}]")

    def spelled(part: str) -> str:
        part = re.sub(r"\\p\{([LN])\}", lambda m: f"[{classes[m[1]]}]", part)
        return part.replace(r"\s", f"[{BLANKS}]").replace(r"\S", f"[^{BLANKS}]")

    return spelled(before) + f"[^{BLANKS}{classes['L']}{classes['N']}]" + spelled(after)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranked_pairs(ranks: dict[bytes, int]) -> dict[int, list[tuple[int, int]]]:
    """For each left piece the right pieces, with the rank of both together."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    return rows


def _halves(whole: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], int]:
    """The last two pieces that the ranked merges make of a piece, or more if none joins them, and the highest rank of these merges."""
    parts, high = [whole[i : i + 1] for i in range(len(whole))], -1
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NONE:
            break
        parts[i : i + 2], high = [parts[i] + parts[i + 1]], max(high, rank)
    return parts, high


def early_merges(ranks: dict[bytes, int], most: int = EARLY) -> list[tuple[str, str]]:
    """Two pieces and the piece of both, as characters, for the lowest ranks. Two adjacent pieces within a word are what the merges make
    of the bytes of both alone, so a piece comes from its halves only. If all merges inside pieces have lower ranks than these,
    no merge makes a pair of a lower rank, and replacing one pair after the other is the fold. The list ends before the first other piece."""
    told = lambda p: chr(p[0]) if len(p) == 1 else chr(256 + ranks[p])
    out: list[tuple[str, str]] = []
    for whole in sorted((p for p in ranks if len(p) > 1), key=ranks.get):
        parts, high = _halves(whole, ranks)
        if len(out) >= most or high >= ranks[whole]:
            break
        if len(parts) == 2:
            out.append(("".join(map(told, parts)), told(whole)))
    return out


def laid_over(rows: dict[int, list[tuple[int, int]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """base and cells: the rows in one array, each at the first place where its columns are free, the longest first."""
    base, owned, taken = np.zeros(width, int), {}, 0  # bit i of taken: cell i has an owner
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        clash = 0
        for b, _ in row:
            clash |= taken >> b
        base[a] = (~clash & (clash + 1)).bit_length() - 1
        for b, rank in row:
            owned[int(base[a]) + b] = (a << 40) + (rank << 20)
            taken |= 1 << (int(base[a]) + b)
    cells = np.full(max(owned, default=0) + width, NONE << 40, np.int64)
    cells[list(owned)] = list(owned.values())
    return base, cells


@lru_cache(maxsize=2)
def _arrays(path: str) -> dict[str, pa.Array]:
    """The rank map, by name."""
    ranks = read_ranks(path)
    order: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        order[rank] = piece
    base, cells = laid_over(ranked_pairs(ranks), len(order))
    numbers = {"base": base, "cells": cells, "width": [len(p) for p in order], "single": [ranks[bytes([i])] for i in range(256)] + list(range(len(order)))}
    early = pa.array([{"pair": a, "piece": b} for a, b in early_merges(ranks)], pa.struct({"pair": pa.string(), "piece": pa.string()}))
    return {k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {"pieces": pa.array([p.decode("latin-1") for p in order]), "early": early}


def _row(spark: SparkSession, arrays: dict[str, pa.Array], label: str) -> DataFrame:
    """A table of one row, with a column m that is a struct of arrays."""
    row = pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in arrays.items()})
    return written(spark.createDataFrame(row).coalesce(1), label).select(F.struct(*arrays).alias("m"))


def rank_map(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rank map as a table of one row."""
    return _row(spark, _arrays(path or vocabulary_path()), "ranks")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: a fold over nothing that ends in use."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def _with(maps: Column, names: tuple[str, ...], use: Callable[[dict[str, Column]], Column]) -> Column:
    """use(arrays), with each of these arrays of the struct maps read from it once for a row. maps is named once, so that the
    optimizer puts the subquery behind it here, instead of a column that holds it."""

    def bound(struct: Column, left: tuple[str, ...], arrays: dict[str, Column]) -> Column:
        if not left:
            return use(arrays)
        return _let(struct[left[0]], lambda x: bound(struct, left[1:], arrays | {left[0]: x}))

    return _let(maps, lambda struct: bound(struct, names, {}))


RANKS = ("base", "cells", "width", "single")


def _joined(*arrays: Column) -> Column:
    return F.flatten(F.array(*arrays))  # several times as fast as concat() inside a lambda


def _rank(maps: dict[str, Column], a: Column, b: Column) -> Column:
    """The rank of two pieces together, 20 bits up. Without one it is null or at least NONE, 20 bits up, as the cell names
    another piece then."""
    return F.get(maps["cells"], F.get(maps["base"], a) + b).bitwiseXOR(F.call_function("shiftleft", a, F.lit(40)))


def _fold(maps: dict[str, Column], ids: Column) -> Column:
    """ids with all ranked merges made. A piece is one number: from bit 44 the rank of it and the next together (UNRANKED without
    one), from bit 20 its first byte's place, then its id. So the least number is the leftmost of the least rank."""
    low = lambda e, bits: e.bitwiseAND((1 << bits) - 1)
    left = lambda e, bits: F.call_function("shiftleft", e, F.lit(bits))

    def piece(a: Column, b: Column, rest: Column) -> Column:
        return left(F.least(_rank(maps, a, b), F.lit(UNRANKED << 20)), 24).bitwiseOR(rest)  # least() skips nulls

    def merged(s: Column, least: Column, at: Column) -> Column:
        """at: the number of the pair's left piece, from 1."""
        new, before = F.call_function("shiftright", least, F.lit(44)), F.get(s, at - 2)
        own = piece(new, low(F.get(s, at + 1), 20), low(least, 44) - low(least, 20) + new)
        told = F.when(at > 1, F.array(piece(low(before, 20), new, low(before, 44)), own)).otherwise(F.array(own))
        return _joined(F.slice(s, F.lit(1), F.greatest(at - 2, F.lit(0))), told, F.slice(s, at + 2, F.size(s)))

    def step(s: Column, _: Column) -> Column:
        found = lambda least: _let(F.array_position(s, least).cast("int"), lambda at: merged(s, least, at))
        return _let(F.array_min(s), lambda least: F.when(least < UNRANKED << 44, found(least)).otherwise(s))

    steps = F.slice(ids, F.lit(1), F.size(ids) - 1)  # as many as there can be merges
    pieces = F.transform(ids, lambda a, i: piece(a, F.get(ids, i + 1), left(i.cast("long"), 20) + a))
    return F.transform(F.aggregate(steps, pieces, step), lambda e: low(e, 20))


def _by_windows(maps: dict[str, Column], ids: Column, window: int) -> Column:
    """As _fold, for long words. at: bytes before the window; first: the piece with which it must begin."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("first"), F.array().cast("array<array<bigint>>").alias("out"), F.lit(True).alias("fits"))

    def step(s: Column, _: Column) -> Column:
        part = F.slice(ids, s["at"] + 1, F.lit(window))
        ended = s["at"] + window >= F.size(ids)

        def taken(p: Column) -> Column:
            half = F.when(ended, F.size(p)).otherwise(F.size(p) - F.floor(F.size(p) / 2).cast("int"))
            kept = F.slice(p, F.lit(1), half)
            wide = F.aggregate(kept, F.lit(0).cast("long"), lambda n, i: n + F.get(maps["width"], i))
            return F.struct(
                (s["at"] + wide).alias("at"), F.get(p, half).alias("first"), F.concat(s["out"], F.array(kept)).alias("out"),
                ((s["first"].isNull() | (s["first"] == F.get(p, F.lit(0)))) & (ended | (F.size(p) > 1))).alias("fits"),
            )

        return F.when(~s["fits"] | (s["at"] >= F.size(ids)), s).otherwise(_let(_let(part, lambda x: _fold(maps, x)), taken))

    return F.aggregate(ids, start, step, lambda s: F.when(s["fits"], F.flatten(s["out"])).otherwise(_fold(maps, ids)))


def words_of(text: Column) -> Column:
    """The many ranges of new characters slow the pattern down; texts without such characters do without them."""
    new = F.rlike(text, F.lit(rf"[\u0870-\x{{10FFFF}}&&[{_ranges(NEW_LETTERS)}{_ranges(NEW_DIGITS)}]]"))
    plain, full = (F.regexp_extract_all(text, F.lit(split_pattern(x)), F.lit(0)) for x in (False, True))
    return F.when(new, full).otherwise(plain)


def _as_bytes(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _characters(maps: dict[str, Column], word: Column) -> Column:
    """The ids of the bytes and pieces that the characters of word stand for."""
    return F.transform(F.split(word, ""), lambda c: F.get(maps["single"], F.ascii(c)))


def _rare_told(maps: dict[str, Column], text: Column) -> Column:
    """text: ids joined by commas, with the bytes of rare words between two marks each. Their ids take their places."""

    def told(parts: Column) -> Column:
        words = F.array_join(F.filter(parts, lambda p, i: i % 2 == 1), MARK)
        # contains() finds nothing at less cost than replace() does
        merged = F.aggregate(maps["early"], words, lambda s, m: F.when(F.contains(s, m["pair"]), F.replace(s, m["pair"], m["piece"])).otherwise(s))
        ids = F.transform(F.split(merged, MARK), lambda w: F.array_join(_let(_characters(maps, w), lambda x: _fold(maps, x)).cast("array<string>"), ","))
        joined = _let(ids, lambda x: F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get(x, F.shiftright(i, 1))).otherwise(p)), ""))
        return F.when(F.size(parts) > 1, joined).otherwise(F.get(parts, F.lit(0)))

    return _let(F.split(text, MARK), told)


def _folded(maps: dict[str, Column], word: Column, window: int) -> Column:
    """The ids of a word, joined by commas."""
    ids = _characters(maps, _as_bytes(word))
    short = F.octet_length(word) <= window
    return F.array_join(_let(ids, lambda x: F.when(short, _fold(maps, x)).otherwise(_by_windows(maps, x, window))).cast("array<string>"), ",")


def _sets(known: int) -> int:
    return max(known // WAYS, 1)


def _first_place(word: Column, known: int) -> Column:
    """The first of the WAYS places of a word in the table, told by its hash."""
    return (F.xxhash64(word).bitwiseAND(_sets(known) - 1) * WAYS).cast("int")


def known_words(words: DataFrame, ranks: DataFrame, known: int = KNOWN) -> DataFrame:
    """The most frequent words of the column ``words``, an array, with their ids, as two arrays in a table of one row. Of the words
    of one hash the WAYS most frequent have a place. Words found once would gain nothing."""
    each = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.octet_length("word") <= KNOWN_BYTES) & (F.col("n") > 1))
    each = each.select(_first_place(F.col("word"), known).alias("first"), F.struct((-F.col("n")).alias("n"), "word").alias("x"))
    best = each.groupBy("first").agg(F.slice(F.sort_array(F.collect_list("x")), 1, WAYS if known else 0).alias("best"))
    top = best.select("first", F.posexplode("best").alias("way", "x")).select((F.col("first") + F.col("way")).alias("at"), "x.word").withColumn("m", ranks.scalar())
    told = top.select("word", _with(F.col("m"), RANKS, lambda maps: _folded(maps, F.col("word"), KNOWN_BYTES)).alias("ids"), "at").toArrow().combine_chunks()
    rows = np.full(_sets(known) * WAYS, -1)
    rows[told["at"].to_numpy()] = np.arange(len(told))
    places = pa.array(rows, mask=rows < 0)
    arrays = {c: pa.concat_arrays(told[c].chunks or [pa.array([], pa.string())]).cast(pa.string()).take(places) for c in ("word", "ids")}
    return _row(words.sparkSession, {"known": arrays["word"], "known_ids": arrays["ids"]}, "known")


def token_ids(words: Column, ranks: Column, frequent: Column, known: int = KNOWN, window: int = WINDOW) -> Column:
    """The ids of the words of a text, joined by commas. ``frequent`` holds those of ``known`` words at most."""

    def told(maps: dict[str, Column], word: Column, first: Column) -> Column:
        found = F
        for way in range(WAYS):
            at = first + way if way else first
            found = found.when(F.get(maps["known"], at) == word, F.get(maps["known_ids"], at))
        rare = F.concat(F.lit(MARK), _as_bytes(word), F.lit(MARK))
        return found.when(F.octet_length(word) <= window, rare).otherwise(_folded(maps, word, window))

    def all_told(maps: dict[str, Column]) -> Column:
        places = lambda w: F.transform(w, lambda x: _first_place(x, known))
        return _let(words, lambda w: _let(places(w), lambda at: F.array_join(F.transform(w, lambda x, i: told(maps, x, F.get(at, i))), ",")))

    return _with(ranks, (*RANKS, "early"), lambda maps: _rare_told(maps, _with(frequent, ("known", "known_ids"), lambda more: all_told(maps | more))))


def decoded_bytes(ids: Column, ranks: Column) -> Column:
    """binary: the bytes of the pieces, joined."""
    some = F.coalesce(ids, F.array().cast("array<int>"))
    return F.encode(_with(ranks, ("pieces",), lambda maps: F.array_join(F.transform(some, lambda i: F.get(maps["pieces"], i)), "")), "ISO-8859-1")


def encoded(docs: DataFrame, ranks: DataFrame | None = None, known: int = KNOWN, window: int = WINDOW) -> DataFrame:
    """row: the columns of docs as a struct; told: the ids joined by commas; ids: array<int>."""
    ranks = rank_map(docs.sparkSession) if ranks is None else ranks
    frequent = known_words(docs.select(words_of(text_or_empty()).alias("words")), ranks, known)
    # What is named more than once below is a column of the input, so that the optimizer makes one projection of both and no
    # row carries m or k.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("t"), ranks.scalar().alias("m"), frequent.scalar().alias("k"))
    told = rows.select("row", token_ids(words_of(text_or_empty("t")), F.col("m"), F.col("k"), known, window).alias("told"))
    return told.withColumn("ids", F.when(F.col("told") == "", F.array().cast("array<int>")).otherwise(F.split("told", ",").cast("array<int>")))


def decoded(rows: DataFrame, ranks: DataFrame, use: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with name, which use makes from the ids and the bytes that they decode to, in place of ids."""
    others = [c for c in rows.columns if c != "ids"]
    made = lambda m, ids: _let(ids, lambda x: use(x, decoded_bytes(x, m)))
    return rows.withColumn("m", ranks.scalar()).select(*others, made(F.col("m"), F.col("ids")).alias(name))


def op13_byte_pair_encoding(spark, sf_dir: str) -> DataFrame:
    ranks = rank_map(spark)
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)

    def digests(ids: Column, text: Column) -> Column:
        return F.struct(F.size(ids).cast("long").alias("n_tokens"), F.sha2("told", 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))

    return decoded(docs, ranks, digests, "d").select("row.doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
