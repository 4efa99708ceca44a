"""Statistics of a text as Catalyst expressions, shared by the quality rules and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPACES_CLASS, text_or_empty

WINDOW = 5


def with_stats(rows: DataFrame) -> DataFrame:
    """rows with a struct column stats in place of text.

    A word is a run without white space; a 5-word window is told by the hashes of its five words. Windows found
    twice are those whose (hash, position) longs lie beside an equal hash once sorted; the hashes of the five words then decide.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != "text"]
    parts = F.split(text_or_empty(), SPACES_CLASS + "+")
    skip = F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)
    cut = F.when(F.get("parts", F.size("parts") - 1) == "", 1).otherwise(0)
    a = rows.select(
        *others,
        text_or_empty().alias("text"),
        F.regexp_replace(text_or_empty(), r"[^#*$%&|<>!?0-9\p{Lu}]+", "").alias("marks"),
        parts.alias("parts"),
        F.filter(F.split(text_or_empty(), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    a = a.select(*others, "text", "marks", "lines", F.slice("parts", skip + 1, F.greatest(F.size("parts") - skip - cut, F.lit(0))).alias("words"))
    b = a.select(
        *others,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("marks", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("marks", F.lit(r"[!?]")).cast("long").alias("n_bangs"),
        F.regexp_count("marks", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("marks", r"[#*$%&|<>!?0-9]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    at = lambda i, k: F.get("hashes", i + k)
    grams = F.transform(F.slice("hashes", F.lit(1), windows), lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, WINDOW)]))
    c = b.select("*", F.ceil(F.log2(windows + 1)).cast("int").alias("shift"), grams.alias("grams"))
    packed = F.transform("grams", lambda x, i: F.call_function("shiftleft", x, F.col("shift")).bitwiseOR(i.cast("long")))
    # Most texts repeat no window: only the others are sorted.
    c = c.select("*", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("sorted"))
    place = lambda x: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("shift"))).bitwiseAND(x).cast("int")

    def like(x, y):
        i, j = place(x), place(y)
        same = F.call_function("shiftright", x, F.col("shift")) == F.call_function("shiftright", y, F.col("shift"))
        for k in range(WINDOW):
            same = same & (at(i, k) == at(j, k))
        return F.coalesce(same, F.lit(False))

    twice = F.transform(F.filter("sorted", lambda x, n: like(x, F.get("sorted", n - 1)) | like(x, F.get("sorted", n + 1))), place)
    d = c.select("*", F.sort_array(twice).alias("twice"))
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    names = ["n_words", "word_chars", "n_chars", "n_symbols", "n_bangs", "n_upper", "n_digits", "n_lines", "n_dup_lines"]
    return d.select(*others, F.struct(*names, covered.cast("long").alias("n_repeat_words")).alias("stats"))
