"""Recognised text, cue lines and time stamps as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def joined_texts(texts: Column) -> Column:
    """An array of recognised texts, trimmed, without empty ones, a line each."""
    return F.array_join(F.filter(F.transform(texts, trimmed), lambda t: t != ""), "\n")


def normalised_text(text: Column) -> Column:
    """Each line with its white space collapsed; empty lines dropped."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: trimmed(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def ordered_lines(lines: Column) -> Column:
    """Texts of an array of struct<center, text> by center, equal centers in order; empty ones and those equal to
    the one before are dropped."""
    ranked = F.array_sort(F.transform(lines, lambda x, i: F.struct(x["center"].alias("center"), i.alias("i"), trimmed(x["text"]).alias("text"))))
    texts = F.filter(F.transform(ranked, lambda x: x["text"]), lambda t: t != "")
    return F.filter(texts, lambda t, i: (i == 0) | (t != F.get(texts, i - 1)))


def srt_time(ns: Column) -> Column:
    """HH:MM:SS,mmm, cut to milliseconds, hours unbounded."""
    ms = F.floor(ns / 1_000_000).cast("long")
    part = lambda per, mod: (F.floor(ms / per) % mod).cast("long") if mod else F.floor(ms / per).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def display_time(ms: Column) -> Column:
    """m:ss.mmm or h:mm:ss.mmm, rounded half up; 0:00.000 for nothing, less than nothing and what is not finite."""
    n = F.floor(ms + 0.5).cast("long")
    h, m, s = F.floor(n / 3_600_000).cast("long"), (F.floor(n / 60_000) % 60).cast("long"), (F.floor(n / 1000) % 60).cast("long")
    shown = F.when(h > 0, F.format_string("%d:%02d:%02d.%03d", h, m, s, n % 1000)).otherwise(F.format_string("%d:%02d.%03d", m, s, n % 1000))
    bad = ms.isNull() | F.isnan(ms) | (ms <= 0) | (ms == float("inf"))
    return F.when(bad, "0:00.000").otherwise(shown)
