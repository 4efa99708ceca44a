"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed by numpy.

The statistics are Catalyst expressions, so texts stay in the JVM and only numbers cross to Python. Trees are
complete and flattened into arrays: a batch of rows walks down a tree with one comparison of arrays a level.
The model is fitted on the driver, from at most ``FIT_ROWS`` labelled rows; every document is scored.

Defined results: null and empty texts have all statistics 0 and get a score; each row is scored, repeated or not;
labels with a null doc_id or quality are not learned from, and a repeated label counts once (the largest quality), with
the least of the texts of its doc_id; a null doc_id is not held out; texts are taken whole, whatever their length;
without labels of both kinds each score is the share of good ones (0.5 without any); an empty table gives an empty
result; labels, lang, source and doc_id are never inputs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .text_stats import with_stats

#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 20_000

#: The inputs, as SQL over the columns of stats.
INPUTS = {
    "n_words": "n_words",
    "n_chars": "n_chars",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Boosting:
    """Arrays of all trees: inner nodes (trees, 2^depth - 1) and leaves (trees, 2^depth)."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += leaf[at - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Boosting:
    """Logistic loss with Newton leaves; splits are searched in histograms of ``bins`` quantile bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Boosting(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n_features = x.shape[1]
    slots = binned + np.arange(n_features) * bins
    raw = np.full(len(y), start)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            place = ((at - base)[:, None] * (n_features * bins) + slots).ravel()
            shape = (width, n_features, bins)
            hist = lambda w: np.bincount(place, np.repeat(w, n_features), width * n_features * bins).reshape(shape).cumsum(2)  # noqa: B023, E731
            gl, hl = hist(g), hist(h)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1).max(1) > 1e-9
            f, b = best // bins, best % bins
            for k in np.nonzero(worth)[0]:
                feature[base + k], cut[base + k] = f[k], edges[f[k]][b[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        raw += leaf[at - inner]
        made.append((feature, cut, leaf))
    return Boosting(start, *(np.stack(a) for a in zip(*made, strict=True)))


def _inputs(docs: DataFrame, *others: str) -> DataFrame:
    import re

    stats = with_stats(docs.select(*others, "text"))
    return stats.select(*others, *[F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"stats.\1", e)).cast("double").alias(f"x_{k}") for k, e in INPUTS.items()])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Boosting:
    """labels: doc_id, quality. At most ``rows`` of them are used: those whose hashes are below a bar."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, 0.9 * rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows).select(F.col("doc_id").alias("of"), "quality")
    # At most FIT_ROWS rows of two numbers: a proven bound for the broadcast. One text for each keeps the bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    held = _inputs(texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")), "quality", "doc_id")
    data = held.toPandas().sort_values("doc_id").drop(columns="doc_id")
    return fit(data.drop(columns="quality").to_numpy(float), (data["quality"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, model: Boosting, *others: str) -> DataFrame:
    """The columns named by others, and score."""
    x = _inputs(docs, *others)
    names = [c for c in x.columns if c.startswith("x_") and c[2:] in INPUTS]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(model.score(np.stack([c.to_numpy(float) for c in columns], 1)))

    return x.select(*others, score(*names).alias("score"))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out()).select("doc_id", "quality"))
    scored = score_documents(docs, model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
