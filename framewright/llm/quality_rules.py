"""Quality rules with controlled risk.

Each rule has a statistic that is large in bad documents and a ladder of cutoffs. In every stratum, the labelled good
documents are split by a hash of doc_id. On the smaller part each rule learns its place on its ladder: the strictest
cutoff that rejects at most risk / (2 * rules) of them. From there all rules move together: at step t each rule's cutoff
lies t places laxer, so a document's score is the largest t that still rejects it, over its rules, and steps are nested.

The steps are certified on the other part, which took no part in learning: a step passes when the exact binomial
probability of so few false rejections or fewer, at a rate of ``risk``, is at most ``delta`` shared equally among the
strata (Bonferroni). They are tested in a fixed sequence from the laxest, which needs no further share, as a step
rejects at least as many as all laxer ones. The strictest certified step applies; without one, the rules do not apply in
that stratum. All rules together thus reject falsely at most ``risk`` of a stratum, in all strata at once with
confidence 1 - delta. With four strata, a risk of 0.03 and a delta of 0.05, 144 good documents to certify on suffice,
about 210 in all; with a risk of 0.05, 86 and 125.

Everything is counted over all rows: aggregations by stratum with map-side partials over the labelled rows, then a join
with a row for each stratum, which Spark broadcasts only where it has measured the size.

Defined results: null and empty texts have no words and fail the base; a null stratum is a stratum; documents
without labels are judged by their stratum's step; a label row repeated counts once (the largest quality); rows
that share a doc_id are judged one by one; empty labels certify nothing; empty tables give empty results; texts are
taken whole, whatever their length; other columns, whatever their names, are kept by ``apply_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .text_stats import with_stats


@dataclass(frozen=True)
class Rule:
    """over: a statistic, as SQL over the columns of stats, that is large in bad documents."""

    name: str
    over: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols_a_word", "n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    Rule("bangs_a_word", "n_bangs / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    Rule("upper_a_char", "n_upper / greatest(word_chars, 1)", (0.1, 0.15, 0.2, 0.3, 0.5, 0.7)),
    Rule("dup_lines_a_line", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.15, 0.2, 0.3, 0.4, 0.6)),
    Rule("repeats_a_word", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.08, 0.1, 0.12, 0.15, 0.18)),
    Rule("digits_a_char", "n_digits / greatest(word_chars, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
)
#: The share of good documents that the rules of a stratum may reject, and the chance that any stratum's reject more.
RISK, DELTA = 0.03, 0.05
#: The steps that are tested, in this order.
STEPS = (3, 2, 1, 0, -1, -2, -3)


def base_failed() -> Column:
    return (F.col("stats.n_words") < 10) | (100 * F.col("stats.n_repeat_words") > 20 * F.col("stats.n_words"))


def _over(rule: Rule) -> Column:
    import re

    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"stats.\1", rule.over))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial(n, p): the terms from k downward, each from the one before. Those further than
    40 standard deviations and 100 below k add less than a double can hold."""
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 100).cast("int")
    ratios = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct((s["term"] * (k - j) / (n - k + j + 1) * (1 - p) / p).alias("term"), (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"],
    )
    return F.when(n == 0, 1.0).when(k >= n, 1.0).when(k / n > p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(first + F.log(ratios))))


def levels(rules=RULES) -> Column:
    """For each rule, how many of its cutoffs a document's statistic passes."""
    passed = lambda over, cutoffs: F.size(F.filter(F.array(*map(F.lit, map(float, sorted(cutoffs)))), lambda c: over > c))
    return F.array(*[passed(_over(r), r.cutoffs) for r in rules])


def score(found: Column, learned: Column) -> Column:
    """The step above which a document is kept: at any step below its score it is rejected. Null if it never is."""
    return F.array_max(F.filter(F.zip_with(found, learned, lambda n, at: F.when(n > 0, n - at)), lambda x: x.isNotNull()))


def _learning() -> Column:
    """Whether a labelled document is for learning: five sixteenths of them are."""
    return F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "5"


def certified_steps(stats: DataFrame, labels: DataFrame, stratum: str = "lang", rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, learned (the place of each rule's cutoff), step (the strictest certified one or null). stats: doc_id,
    the stratum, stats."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality")).where("quality = 1").select("of")
    held = stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("of"))
    held = written(held.select(F.col(stratum).alias("stratum"), _learning().alias("learning"), levels(rules).alias("found")), "held")  # labelled rows only
    allowed = F.count_if("learning") * F.lit(risk / (2 * len(rules)))
    places = []
    for i, r in enumerate(rules):
        passed = [F.count_if(F.col("learning") & (F.col("found")[i] > j)) <= allowed for j in range(len(r.cutoffs))]
        places.append(F.coalesce(*[F.when(p, j) for j, p in enumerate(passed)], F.lit(len(r.cutoffs))))
    learned = held.groupBy("stratum").agg(F.array(*places).alias("learned"))
    scored = held.where(~F.col("learning")).join(learned.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of"))).withColumn("score", score(F.col("found"), F.col("learned")))
    counts = scored.groupBy("stratum", "learned").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") > t).alias(f"k_{i}") for i, t in enumerate(STEPS)])
    counts = written(counts, "strata")
    share = delta / max(counts.count(), 1)
    passes = [F.when(binomial_tail(F.col(f"k_{i}"), F.col("n"), F.lit(risk)) <= share, t) for i, t in enumerate(STEPS)]
    return counts.select("stratum", "learned", F.least(*passes).alias("step"))


def judged(stats: DataFrame, steps: DataFrame, stratum: str = "lang", rules=RULES) -> DataFrame:
    """stats with base_failed and kept."""
    chosen = steps.select(F.col("stratum").alias("of_stratum"), "learned", "step")
    fails = base_failed()
    joined = stats.join(chosen, F.col(stratum).eqNullSafe(F.col("of_stratum")), "left")
    rejected = F.coalesce(score(levels(rules), F.col("learned")) > F.col("step"), F.lit(False))
    return joined.select(*stats.columns, fails.alias("base_failed"), (~fails & ~rejected).alias("kept"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits) -> DataFrame:
    """The rows of docs that the rules keep. The statistics are written once, beside the columns of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col(stratum).alias("stratum_of"), "text")
    stats = written(with_stats(rows), "rules")
    chosen = certified_steps(stats, labels, "stratum_of", **limits)
    return judged(stats, chosen, "stratum_of").where("kept").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = written(with_stats(docs.select("doc_id", "lang", "text")), "rules")
    out = judged(stats, certified_steps(stats, labels))
    return out.select("doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


_COUNT = "length(text) - length(regexp_replace(text, '{}', '', 'g'))"
_LEVELS = ", ".join(f"len(list_filter([{', '.join(f'{c}::DOUBLE' for c in r.cutoffs)}], lambda c: {r.over} > c))" for r in RULES)
_PLACES = ", ".join(
    f"coalesce(list_min(list_filter([{', '.join(f'CASE WHEN count(*) FILTER (WHERE learning AND found[{i + 1}] > {j}) <= count(*) FILTER (WHERE learning) * {RISK / (2 * len(RULES))!r}::DOUBLE THEN {j} END' for j in range(len(r.cutoffs)))}], lambda x: x IS NOT NULL)), {len(r.cutoffs)})"
    for i, r in enumerate(RULES)
)
_SCORE = "list_max(list_filter(list_transform(list_zip(found, learned), lambda z: CASE WHEN z[1] > 0 THEN z[1] - z[2] END), lambda x: x IS NOT NULL))"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
w AS (SELECT rn, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM p),
g AS (SELECT rn, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rn ORDER BY i)),
t AS (SELECT rn, i FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rn, gram) > 1),
c AS (SELECT rn, count(DISTINCT i + k) AS n FROM t, range(5) r(k) GROUP BY rn),
s AS (SELECT p.rn, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  {_COUNT.format('[#*$%&|<>]')} AS n_symbols, {_COUNT.format('[!?]')} AS n_bangs, {_COUNT.format('[0-9]')} AS n_digits, {_COUNT.format(chr(92) + 'p{Lu}')} AS n_upper, coalesce(c.n, 0) AS n_repeat_words FROM p LEFT JOIN c ON c.rn = p.rn),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{_LEVELS}] AS found FROM s),
l AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
h AS (SELECT lang, md5(doc_id::VARCHAR)[1] < '5' AS learning, found FROM f JOIN l USING (doc_id) WHERE NOT base_failed),
e AS (SELECT lang, [{_PLACES}] AS learned FROM h GROUP BY lang),
b AS (SELECT h.lang, learned, {_SCORE} AS score FROM h JOIN e ON e.lang IS NOT DISTINCT FROM h.lang WHERE NOT learning),
n AS (SELECT b.lang, any_value(learned) AS learned, step, count(*) AS n, count(*) FILTER (WHERE score > step) AS k, count(*) OVER (PARTITION BY step) AS strata FROM b, (SELECT unnest({list(STEPS)}) AS step) GROUP BY b.lang, step),
v AS (SELECT lang, any_value(learned) AS learned, min(step) FILTER (WHERE k / n <= {RISK}::DOUBLE AND k < n AND
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}::DOUBLE) + (n - j) * ln({1 - RISK!r}::DOUBLE)))) <= {DELTA}::DOUBLE / strata) AS step FROM n GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_SCORE} > step, false) AS kept FROM f LEFT JOIN v ON v.lang IS NOT DISTINCT FROM f.lang
"""
