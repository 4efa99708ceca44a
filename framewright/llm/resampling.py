"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are all runs of one and of two words, hashed into ``BUCKETS`` buckets. A bucket's gain is the logarithm
of its share in the target texts over its share in the corpus; a document's weight is the mean gain of its features. A draw
without replacement takes the documents with the highest weight plus Gumbel noise, which a hash of the doc_id gives.

Scoring explodes nothing: higher-order functions make a document's array of buckets and add up the entries of a literal
array of gains. Counting sends a number for each bucket and task; the gains come to the driver, ``BUCKETS`` numbers at any
size. The order of the draw is a range-partitioned sort of the scores: a row's rank is its place in its part, from
monotonically_increasing_id(), and the sizes of the parts before it. The scores are written first, so that the texts
are read twice only, for the counts and for the scores.

Defined results: null and empty texts have no features and weight 0; a word is split by ASCII other than letters and digits only,
so any other character is part of a word; each row is a document, so repeated rows are drawn one by one; ties go to the
smaller doc_id, null first, then to more features, then to the larger weight, and what is equal in all is interchangeable; the
noise of a null doc_id is that of an empty one; an empty corpus or target counts as all zeros; no documents draw none;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_or_empty, written

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Only A-Z are lower-cased; where all characters are ASCII, lower() does that and is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def hashes_of(words: Column) -> Column:
    """array<bigint>: the hash of each word and of each pair of neighbours."""
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.crc32(F.concat(F.get(words, i), F.lit(" "), w)))
    return F.flatten(F.array(F.transform(words, lambda w: F.crc32(w)), pairs))


def buckets_of(words: Column) -> Column:
    """array<bigint>: the bucket of each feature."""
    return F.transform(hashes_of(words), lambda h: h % BUCKETS)


def _counts(docs: DataFrame) -> DataFrame:
    """bucket, count. Each word comes as a row with its successor, so that both hashes are made in generated code."""
    words = docs.select(words_of(text_or_empty()).alias("words"))
    pairs = words.select(F.inline(F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.size("words")).alias("v"))).alias("w", "v"))
    hashes = pairs.select(F.explode(F.array(F.crc32("w"), F.crc32(F.concat("w", F.lit(" "), "v")))).alias("hash")).where("hash is not null")
    return hashes.groupBy((F.col("hash") % BUCKETS).alias("bucket")).count()


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket: floor(1000 ln of its share in target over its share in docs), each count one more."""
    total = lambda name: F.sum(name).over(Window.partitionBy(F.lit(0)))  # noqa: E731  of BUCKETS rows
    found = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    found = found.join(_counts(docs).withColumnRenamed("count", "n"), "bucket", "left").join(_counts(target).withColumnRenamed("count", "m"), "bucket", "left")
    found = found.select("bucket", F.coalesce("n", F.lit(0)).alias("s"), F.coalesce("m", F.lit(0)).alias("t")).withColumns({"all_s": total("s"), "all_t": total("t")})
    ratio = ((F.col("t") + 1) * (F.col("all_s") + BUCKETS)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS)).cast("double")
    rows = found.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def weight(buckets: Column, of: list[int]) -> Column:
    """The floored mean gain, 0 without features."""
    gain = F.split(F.lit(" ".join(map(str, of))), " ").cast("array<bigint>")  # folded into one literal
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.element_at(gain, (b + 1).cast("int")))
    n = F.size(buckets)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", total - F.pmod(total, n), n))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    of = gains(docs.select("text"), target.select("text"))
    rows = docs.select("doc_id", words_of(text_or_empty()).alias("words"))
    rows = rows.select("doc_id", F.size("words").alias("n_words"), buckets_of(F.col("words")).alias("buckets"))
    made = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), of).alias("weight"))
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(scores: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores with rank: 1, 2, 3... for the share of the documents with enough words that is drawn, else null."""
    n_parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("n_features"), F.desc("weight")]
    able = F.col("n_words") >= min_words
    dealt = scores.where(able).withColumn("salt", F.rand(SEED)).repartitionByRange(n_parts, *order, "salt")  # splits repeated rows
    placed = written(dealt.drop("salt").sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1) + 1
    sizes = placed.groupBy(part.alias("part")).count()  # a row for each part
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count"))
    before = before.withColumn("take", F.call_function("div", F.sum("count").over(Window.partitionBy(F.lit(0))) * percent, F.lit(100)))
    ranks = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + place)
    ranks = ranks.select(*scores.columns, F.when(F.col("rank") <= F.col("take"), F.col("rank")).alias("rank"))
    return ranks.unionByName(scores.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    scores = written(scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "scores")
    return drawn(scores).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') FROM benchmark),
f AS (SELECT side, doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS feature FROM w),
bits AS (SELECT list(CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT] || [k::BIGINT FOR k IN range(7)], lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)],
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, bits),
n AS (SELECT side, doc_id, bucket, count(*) AS k FROM f JOIN b USING (feature) GROUP BY ALL),
c AS (SELECT r AS bucket, coalesce(sum(k) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(k) FILTER (WHERE side = 1), 0) AS t
  FROM (SELECT unnest(range(10000)) AS r) LEFT JOIN n ON n.bucket = r GROUP BY r),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS gain FROM c),
d AS (SELECT doc_id, sum(k)::BIGINT AS n_features, floor(sum(k * gain) / sum(k))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
e AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {MIN_WORDS}) AS able FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM r
"""
