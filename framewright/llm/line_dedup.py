"""Line dedup: hashes range-partitioned with a secondary sort, first occurrences streamed, bitmaps returned.

A line's key is the line without white space at both ends and with A-Z lower-cased. A key of at least
``min_chars`` code points that at least ``min_docs`` documents hold keeps its lines only in the largest doc_id
that holds it.

Defined results: null and empty texts are one empty line; rows with a null doc_id neither count nor lose lines;
rows that share a doc_id are one document for counting, and each is filtered by its own text; empty tables give
empty results; other columns, whatever their names, pass through ``apply_keep`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, table, text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least number of ways in which the lines of one hash are dealt out, by document. There are as many as shuffle
#: partitions if those are more, so that a part of a hot hash is never above an even share of the rows.
SALTS = 32


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2: 96 bits of the key. tag tells apart the texts of rows that share a doc_id."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64(text_or_empty()).alias("tag"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line")
    )
    bare = F.btrim("line", F.lit(SPACES))  # as long as its key
    salts = max(SALTS, _partitions(docs))
    keys = lines.where(F.length(bare) >= min_chars).select("doc_id", "tag", "pos", line_key(F.col("line")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt"), "doc_id", "tag", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, tag, words: for each document that loses lines, the 64-line words of its keep bitmap that hold a
    zero, as array<struct<word, bits>>. A word that is absent keeps all its lines, and so does a document."""
    group, part = ["h1", "h2"], ["h1", "h2", "salt"]
    seen = written(_occurrences(docs, min_chars), "lines")  # hashes only; the texts are split and hashed once
    by_part = seen.groupBy(*part).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    heavy = by_part.groupBy(*group).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")).where(F.col("n_docs") >= min_docs)
    # One head row for each part of a heavy hash: it comes first in the sort and tells the stream what to keep.
    heads = by_part.select(*part).join(heavy.select(*group, "last_doc"), group).select(*part, F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("tag"), F.lit(-1).alias("pos"), "last_doc")
    rows = heads.unionByName(seen.withColumn("last_doc", F.lit(None).cast(seen.schema["doc_id"].dataType)))
    dealt = rows.repartitionByRange(_partitions(docs), *part)
    stream = Window.partitionBy(*part).orderBy(F.col("pos") >= 0, F.desc("doc_id"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    lost = dealt.withColumn("kept_in", F.first("last_doc", ignorenulls=True).over(stream)).where((F.col("pos") >= 0) & (F.col("doc_id") < F.col("kept_in")))
    words = lost.groupBy("doc_id", "tag", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("zeros"))
    return words.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("zeros").alias("bits")))).alias("words"))


def lost_positions(words: Column) -> Column:
    """The positions at which a keep bitmap holds zeros, ascending; null bitmaps hold none."""
    return F.coalesce(
        F.flatten(
            F.transform(
                words,
                lambda w: F.transform(
                    F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0),
                    lambda b: (w["word"] * 64 + b).cast("int"),
                ),
            )
        ),
        F.array().cast("array<int>"),
    )


def filtered(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row: the columns of docs as a struct; n_lines, n_dropped; kept: the text that stays, never null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("tag", F.xxhash64(text_or_empty("row.text")))
    marks = bitmaps.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "words")
    joined = rows.join(marks, (F.col("row.doc_id") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    lines = joined.select("row", F.split(text_or_empty("row.text"), "\n").alias("lines"), lost_positions(F.col("words")).alias("lost"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.size("lost") == 0, text_or_empty("row.text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n"))
    return lines.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with their texts filtered; the columns are those of docs. Null texts stay null."""
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return filtered(docs, bitmaps).select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_keep(docs, keep_bitmaps(docs, min_chars, min_docs))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return filtered(docs, keep_bitmaps(docs)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < h.last_doc, false) AS lost FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
