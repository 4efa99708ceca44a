"""A corpus pipeline over documents, in five stages. Each works on all that its predecessor kept.

Defined results: null and empty texts have no words, so the quality rules reject them; rows with a null doc_id pass all stages
as documents of their own; of texts whose shingles are alike the one with the least doc_id stays, and rows that share a doc_id stay or
go together; texts of any length are taken whole; equal scores and lengths are ordered as the stages' own modules tell; an empty table gives an empty result. All stages but the
last return the columns of documents, n_chars being that of the text as it is then, and leave other columns out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import scratch, shared_dir, table
from framewright.llm.jaccard_join import one_of_each
from framewright.llm.line_dedup import dedup_lines
from framewright.llm.packing import pack_documents
from framewright.llm.quality_rules import apply_rules
from framewright.llm.secrets import redacted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars that of the text as it is now."""
    n = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return docs.withColumn("n_chars", n).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redacted(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Word shingles, a random field and a tokenizer are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # the stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
