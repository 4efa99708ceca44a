"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that the contracts call white space: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACES_CLASS = r"[ \t\n\x0B\f\r]"

#: Bits of the filter of wanted() (8 MB, whatever the size of the tables), and of one of its pages.
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where the session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
    return context.getCheckpointDir()


def wanted(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose column ``name`` may be one of ``keys``, to be joined with them afterwards. Each key sets one of
    FILTER_BITS bits by its hash: no wanted row is lost, and others pass with a chance of keys / FILTER_BITS at most. So
    a join that needs a few rows of a wide table shuffles these few; with more keys than bits it shuffles nearly all."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    page, bit = F.shiftright(at, PAGE_BITS.bit_length() - 1), at % PAGE_BITS
    bits = keys.select(page.alias("_of"), bit.alias("_bit")).repartition("_of")
    pages = bits.groupBy("_of").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumns({"_page": page, "_bit": bit.cast("int")}).join(F.broadcast(pages), F.col("_page") == F.col("_of"))
    is_set = "getbit(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as bigint), _bit % 8) = 1"
    return found.where(F.expr(is_set)).select(*rows.columns)


#: The folders that written() has made and scratch() may delete.
_made: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that written() made inside it. What is to stay must have been saved by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _deleted(spark, _made.pop())
