"""Shared helpers of the corpus operators: tables, row keys, scratch tables, A-Z lower-casing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TABLES: list[str] = []
#: Rows of an Arrow batch: few for operators that work text by text, so that a worker holds some megabytes; Spark's own number for
#: those that gain from seeing many texts at a time.
FEW, MANY = 2000, 10_000


def batches_of(spark: SparkSession, rows: int) -> None:
    """Sets the session's rows of an Arrow batch for what runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one under a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "mixloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mixloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and has Spark drop the shuffles behind them."""
    jvm = tables[0].sparkSession._jvm
    for df in tables:
        at = jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        _TABLES.remove(df._written_to)
    jvm.System.gc()  # shuffles go when the driver's references to them do


def clear(spark: SparkSession) -> int:
    """Deletes the tables that operators have written from this process; only for when no result of theirs is read any more."""
    jvm, n = spark._jvm, len(_TABLES)
    for path in _TABLES:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES.clear()
    return n


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else untouched. lower() does that by itself where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def row_keys(*cols: str) -> list[Column]:
    """A 128-bit key of a row's values; rows that agree in them share it, which is what every use here wants."""
    return [F.xxhash64(*cols).alias("_r1"), F.xxhash64(F.lit(1), *cols).alias("_r2")]


#: Bytes of a table, as counted from its rows, up to which it is broadcast.
BROADCAST_BYTES = 32_000_000


def counted(df: DataFrame, text: str | None = None, each: int = 64) -> int:
    """Bytes that a written table takes in memory at most: `each` a row, and those of its text column (or of an array's items)."""
    size = F.lit(0)
    if text:
        size = 16 * F.size(text) if df.schema[text].dataType.typeName() == "array" else F.octet_length(text)
    return int(df.agg(F.sum(size.cast("long") + each)).first()[0] or 0)


def small(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint if its counted bytes are within the bound, else df: Spark then shuffles."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
