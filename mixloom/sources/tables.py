"""Reading and writing tables by Spark's own readers; schemas of text files are stated, not inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",", decimal_comma: bool = False) -> DataFrame:
    """A delimited file with a header. With a decimal comma, double columns are read as text and converted."""
    if not decimal_comma:
        return spark.read.csv(path, header=True, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True)
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{f.name}` string" for f in want), sep=sep)
    return raw.select(*(F.regexp_replace(f.name, ",", ".").cast(f.dataType).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast(f.dataType) for f in want))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
