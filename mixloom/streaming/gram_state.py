"""Beyond the batch operators: grouped sums kept up over a stream. Sums merge, so a stream's state is one row a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_sums(df: DataFrame, y: str, x: str, g: str) -> DataFrame:
    """n, sx, sy, sxx, sxy, syy by group; works on static and streaming frames (output mode complete or update)."""
    a, b = F.expr(x).cast("double"), F.expr(y).cast("double")
    return df.groupBy(F.col(g).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))


def merge_sums(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of grouped sums as one."""
    cols = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    return one.unionByName(other).groupBy("grp").agg(*(F.sum(c).alias(c) for c in cols))
