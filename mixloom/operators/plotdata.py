"""Tables that plots are drawn from: ranks and normal scores, labels, intervals, combined lists of results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of the order that are ranked on their own.
STRETCHES = 256


def ranked(df: DataFrame, by: str, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """df with each row's place in the order of a number, from 1, and n, the rows in all (nulls have no place).

    Without `within` the order is cut into stretches at quantiles, and places are counted in each, so no task sorts all rows.
    """
    rows = df.where(F.col(by).isNotNull())
    if within:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(by)).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*within)))
    cuts = sorted(set(rows.approxQuantile(by, [k / STRETCHES for k in range(1, STRETCHES)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").count().toPandas().sort_values("_part")  # at most STRETCHES rows
    before = np.cumsum(sizes["count"]) - sizes["count"]
    start = rows.sparkSession.createDataFrame([(int(p), int(b)) for p, b in zip(sizes["_part"], before, strict=True)], "_part int, _before bigint")
    out = rows.join(F.broadcast(start), "_part").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    return out.withColumn("n", F.lit(int(sizes["count"].sum()))).drop("_part", "_before")


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Normal quantiles: a closed first guess, then Newton steps."""
    from math import erfc

    s, x = 2 * p - 1, None
    a = 0.147
    ln = np.log1p(-s * s)
    t = 2 / (np.pi * a) + ln / 2
    x = np.sign(s) * np.sqrt(np.sqrt(t * t - ln / a) - t) * np.sqrt(2)
    cdf = np.vectorize(lambda v: 0.5 * erfc(-v / 2**0.5), otypes=[float])
    for _ in range(3):
        x = x - (cdf(x) - p) * np.sqrt(2 * np.pi) * np.exp(x * x / 2)
    return x


def normal_quantile(c: Column) -> Column:
    return F.pandas_udf(lambda p: pd.Series(_normal_quantile(p.to_numpy(float))), "double")(c)


def normal_scores(df: DataFrame, by: str, within: list[str] | None = None) -> DataFrame:
    """df in places by a number, with score, the normal quantile of (place - 0.5) / n."""
    return ranked(df, by, "rank", within).withColumn("score", normal_quantile((F.col("rank") - 0.5) / F.col("n")))


def residual_scores(model) -> DataFrame:
    """Scaled residuals against normal scores."""
    return normal_scores(model.fitted(), "scaled_resid")


def mode_scores(model) -> DataFrame:
    """Conditional modes by factor and effect against normal scores, with their limits."""
    return normal_scores(model.ranef_intervals(), "condval", ["grpvar", "term"])


def id_labels(df: DataFrame, *names: str, sep: str = "/") -> DataFrame:
    """df with label, the named columns joined."""
    return df.withColumn("label", F.concat_ws(sep, *(F.col(n).cast("string") for n in names)))


def coef_points(model) -> DataFrame:
    """coef() with ord, each level's place by its value within a term."""
    return model.coef().withColumn("ord", F.row_number().over(Window.partitionBy("term").orderBy("value", "grp")))


def fit_points(fits: DataFrame) -> DataFrame:
    """all_fit() by optimizer and parameter: what a plot of the optimizers' answers shows."""
    return fits.select("optimizer", "deviance", F.posexplode("theta").alias("parameter", "value"))


def attempt(f: Callable, *args, **options) -> dict:
    """value, messages and error of a call: warnings and errors are kept instead of raised."""
    import warnings

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        try:
            value, error = f(*args, **options), None
        except Exception as e:  # noqa: BLE001  kept for the caller
            value, error = None, f"{type(e).__name__}: {e}"
    return {"value": value, "messages": [str(w.message) for w in seen], "error": error}


def combined(parts: list[DataFrame], name: str = "part") -> DataFrame:
    """Tables one below the other with the number of each; columns that one lacks are null there."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn(name, F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
