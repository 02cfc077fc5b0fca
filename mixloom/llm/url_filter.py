"""Operator 8: URL verdicts by host and path rules, else by logistic regression on hashed character n-grams.

Scoring is one projection: the few thousand weights are a literal array in the plan, every row sums those of its
n-grams. Training takes the labelled table below (a bounded input) once: Spark hashes it by the same expressions, the
driver runs the gradient steps on that small matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.common import UPPER, table

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: (host, path, verdict), a longer rule before a shorter one.
RULES = (("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"))
#: Most labelled rows that training takes to the driver.
MOST_LABELLED = 5000
#: Labels by hand: words of hosts that are to be blocked, and of ordinary ones.
BAD = "casino-win free-bets cheap-pills adult-x spam-farm ads-track bet-now poker-cash xxx-cams porn-tube viagra-shop win-prizes payday-loans click-ads sexy-chat spam-links pills-online track-pixel".split()
GOOD = "library news-daily city-council weather garden-club physics-forum recipes museum history open-data school-board travel-notes music-review bird-watch chess-club parish-council cycling river-trust".split()
#: The commonest letter pairs of English: made into further ordinary host names, as most hosts are ordinary.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label; 1 is to be blocked): every host word with each prefix and language path."""
    rows = []
    made = [a + b + PAIRS[(7 * i + 3 * j) % len(PAIRS)] * (j % 2) for i, a in enumerate(PAIRS) for j, b in enumerate(PAIRS[i % 7 :: 9])]
    for label, names in ((1, BAD), (0, GOOD + made)):
        for i, name in enumerate(names):
            for j, front in enumerate(("", "www.", "m.", "blog.")):
                zone, lang = ("com", "net", "org")[(i + j) % 3], ("en", "de", "fr", "es")[(i * 3 + j) % 4]
                rows.append((f"https://{front}{name}.example.{zone}/{lang}/{1000 + 37 * i + j}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(part: str, c: Column, n: int) -> Column:
    """Buckets of the n-grams of c between marks; both parts hash apart."""
    s = F.concat(F.lit("^"), c, F.lit("$"))
    starts = F.when(F.char_length(s) >= n, F.sequence(F.lit(1), F.char_length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.substr(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def features(h: Column, p: Column) -> Column:
    """Distinct buckets of the 3-, 4- and 5-grams of host and path; digits count as one character."""
    digits = lambda c: F.translate(c, "123456789", "000000000")
    return F.array_distinct(F.flatten(F.array(*(_grams(part, digits(c), n) for part, c in (("h", h), ("p", p)) for n in GRAMS))))


def train(labelled: DataFrame, steps: int = 300, rate: float = 0.5, penalty: float = 1e-4) -> tuple[list[float], float]:
    """(weights, bias) of a logistic regression with an L2 penalty; labelled has url and label, MOST_LABELLED rows at most.

    Rows without a label are left out; a null url counts as one with empty host and path. Both classes weigh the same.
    """
    rows = labelled.where("label is not null").select(features(host(F.col("url")), path(F.col("url"))).alias("x"), "label").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    data = sorted((sorted(r.x), int(r.label)) for r in rows)
    w, bias = np.zeros(BUCKETS), 0.0
    if not data:
        return w.tolist(), bias
    size = np.array([len(x) for x, _ in data])
    at, row = np.array([i for x, _ in data for i in x], np.int64), np.repeat(np.arange(len(data)), size)
    y, norm = np.array([float(y) for _, y in data]), 1 / np.sqrt(np.maximum(size, 1))
    weight = len(y) / 2 / np.maximum(1, np.where(y > 0, y.sum(), len(y) - y.sum()))
    for _ in range(steps):
        z = bias + norm * np.bincount(row, w[at], len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) * weight / len(y)
        grad = np.bincount(at, (e * norm)[row], BUCKETS)
        bias -= rate * float(e.sum())
        w -= rate * 20 * (grad + penalty * w)
    return w.tolist(), bias


def judge(pages: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """pages with host, path, rule (null if none fits), score (probability of block) and verdict.

    A null url or one without :// has an empty host and path; no rule fits it and its n-grams decide. Repeated rows each
    get the same result; no rows give no rows.
    """
    table_of = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    out = pages.select(F.struct(*pages.columns).alias("_row"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    fits = [((F.col("_host") == h) | F.endswith(F.col("_host"), F.lit("." + h))) & F.startswith(F.col("_path"), F.lit(p)) for h, p, _ in RULES]
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (h, p, v) in reversed(list(zip(fits, RULES, strict=True))):
        rule, said = F.when(fit, F.lit(h + p)).otherwise(rule), F.when(fit, F.lit(v)).otherwise(said)
    total = F.transform(F.array(features(F.col("_host"), F.col("_path"))), lambda x: F.aggregate(x, F.lit(0.0), lambda a, i: a + table_of[i]) / F.sqrt(F.greatest(F.size(x), F.lit(1))))[0]
    out = out.withColumn("_score", 1 / (1 + F.exp(-(total + F.lit(bias)))))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.col("_score").alias("score"), F.coalesce(said, F.when(F.col("_score") >= 0.5, "block").otherwise("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bias = train(labelled_urls(spark))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), weights, bias).select("page_id", "host", "path", "rule", "verdict")
