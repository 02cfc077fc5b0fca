"""Operator 9: quality rules and a calibrated logistic regression on hashed word and character n-grams.

Training takes a bounded sample of labelled rows (SAMPLE of each class, those with the smallest hash of doc_id); their
hashed features, of fixed size whatever the texts' length, go to the driver. Scoring is one pass in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.arrow import _IS_BLANK, joined, lean, mixed, steps, word_hashes
from mixloom.llm.common import FEW, batches_of, table

#: Labelled rows of each class that training takes at most.
SAMPLE = 1500
#: Hash buckets of character 3-grams, and of words and word pairs.
BUCKETS = 4096
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of its shares of n-grams by bucket, characters first, then words."""
    _, arr, starts, ends = joined(texts, b"   ")
    c = arr.astype(np.uint32)
    grams = ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(15)) & np.uint32(BUCKETS - 1)
    begin, _, h = word_hashes(arr)
    w = (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    pair = (mixed(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    lo, hi = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    out = np.zeros((len(texts), 2 * BUCKETS), np.float32)
    for n, (s, e, a, b) in enumerate(zip(starts, ends, lo, hi, strict=True)):
        if e > s:
            out[n, :BUCKETS] = np.sqrt(np.bincount(grams[s - 1 : e - 1], minlength=BUCKETS) / (e - s))
        if b > a:
            out[n, BUCKETS:] = np.sqrt((np.bincount(w[a:b], minlength=BUCKETS) + np.bincount(pair[a : b - 1], minlength=BUCKETS)) / (2 * (b - a)))
    return out


def signals(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    _, arr, starts, ends = joined(texts, b" ")
    begin, _, h = word_hashes(arr)
    lo, hi = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    chars, symbols = total(~_IS_BLANK[arr] & ((arr & 0xC0) != 0x80)), total(_SYMBOL[arr])
    doc = np.repeat(np.arange(len(texts)), hi - lo).astype(np.uint64)
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = mixed(h[:-2] + mixed(h[1:-1] + mixed(h[2:] + doc[2:] * np.uint64(0x9E3779B97F4A7C15))))[inside]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[at + k] = True
        repeated = total(covered)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": hi - lo, "word_chars": chars[ends] - chars[starts], "n_symbols": symbols[ends] - symbols[starts], "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeated[hi] - repeated[lo]}


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration: probability = 1 / (1 + exp(-(slope * z + shift)))
    shift: float

    def probability(self, texts: list[bytes]) -> np.ndarray:
        out = [self.slope * (features(texts[i : i + 256]) @ self.weights + self.bias) + self.shift for i in range(0, len(texts), 256)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500))) if out else np.zeros(0)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps_: int = 300, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Nesterov's accelerated descent on the mean log loss with an L2 penalty; both classes weigh the same."""
    x = np.asarray(x, np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w.copy(), b
    for t in range(steps_):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        g = (1 / (1 + np.exp(-np.clip(x @ vw + vb, -500, 500))) - y).astype(np.float32) * share
        pw, pb = w, b
        w, b = vw - rate * (g @ x + penalty * vw), vb - rate * float(g.sum())
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to per_class labelled documents (doc_id, text, y) of either class: those with the smallest hash of doc_id.

    A doc_id whose labels disagree is left out. Of several documents of one doc_id the one with the smallest text counts,
    so there are 2 * per_class rows at most, and any order of the input gives the same ones.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("_y2")).where(F.col("y") == F.col("_y2")).select("doc_id", "y")
    parts = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    # at most 2 * per_class rows of two numbers: a proven bound
    found = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """A model from the sample; every fifth row by hash only calibrates. Without rows of both classes all is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            rows = [(np.flatnonzero(r), r[r > 0]) for r in (features([t])[0] for t in texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.string()), "y": batch.column("y"), "at": pa.array([r[0].astype(np.int16).tobytes() for r in rows], pa.binary()), "x": pa.array([r[1].astype(np.float16).tobytes() for r in rows], pa.binary())})

    batches_of(docs.sparkSession, FEW)
    sample = labelled_sample(docs, labels, "quality", per_class).mapInArrow(lean(run), "doc_id string, y int, at binary, x binary")  # at most 2 * per_class rows
    got = sorted(sample.toPandas().itertuples(index=False), key=lambda r: (r.doc_id, r.at))
    y = np.array([r.y for r in got], np.float32)
    if not len(got) or y.min() == y.max():
        return Model(np.zeros(2 * BUCKETS, np.float32), 0.0, 0.0, 10.0)
    x = np.zeros((len(got), 2 * BUCKETS), np.float32)
    for n, r in enumerate(got):
        x[n, np.frombuffer(r.at, np.int16)] = np.frombuffer(r.x, np.float16)
    part = np.arange(len(got)) % 5 == 0
    w, b = logistic(x[~part], y[~part], 1e-4)
    z = (x[part] @ w + b)[:, None]
    if y[part].min(initial=1) == y[part].max(initial=0):
        return Model(w, b, 1.0, 0.0)
    slope, shift = logistic(z / max(1e-6, np.abs(z).max()), y[part], 1e-5, 500)
    return Model(w, b, max(1e-6, float(slope[0]) / max(1e-6, float(np.abs(z).max()))), shift)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    A null text counts as one without words, which the base rules reject. Every row stands for itself; columns named as
    the new ones are replaced.
    """
    batches_of(docs.sparkSession, FEW)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c not in (*names, "base_failed", "probability", "kept")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} bigint" for n in names] + ["base_failed boolean, probability double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            s = signals(texts)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])
            p = model.probability(texts).astype(np.float64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {n: pa.array(s[n], pa.int64()) for n in names} | {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= THRESHOLD))})

    return docs.mapInArrow(lean(run), schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
