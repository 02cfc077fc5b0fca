"""Operator 10: toxicity of texts restored by a noisy-channel decoder.

Spans that look disguised (leetspeak, letters spaced out, letters repeated) become lattices: arcs for the letters that a
sign may stand for, for one or two of a repeated letter, and for a gap that is a gap or is none. Viterbi picks the
likeliest reading under a character trigram model counted over all documents, in time that grows with the span's length,
so no span is too long. A logistic regression on words and word beginnings of the restored text gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.arrow import joined, lean, steps
from mixloom.llm.common import FEW, batches_of, table, written
from mixloom.llm.quality import labelled_sample, logistic

#: Labelled training rows of each class at most, features kept at most, and how many rows must hold a feature.
SAMPLE, MOST_FEATURES, LEAST_ROWS = 3000, 4000, 4
#: Bytes of text that a worker takes at a time; tokens and spans whose features and readings it keeps (a full store starts anew).
STEP, MOST_SEEN = 2_000_000, 100_000
#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: log-probability that a writer disguises a letter or repeats one; and among letters that stand one by one, that a gap is none, or one.
DISGUISED, REPEATED, NO_GAP, GAP = math.log(0.05), math.log(0.02), math.log(0.7), math.log(0.3)

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~][^\W_]){2,}(?![^\W_])")
_LEETED = re.compile(r"[^\W\d_][0-9@$!|+(€*]+[^\W\d_]|^[0-9@$!|+(€]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+€]+$")
_LONG = re.compile(r"([^\W\d_])\1\1")
_PIECE = re.compile(r"(?:[^\W_]|[@$!|+(€*])+")
_RUN = re.compile(r"(.)\1*", re.DOTALL)
_SUSPECT = re.compile(r"[0-9@$!|+(€*]|([^\W\d_])\1\1")
_CODE = np.full(256, 27, np.int64)
for _i in range(256):
    if chr(_i).isascii():
        _CODE[_i] = ord(chr(_i).lower()) - 96 if chr(_i).isalpha() else 0


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before) over a-z, other letters and word ends, counted over all documents; 28 * 28 * 28 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(28**3, np.int64)
        for _, texts in steps(batches, most=STEP):
            _, arr, _, _ = joined(texts, b"  ")
            c = _CODE[arr].astype(np.int32)
            total += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    cells = docs.select("text").mapInArrow(lean(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 28**3 rows
    n = np.full(28**3, 0.1)
    n[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    n = n.reshape(28, 28, 28)
    return np.log(n / n.sum(axis=2, keepdims=True))


class Decoder:
    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()
        self.known: dict[str, str] = {}

    def _arcs(self, span: str, gaps: bool):
        """What each sign of the span may stand for, with its cost. With gaps, every second sign is a gap."""
        if gaps:
            for k, c in enumerate(span.lower()):
                if k % 2:
                    yield [("", NO_GAP), (" ", GAP)]
                else:
                    yield [(x, DISGUISED) for x in LEET[c]] if c in LEET else [(c, 0.0)]
            return
        for m in _RUN.finditer(span.lower()):
            c, n = m[1], len(m[0])
            if c.isalpha():
                yield [(c * n, 0.0)] if n < 3 else [(c, REPEATED), (c * 2, REPEATED)]
            elif c in LEET:
                yield [(x * k, DISGUISED) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))]
            else:
                yield [("", DISGUISED)]

    def restore(self, span: str, gaps: bool = False) -> str:
        """The likeliest text behind a span, by Viterbi over its last two letters."""
        if (out := self.known.get(span)) is not None:
            return out
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self._arcs(span, gaps):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score + cost
                    for letter in letters:
                        z = _code(letter)
                        s += self.logs[x][y][z]
                        x, y = y, z
                    if (x, y) not in step or step[x, y][0] < s:
                        step[x, y] = (s, (path, letters))
            states = step
        last = max(states, key=lambda ab: (states[ab][0] + self.logs[ab[0]][ab[1]][0], ab))
        path = states[last][1]
        letters = []
        while path:
            path, part = path
            letters.append(part)
        out = "".join(reversed(letters))
        if len(span) <= 64:
            if len(self.known) > MOST_SEEN:
                self.known.clear()
            self.known[span] = out
        return out

    def _piece(self, m: re.Match) -> str:
        t = m[0].strip("!(")
        return self.restore(t) if len(t) > 2 and (_LEETED.search(t) or _LONG.search(t)) else m[0]

    def _token(self, t: str) -> str:
        return _PIECE.sub(self._piece, t) if _SUSPECT.search(t) else t

    def _ungapped(self, text: str) -> tuple[str, list[str]]:
        """The text with letters that stand one by one read back; and what follows a first a or I of those, which may be a word."""
        beside: list[str] = []

        def put(m: re.Match) -> str:
            r = self.restore(m[0], True)
            if r[:1] in ("a", "i"):
                beside.append(r[1:])
            return r

        return _SPACED.sub(put, text), beside

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens of the text and of what may stand beside them, gaps read back; words() has their words."""
        text, beside = self._ungapped(text)
        return set(text.split()).union(*(r.split() for r in beside))

    def words(self, token: str) -> list[str]:
        """Lower-case words of a token, its disguised pieces read back; no word crosses white space, so tokens stand for themselves."""
        return _WORD.findall(self._token(token).lower())

    def restored(self, text: str) -> str:
        """The text with its disguised spans read back; tokens of any length, piece by piece between marks."""
        text = self._ungapped(text)[0]
        return " ".join([self._token(t) for t in text.split()]) if _SUSPECT.search(text) else text

    def readings(self, text: str) -> list[str]:
        """Lower-case words of the restored text; of letters that stand one by one also what follows a first a or I, which may be a word."""
        beside = self._ungapped(text)[1]
        return _WORD.findall(" ".join([self.restored(text), *beside]).lower())


def words_of(text: str, decoder: Decoder) -> set[str]:
    """Distinct lower-case words of the restored text."""
    return {w for t in decoder.tokens(text) for w in decoder.words(t)}


def features_of(word: str) -> tuple[str, ...]:
    return (word, f"^{word[:4]}", f"^{word[:5]}", f"^{word[:6]}") if len(word) > 3 else (word,)


@dataclass
class Model:
    logs: np.ndarray
    weights: dict[str, float]
    bias: float
    decoder: Decoder | None = None
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"decoder": None, "seen": {}}

    def score(self, text: str) -> float:
        self.decoder = self.decoder or Decoder(self.logs)
        hit: set[str] = set()
        seen, weights = self.seen, self.weights
        for t in self.decoder.tokens(text):
            f = seen.get(t)
            if f is None:
                f = tuple({x for w in self.decoder.words(t) for x in features_of(w) if x in weights})
                if len(t) <= 64:
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen[t] = f
            if f:
                hit.update(f)
        z = self.bias + sum(weights[f] for f in sorted(hit))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Fits on at most per_class labelled documents of either class, one for each doc_id (see labelled_sample).

    Without both classes every text scores low.
    """
    batches_of(docs.sparkSession, FEW)
    logs = character_model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(logs)
        for batch, texts in steps(batches, most=STEP):
            found = [sorted({f for w in words_of(t.decode(), decoder) for f in features_of(w)}) for t in texts]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "f": pa.array(found, pa.list_(pa.string())), "doc_id": batch.column("doc_id").cast(pa.string())})

    rows = labelled_sample(docs, learnable(labels), "toxic", per_class).mapInArrow(lean(run), "y int, f array<string>, doc_id string")
    rows = written(rows, "toxic")
    # features by how much more often than by chance they go with label 1: a bounded list
    held = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    totals = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    pos, n = int(totals[0] or 0), int(totals[1])
    if not 0 < pos < n:
        return Model(logs, {}, -10.0)
    lift = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1))
    top = held.orderBy((F.abs(lift) * F.sqrt("n")).desc(), "f").limit(MOST_FEATURES)
    names = sorted(top.select("f").toArrow()["f"].to_pylist())
    picked = rows.select("doc_id", "y", F.array_intersect("f", F.split(F.lit("\n".join(names)), "\n")).alias("f"))
    got = picked.toArrow().combine_chunks()  # at most 2 * per_class rows
    found = got["f"].combine_chunks()
    number = pc.index_in(found.flatten(), value_set=pa.array(names, pa.string())).to_numpy().astype(">u4")
    ends = np.cumsum(pc.list_value_length(found).to_numpy())
    has = np.split(number, ends[:-1])
    ids = got["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], has[i].tobytes()))
    x = np.zeros((len(ids), len(names)), np.float32)
    for to, i in enumerate(order):
        x[to, has[i].astype(np.int64)] = 1
    w, b = logistic(x, got["y"].to_numpy()[order].astype(np.float32), 3e-4, 400, 0.05)
    return Model(logs, {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, b)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher is likelier toxic) and predicted (1 from 0.5 on).

    A null or empty text has no words, so its score is that of the bias alone. Rows stand for themselves; columns named
    as the new ones are replaced.
    """
    batches_of(docs.sparkSession, FEW)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, most=STEP):
            s = [model.score(t.decode()) for t in texts]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in s], pa.int32())})

    return docs.mapInArrow(lean(run), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
