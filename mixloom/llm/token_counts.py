"""Operator 3: token counts from pieces per distinct pre-token, without ids.

The splitter of the vocabulary never looks across a pre-token, so a text has as many tokens as its pre-tokens have
pieces. Texts are cut into pre-tokens, and the frequencies of a step's pre-tokens are dealt out by pre-token. There the
pieces of each distinct pre-token of the corpus are counted once and joined to its frequencies in all documents; what goes
back is a sum for each document of a step. Pre-tokens that stand in a hundredth of a step's documents or more are few in any
step and the same in most: each worker counts their pieces itself and keeps them, so no part holds a hot pre-token.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mixloom.llm.arrow import lean, steps
from mixloom.llm.common import MANY, batches_of, counted, small, table, written

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text of a step; bytes of text whose pre-tokens one part takes; share of a step's documents that makes a pre-token frequent.
STEP, PART, FREQUENT = 8_000_000, 64_000_000, 0.01
#: Frequent pre-tokens that a worker keeps; a full store starts anew.
MOST_KNOWN = 400_000
#: The splitter as the vocabulary file has it, with the white space of Latin text written out.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xA0\p{L}\p{N}]+")
#: Beyond these letters normal forms and lower case are left to the library.
BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")


class Counts:
    """Pre-tokens of texts and their pieces. Kind 0 is what our splitter finds, kind 1 what the library's own does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.is_last = np.zeros(t.get_vocab_size() + 1, bool)
        mark = t.model.end_of_word_suffix or ""
        self.is_last[[i for w, i in t.get_vocab().items() if w.endswith(mark)]] = True
        self.normal, self.split, self.model = t.normalizer, t.pre_tokenizer, t.model

    def cut(self, text: str) -> tuple[list[str], list[str], int]:
        """The pre-tokens of either kind, and the number of special strings."""
        segments, found = [text], 0
        if self.special and "<|" in text:
            segments = self.special.split(text)
            found = len(segments) - 1
        own: list[str] = []
        other: list[str] = []
        for s in segments:
            if s.isascii() or not BEYOND_LATIN.search(s):
                own += PRE_TOKEN.findall(s.lower())
            else:
                other += (x for x, _ in self.split.pre_tokenize_str(self.normal.normalize_str(s)))
        return own, other, found

    def pieces(self, words: list[str], kind: int) -> list[int]:
        """The number of pieces of each pre-token; those of our splitter many in one call of the library."""
        if kind:
            return [len(self.model.tokenize(w)) for w in words]
        out: list[int] = []
        groups = [words[i : i + 4096] for i in range(0, len(words), 4096)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            last = np.flatnonzero(self.is_last[e.ids])  # the last piece of a pre-token bears the word-end mark
            if len(last) != len(group):
                raise AssertionError("pre-tokens and word ends differ")
            out += np.diff(last, prepend=-1).tolist()
        return out

    def kept(self, words: list[str], kind: int) -> list[int]:
        """pieces(), from the worker's store where it has them."""
        known = self.known[kind]
        if len(known) + len(words) > MOST_KNOWN:
            known.clear()
        new = [w for w in words if w not in known]
        known.update(zip(new, self.pieces(new, kind), strict=True))
        return [known[w] for w in words]

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text, all in this worker."""
        words, docs, n, per, sums = self.frequencies(texts)
        size = np.array([p for k in (0, 1) for p in self.pieces(words[k], k)], np.int64)
        np.add.at(sums, docs, n * np.repeat(size, per))
        return sums.tolist()

    def frequencies(self, texts: list[bytes]):
        """Distinct pre-tokens by kind; for each in turn its documents and counts, how many those are; special strings by document."""
        number: tuple[defaultdict, defaultdict] = tuple(defaultdict(count().__next__) for _ in range(2))
        seen: list[list[np.ndarray]] = [[], []]
        sums = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            *cut, sums[i] = self.cut(t.decode())
            for k in (0, 1):
                seen[k].append(np.fromiter(map(number[k].__getitem__, cut[k]), np.int64, len(cut[k])))
        first = len(number[0])
        at = np.concatenate([*seen[0], *(x + first for x in seen[1])]) if texts else np.zeros(0, np.int64)
        doc = np.concatenate([np.repeat(np.arange(len(texts)), [len(x) for x in s]) for s in seen]) if texts else at
        key, n = np.unique(at * max(1, len(texts)) + doc, return_counts=True)
        word, doc = key // max(1, len(texts)), key % max(1, len(texts))
        return [list(number[0]), list(number[1])], doc, n, np.bincount(word, minlength=first + len(number[1])), sums


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin..begin + size of each entry, one after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def text_counts(docs: DataFrame, path: str) -> DataFrame:
    """(_k1, _k2, n_tokens) of each distinct text; the keys are 128 bits of hashes of the text."""
    spark = docs.sparkSession
    batches_of(spark, MANY)
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    empty = {"step": pa.string(), "words": pa.binary(), "lens": pa.binary(), "per": pa.binary(), "doc": pa.binary(), "n": pa.binary(), "about": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = counts(path), count()
        for batch, texts in steps(batches, most=STEP):
            step = f"{TaskContext.get().partitionId()}-{next(name)}"
            words, doc, n, per, sums = own.frequencies(texts)
            begin, kinds = np.cumsum(per) - per, np.repeat([0, 1], [len(words[0]), len(words[1])])
            often = per >= max(2.0, FREQUENT * len(texts))
            known = np.zeros(len(per), np.int64)
            for k in (0, 1):
                at = np.flatnonzero(often & (kinds == k))
                known[at] = own.kept([words[k][i - k * len(words[0])] for i in at.tolist()], k)
            at = _ranges(begin[often], per[often])
            np.add.at(sums, doc[at], n[at] * np.repeat(known[often], per[often]))
            about = batch.column("_k1").to_numpy().tobytes() + batch.column("_k2").to_numpy().tobytes() + sums.tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([zlib.crc32(step.encode()) % parts], pa.int64()), **{c: pa.array([{"step": step, "about": about}.get(c)], t) for c, t in empty.items()}})
            rest = np.flatnonzero(~often)
            if not len(rest):
                continue
            spelled = [b"01"[kinds[i] : kinds[i] + 1] + words[kinds[i]][i - kinds[i] * len(words[0])].encode() for i in rest.tolist()]
            to = np.fromiter(map(zlib.crc32, spelled), np.int64, len(rest)) % parts
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            cols: dict[str, list] = {c: [] for c in ("words", "lens", "per", "doc", "n")}
            for some in np.split(order, cuts[1:]):
                w = [spelled[i] for i in some.tolist()]
                p = per[rest[some]]
                at = _ranges(begin[rest[some]], p)
                for c, v in zip(cols, (b"".join(w), np.fromiter(map(len, w), np.uint32, len(w)).tobytes(), p.astype(np.uint32).tobytes(), doc[at].astype(np.uint32 if len(texts) > 65535 else np.uint16).tobytes(), n[at].astype(np.uint32).tobytes() if n[at].max() > 255 else n[at].astype(np.uint8).tobytes()), strict=True):
                    cols[c].append(v)
            yield pa.RecordBatch.from_pydict({"part": pa.array(to[order][cuts], pa.int64()), "step": pa.array([step] * len(cuts)), **{c: pa.array(v, pa.binary()) for c, v in cols.items()}, "about": pa.nulls(len(cuts), pa.binary())})

    def join(group: pa.Table) -> pa.Table:
        own = counts(path)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        rows, abouts = [], []
        for r in group.select([*empty]).to_pylist():
            if r["about"] is not None:
                abouts.append((r["step"], r["about"]))
                continue
            ends = np.cumsum(np.frombuffer(r["lens"], np.uint32).astype(np.int64)).tolist()
            w, a = r["words"], [0, *ends[:-1]]
            which = np.fromiter((number[w[i:j]] for i, j in zip(a, ends, strict=True)), np.int64, len(ends))
            per = np.frombuffer(r["per"], np.uint32)
            m = int(per.sum())
            rows.append((r["step"], np.repeat(which, per), np.frombuffer(r["doc"], np.uint16 if len(r["doc"]) == 2 * m else np.uint32), np.frombuffer(r["n"], np.uint8 if len(r["n"]) == m else np.uint32)))
        size = np.zeros(len(number), np.int64)
        for kind in (0, 1):
            at = [(i, w[1:].decode()) for w, i in number.items() if w[0] == 48 + kind]
            size[[i for i, _ in at]] = own.pieces([w for _, w in at], kind)
        out = []
        for step, which, doc, n in rows:
            sums = np.bincount(doc, n * size[which].astype(np.float64)).astype(np.int64)
            at = np.flatnonzero(sums)
            out.append((step, at.astype(np.uint32).tobytes(), sums[at].astype(np.uint32).tobytes() if len(at) and sums.max() < 2**32 else sums[at].tobytes(), None))
        out += [(s, None, None, a) for s, a in abouts]
        return pa.table({c: pa.array([x[i] for x in out], pa.string() if i == 0 else pa.binary()) for i, c in enumerate(("step", "doc", "sum", "about"))})

    def finish(group: pa.Table) -> pa.Table:
        rows = group.select(["doc", "sum", "about"]).to_pylist()
        about = np.frombuffer(next(r["about"] for r in rows if r["about"] is not None), np.int64)
        n = len(about) // 3
        sums = about[2 * n :].copy()
        for r in rows:
            if r["about"] is None and r["doc"]:
                at = np.frombuffer(r["doc"], np.uint32)
                sums[at] += np.frombuffer(r["sum"], np.uint32 if len(r["sum"]) == 4 * len(at) else np.int64)
        return pa.table({"_k1": about[:n], "_k2": about[n : 2 * n], "n_tokens": sums})

    dealt = docs.where(F.octet_length("text") > 0).select(*text_keys(), "text").mapInArrow(lean(deal), "part bigint, step string, words binary, lens binary, per binary, doc binary, n binary, about binary")
    joined = dealt.groupBy("part").applyInArrow(lean(join), "step string, doc binary, sum binary, about binary")
    return joined.groupBy("step").applyInArrow(lean(finish), "_k1 bigint, _k2 bigint, n_tokens bigint").groupBy("_k1", "_k2").agg(F.max("n_tokens").alias("n_tokens"))


def text_keys():
    return [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Whole texts, as the library counts them without added tokens; a special string inside a text is one token. A null
    text counts as empty. Equal texts have one count, which every row of them gets; columns named as the new ones are
    replaced. No documents give no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    found = written(text_counts(docs.select("text"), path), "tokens")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *text_keys(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.join(small(found, counted(found)), ["_k1", "_k2"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
