"""Operator 2: BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts every text into chunks of some 256 bytes wherever the content says so, so texts that
share a passage share chunks. A worker encodes a chunk once and keeps the outcome in a bounded cache. A cut may fall
inside a word, where the pieces of the halves are not those of the whole: each join is repaired by encoding anew the
text from the last safe cut before it to the first safe cut after it. A safe cut is a change from a visible character to
white space, or from an ASCII letter to an ASCII mark. The tokenizer's splitter never looks left of where a match starts and no match runs over such a change, so
text encoded from one safe cut to another agrees exactly with the same span of the whole text's encoding; and
no special string of the vocabulary has white space, or a letter before a mark other than |, inside.

The texts are not shuffled: shipping each shared chunk's ids to every document that holds it would write more than
the texts themselves. So "once" is once for each task, as long as the chunk stays in its store.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from mixloom.llm.arrow import joined, lean, mixed, steps
from mixloom.llm.common import FEW, batches_of, table

VOCABULARY = "byte_bpe_50k.json"
ROLL, CUT_BITS = 16, 8
#: Entries of one generation of a worker's caches: chunks, and spans between neighbouring safe cuts.
MOST_CHUNKS, MOST_SPANS = 8_000, 70_000
#: Bytes of text that a worker encodes at a time; the spans and hashes of a step take some thirty times that.
STEP = 1_000_000

_GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
WHITE = frozenset(b" \t\n\x0b\x0c\r")
_WHITE = np.isin(np.arange(256), sorted(WHITE))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126])  # without |, which ends special strings
_VISIBLE = (np.arange(256) > 32) & (np.arange(256) < 127)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        letters = byte_alphabet()
        self.bytes_of = {i: added[i].encode() if i in added else bytes(letters[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.sizes[i] = len(b)
        # span or chunk -> its ids as decimals joined by commas; two generations each, the older goes when the younger is full
        self.spans: list[dict[bytes, bytes]] = [{}, {}]
        self.chunks: list[dict[bytes, bytes]] = [{}, {}]
        self.odd: dict[bytes, bytes] = {}  # spans whose decoding differs from them (none, for a vocabulary of all bytes)

    def forget(self) -> None:
        """Empties the stores, so that a worker that goes on to other work does not hold them."""
        self.spans, self.chunks = [{}, {}], [{}, {}]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, spans: set[bytes], into: dict[bytes, bytes]) -> None:
        """Encodes spans and decodes the ids once; those that start with white space many at a time, as the seams between them are safe cuts."""
        order = [s for s in spans if s[0] in WHITE and s[-1] > 32 and (s[-1] < 127 or 0xC3 <= s[-2] <= 0xDF)]
        alone = list(spans.difference(order))
        groups = [[s] for s in alone] + [order[i : i + 4096] for i in range(0, len(order), 4096)]
        for group, e in zip(groups, self.tokenizer.encode_batch([b"".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            if len(group) == 1:
                to = [len(ids)]
            else:
                at = np.cumsum(self.sizes[ids])
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
                to = np.searchsorted(at, ends) + 1
                if not np.array_equal(at[to - 1], ends):
                    raise AssertionError("a piece runs over a safe cut")
                to = to.tolist()
            a = 0
            for span, b in zip(group, to, strict=True):
                own = ids[a:b]
                into[span] = ",".join(map(self.decimal.__getitem__, own)).encode()
                if (back := self.decode(own)) != span:
                    self.odd[span] = back
                a = b

    @staticmethod
    def _aged(cache: list[dict], most: int) -> None:
        if len(cache[0]) > most:
            cache[:] = [{}, cache[0]]

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as decimals joined by commas, and the bytes that those decode to."""
        buf, arr, starts, ends = joined(texts, b"\0" * ROLL)
        gear = _GEAR[arr]
        roll = gear.copy()
        for k in range(1, ROLL):
            roll[k:] += gear[:-k] << np.uint32(k)
        cuts = np.flatnonzero(roll >> np.uint32(32 - CUT_BITS) == 0)
        before = np.roll(arr, 1)
        lead = np.roll(arr, 2)
        safe = np.flatnonzero(_LETTER[before] & _MARK[arr] | _WHITE[arr] & (_VISIBLE[before] | ((before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF))))
        lo, hi = np.searchsorted(safe, starts), np.searchsorted(safe, ends)
        cut_lo, cut_hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
        self._aged(self.spans, MOST_SPANS)
        self._aged(self.chunks, MOST_CHUNKS)
        young, old = self.spans
        plan, cells_of, missing = [], {}, set()
        ready: dict[bytes, bytes] = {}
        for n, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            parts: list[bytes] = []
            plan.append(parts)
            if s == e:
                continue
            at = [s, *safe[lo[n] : hi[n]].tolist(), e]
            i = 0
            for j in [*np.unique(np.searchsorted(at, cuts[cut_lo[n] : cut_hi[n]], "right") - 1).tolist(), len(at) - 1]:
                # at[i]..at[j] is the chunk between its safe cuts, at[j]..at[j + 1] the join to the next chunk
                for a, b in ((i, j), (j, min(j + 1, len(at) - 1))):
                    if a < b:
                        part = buf[at[a] : at[b]]
                        parts.append(part)
                        if part not in ready and part not in cells_of:
                            found = self.chunks[0].get(part) or self.chunks[1].get(part)
                            if found:
                                ready[part] = found
                            else:
                                cells_of[part] = cells = [buf[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                                missing.update(cells)
                i = j + 1
        for span in [x for x in missing if x not in young and x in old]:
            young[span] = old[span]
        self._learn({x for x in missing if x not in young}, young)
        look = young.__getitem__
        for part, cells in cells_of.items():
            ready[part] = b",".join(map(look, cells))
            if len(cells) > 1 and not self.odd:
                self.chunks[0][part] = ready[part]
        look = ready.__getitem__
        if not self.odd:
            return [(b",".join(map(look, parts)), b"".join(parts)) for parts in plan]
        back = {part: b"".join(self.odd.get(c, c) for c in cells) for part, cells in cells_of.items()}
        return [(b",".join(map(look, parts)), b"".join(back.get(p, p) for p in parts)) for parts in plan]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with n_tokens and, as asked, ids (array of int), ids_sha256 and decoded_sha256.

    text is encoded whole, as the tokenizer's library does with add_special_tokens=False (a special string in a text
    is that token). A null text counts as empty: no ids, digests of nothing. Each row stands for itself, so repeated
    rows and other columns don't matter; those named as the new ones are replaced.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    batches_of(docs.sparkSession, FEW)
    new = {"n_tokens": "bigint"} | ({"ids": "array<int>"} if ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    keep = [c for c in docs.columns if c not in new]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch, texts in steps(batches, most=STEP):
            cols = {c: batch.column(c) for c in keep}
            parts = own.encode(texts)
            cols["n_tokens"] = pa.array([x.count(b",") + 1 if x else 0 for x, _ in parts], pa.int64())
            if ids:
                cols["ids"] = pa.array([[int(i) for i in x.split(b",")] if x else [] for x, _ in parts], pa.list_(pa.int32()))
            if digests:
                cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x, _ in parts], pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(y.decode("utf-8", "replace").encode()).hexdigest() for _, y in parts], pa.string())
            yield pa.RecordBatch.from_pydict(cols)
        own.forget()

    return docs.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with text, the decoding of ids with special tokens kept; null ids give a null text, no ids an empty one."""
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in df.columns if c != "text"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())})

    return df.mapInArrow(lean(run), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
