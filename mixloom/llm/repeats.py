"""Operator 7: bytes that an earlier 100-byte string covers, by prefix-free parsing.

Rolling-hash triggers parse every text: of each 69 consecutive 32-byte grams the one with the smallest hash is a
trigger, so every 100-byte string holds a trigger, and equal strings hold it at the same place. The phrase of a trigger
is all that 100-byte strings around it can reach: 68 bytes before it, 100 from it on, cut at the text's ends.

1. The parse is dealt out by trigger. Equal phrases of a trigger are one dictionary entry; every occurrence but the
   first (by doc_id, then place) repeats in full, so highly repetitive text costs one entry. Triggers with several
   phrases are put into a filter of fixed size.
2. The phrases of those triggers are sent once each. The dictionary's suffixes are put in order at each of the 69
   offsets; suffixes that agree in their first 100 bytes stand together there, and all but the first repeat. Order
   beyond equality is not needed, so suffixes are ordered by the hash of these bytes.

Phrases are compared by 64-bit hashes within a trigger's 64-bit hash, suffixes by their bytes. Texts are shuffled once,
to meet what is to be removed from them. Of equal phrases that a step of texts has, one is sent; the others repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.arrow import joined, lean, mixed, steps
from mixloom.llm.common import MANY, batches_of, table, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
BEFORE = SPAN - 1
WIDE = BEFORE + LENGTH
#: Bytes of text that a worker parses at a time; some twenty 64-bit numbers a byte are held meanwhile.
STEP = 2_000_000
#: log2 of the bits of the filter of triggers with several phrases; fuller, it only lets more phrases through.
FILTER_BITS = 26

_VALUE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[size] = (out[0], out[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive values, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


class Parse:
    """Triggers of a step of texts: t (hash of the gram), phrase (hash), doc (number), at (place in the text)."""

    def __init__(self, texts: list[bytes]):
        self.buf, self.arr, self.starts, self.ends = joined(texts, b"\0" * LENGTH)
        n = len(self.arr)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.arr] * up[:-1], out=total[1:])
        h = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        least = _slide(h, SPAN, np.minimum)[: max(0, n - LENGTH + 1)]
        # strings must lie within one text
        size = self.ends - self.starts
        edge = np.zeros(len(least) + 1, np.int64)
        long = size >= LENGTH
        np.add.at(edge, self.starts[long], 1)
        np.add.at(edge, self.ends[long] - LENGTH + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        least = np.where(inside, least, np.uint64(0))
        reach = _slide(np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)]), SPAN, np.maximum)
        k = min(len(h), len(reach))
        at = np.flatnonzero((reach[:k] == h[:k]) & (h[:k] > 0))
        self.doc = np.searchsorted(self.starts, at, "right") - 1
        ok = (self.doc >= 0) & (at < self.ends[self.doc]) if len(self.starts) else np.zeros(0, bool)
        at, self.doc = at[ok], self.doc[ok]
        self.lo = np.maximum(at - BEFORE, self.starts[self.doc])
        self.hi = np.minimum(at + LENGTH, self.ends[self.doc])
        self.t = h[at]
        wide = (total[self.hi] - total[self.lo]) * down[self.lo]
        self.phrase = mixed(wide + ((at - self.lo) * 512 + self.hi - self.lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.place = at
        self.at = at - self.starts[self.doc]


def _dealt(t: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by part, part of each stretch, and where stretches begin."""
    to = (mixed(t + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    begin = np.flatnonzero(np.diff(to[order], prepend=-1))
    return order, to[order][begin], begin


def _blobs(order: np.ndarray, begin: np.ndarray, **cols: np.ndarray) -> dict[str, pa.Array]:
    return {k: pa.array([x.tobytes() for x in np.split(v[order], begin[1:])], pa.binary()) for k, v in cols.items()}


def _read(group: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in kinds.items()]


def _firsts(t, phrase, doc, h, at):
    """Order by trigger, phrase and place; without repeats of one row; whether each is its phrase's first."""
    order = np.lexsort((at, h, doc, phrase, t))
    t, phrase, doc, h, at = (x[order] for x in (t, phrase, doc, h, at))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (phrase[1:] != phrase[:-1])
    fresh = new.copy()
    fresh[1:] |= (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return order, new, fresh


def _runs(doc: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """A row for each text: its runs of starts of repeated strings, as pairs of 32-bit numbers."""
    order = np.lexsort((lo, h, doc))
    doc, h, pairs = doc[order], h[order], np.stack([lo[order], hi[order]], axis=1).astype(np.int32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return pa.table({"d": pa.array(doc[at], pa.int64()), "h": pa.array(h[at], pa.int64()), "runs": pa.array([x.tobytes() for x in np.split(pairs, at[1:])] if len(at) else [], pa.binary())})


def _bit(t: np.ndarray) -> np.ndarray:
    return (mixed(t ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _equal(x: np.ndarray, r: np.ndarray, c: np.ndarray, r2: np.ndarray, c2: np.ndarray) -> bool:
    """Whether all strings at rows r, columns c of x equal those at r2, c2, some thousands at a time."""
    k = np.arange(LENGTH)
    return all(np.array_equal(x[r[i : i + 20_000, None], c[i : i + 20_000, None] + k], x[r2[i : i + 20_000, None], c2[i : i + 20_000, None] + k]) for i in range(0, len(r), 20_000))


def _scan(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, most=STEP):
            d, h = batch.column("d").to_numpy(), batch.column("h").to_numpy()
            p = Parse(texts)
            room = np.minimum(p.at, (p.ends - p.starts)[p.doc] - LENGTH)
            last = p.at - room  # lengths tell how far strings may start
            order, new, fresh = _firsts(p.t, p.phrase, d[p.doc], h[p.doc], p.at)
            again = order[fresh & ~new]
            own = _runs(d[p.doc[again]], h[p.doc[again]], np.maximum(0, p.at[again] - BEFORE), p.at[again] - last[again])
            none = lambda n: pa.nulls(n, pa.binary())
            if len(own):
                to = (mixed(own["d"].to_numpy().astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"part": pa.array(to), **{k: none(len(own)) for k in ("t", "phrase", "at", "last", "who")}, "d": pa.array([x.to_bytes(8, "little", signed=True) for x in own["d"].to_pylist()], pa.binary()), "h": pa.array([x.to_bytes(8, "little", signed=True) for x in own["h"].to_pylist()], pa.binary()), "runs": own["runs"].combine_chunks()})
            one = order[new]
            if not len(one):
                continue
            t, doc = p.t[one], p.doc[one]
            order, part, begin = _dealt(t, parts)
            names = [np.unique(x) for x in np.split(doc[order], begin[1:])]
            local = [np.searchsorted(n, x).astype(np.uint32) for n, x in zip(names, np.split(doc[order], begin[1:]), strict=True)]
            cols = _blobs(order, begin, t=t, phrase=p.phrase[one], at=p.at[one].astype(np.int32), last=last[one].astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), **cols, "who": pa.array([x.tobytes() for x in local], pa.binary()), "d": pa.array([d[n].tobytes() for n in names], pa.binary()), "h": pa.array([h[n].tobytes() for n in names], pa.binary()), "runs": none(len(part))})

    def merge(group: pa.Table) -> pa.Table:
        is_run = pc.is_valid(group["runs"])
        early, group = group.filter(is_run), group.filter(pc.invert(is_run))
        early = pa.table({"d": pa.array(np.frombuffer(b"".join(early["d"].to_pylist()), np.int64)), "h": pa.array(np.frombuffer(b"".join(early["h"].to_pylist()), np.int64)), "runs": early["runs"].combine_chunks(), "word": pa.nulls(len(early), pa.int64()), "bit": pa.nulls(len(early), pa.int64())})
        if not len(group):
            return early
        t, phrase, at, last = _read(group, t=np.uint64, phrase=np.uint64, at=np.int32, last=np.uint8)
        doc, h = [], []
        for who, d, k in zip(*(group.column(c).to_pylist() for c in ("who", "d", "h")), strict=True):
            who = np.frombuffer(who, np.uint32)
            doc.append(np.frombuffer(d, np.int64)[who])
            h.append(np.frombuffer(k, np.int64)[who])
        doc, h = np.concatenate(doc), np.concatenate(h)
        order, new, fresh = _firsts(t, phrase, doc, h, at)
        t, doc, h, at, last = t[order], doc[order], h[order], at[order].astype(np.int64), last[order].astype(np.int64)
        again = fresh & ~new
        out = _runs(doc[again], h[again], np.maximum(0, at[again] - BEFORE), at[again] - last[again])
        tn = t[new]
        several = np.zeros(len(tn), bool)
        same = tn[1:] == tn[:-1]
        several[1:] |= same
        several[:-1] |= same
        bits = np.unique(_bit(tn[several]))
        none = lambda n, kind: pa.nulls(n, kind)
        a = pa.table({"d": out["d"], "h": out["h"], "runs": out["runs"], "word": none(len(out), pa.int64()), "bit": none(len(out), pa.int64())})
        words, first = np.unique(bits >> 5, return_index=True)
        b = pa.table({"d": none(len(words), pa.int64()), "h": none(len(words), pa.int64()), "runs": none(len(words), pa.binary()), "word": pa.array(words, pa.int64()), "bit": pa.array(np.bitwise_or.reduceat(1 << (bits & 31), first) if len(bits) else np.zeros(0, np.int64), pa.int64())})
        return pa.concat_tables([early, a, b])

    rows = docs.mapInArrow(lean(run), "part bigint, t binary, phrase binary, at binary, last binary, who binary, d binary, h binary, runs binary")
    return rows.groupBy("part").applyInArrow(lean(merge), "d bigint, h bigint, runs binary, word bigint, bit bigint")


def _compare(docs: DataFrame, flags: np.ndarray, parts: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sent.value
        for batch, texts in steps(batches, most=STEP):
            d, h = batch.column("d").to_numpy(), batch.column("h").to_numpy()
            p = Parse(texts)
            bit = _bit(p.t)
            ok = np.flatnonzero(((flags[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1) > 0)
            if not len(ok):
                continue
            t, phrase, doc, at = p.t[ok], p.phrase[ok], p.doc[ok], p.at[ok]
            order, new, _ = _firsts(t, phrase, d[doc], h[doc], at)
            ok = ok[order[new]]
            t, phrase, doc, at = p.t[ok], p.phrase[ok], p.doc[ok], p.at[ok]
            lo, size = p.lo[ok], p.hi[ok] - p.lo[ok]
            left = p.place[ok] - lo
            order, part, begin = _dealt(t, parts)
            text = [b"".join(p.buf[a : a + n] for a, n in zip(lo[x].tolist(), size[x].tolist(), strict=True)) for x in np.split(order, begin[1:])]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), **_blobs(order, begin, t=t, phrase=phrase, d=d[doc], h=h[doc], at=at.astype(np.int32), left=left.astype(np.uint8), size=size.astype(np.uint8)), "text": pa.array(text, pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        t, phrase, doc, h, at, left, size = _read(group, t=np.uint64, phrase=np.uint64, d=np.int64, h=np.int64, at=np.int32, left=np.uint8, size=np.uint8)
        text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
        begin = np.cumsum(size.astype(np.int64)) - size
        order, new, _ = _firsts(t, phrase, doc, h, at)
        pick = order[new]
        same = t[pick][1:] == t[pick][:-1]
        several = np.zeros(len(pick), bool)
        several[1:] |= same
        several[:-1] |= same
        pick = pick[several]
        out = []
        up, down = _powers(WIDE + 1)
        edges = np.flatnonzero(np.diff(t[pick], prepend=np.uint64(0))) if len(pick) else np.zeros(0, np.int64)
        at_row = 0
        while at_row < len(pick):
            to = edges[np.searchsorted(edges, at_row + 8192)] if at_row + 8192 <= (edges[-1] if len(edges) else 0) else len(pick)
            rows, at_row = pick[at_row:to], int(to)
            shift = BEFORE - left[rows].astype(np.int64)
            col = np.arange(WIDE)[None, :] - shift[:, None]
            held = (col >= 0) & (col < size[rows].astype(np.int64)[:, None])
            bytes_ = np.where(held, text[np.clip(begin[rows][:, None] + col, 0, max(0, len(text) - 1))], np.uint8(0))
            total = np.zeros((len(rows), WIDE + 1), np.uint64)
            np.cumsum(np.where(held, _VALUE[bytes_], np.uint64(0)) * up[:WIDE][None, :], axis=1, out=total[:, 1:])
            o = np.arange(SPAN)
            suffix = (total[:, o + LENGTH] - total[:, o]) * down[o][None, :]
            valid = (o[None, :] >= shift[:, None]) & (o[None, :] + LENGTH <= (shift + size[rows])[:, None])
            rank = np.empty(len(rows), np.int64)
            rank[np.lexsort((at[rows], h[rows], doc[rows]))] = np.arange(len(rows))
            r, c = np.nonzero(valid)
            key = mixed(suffix[r, c] + mixed(t[rows][r] + c.astype(np.uint64)))
            by = np.lexsort((rank[r], key))
            rep = np.zeros(len(by), bool)
            same = np.flatnonzero(key[by][1:] == key[by][:-1])
            if len(same):
                x, y = by[same + 1], by[same]
                if _equal(bytes_, r[x], c[x], r[y], c[y]):
                    rep[x] = True
                else:  # hashes of different strings agree: the strings themselves decide
                    seen: set[bytes] = set()
                    for i in by[np.unique(np.concatenate([same, same + 1]))].tolist():
                        one = int(t[rows][r[i]]).to_bytes(8, "little") + bytes([c[i]]) + bytes_[r[i], c[i] : c[i] + LENGTH].tobytes()
                        rep[i] = one in seen
                        seen.add(one)
            start = at[rows][r[rep]].astype(np.int64) - BEFORE + c[rep]
            row = r[rep]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(row) != 0)])) if len(row) else np.zeros(0, np.int64)
            if len(cut):
                end = np.append(cut[1:], len(row)) - 1
                out.append((doc[rows][row[cut]], h[rows][row[cut]], start[cut], start[end]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return _runs(*cols)

    rows = docs.mapInArrow(lean(run), "part bigint, t binary, phrase binary, d binary, h binary, at binary, left binary, size binary, text binary")
    return rows.groupBy("part").applyInArrow(lean(merge), "d bigint, h bigint, runs binary")


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (binary) of each row of docs.

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id (null is the smallest), or
    in the same text before; rows of one doc_id with other texts come in the order of the texts' hashes. Rows that agree
    in doc_id and text count as one and get the same result. A null text counts as empty.
    """
    spark = docs.sparkSession
    batches_of(spark, MANY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    some = own.where(F.octet_length("text") >= LENGTH).select("d", "h", "text")
    found = written(_scan(some, parts), "repeats")
    words = found.where("word is not null").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()  # at most 2**FILTER_BITS / 32 rows
    flags = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    flags[words.word.to_numpy()] = words.bit.to_numpy()
    runs = found.where("runs is not null").select("d", "h", "runs").unionAll(_compare(some, flags, parts))
    runs = runs.groupBy("d", "h").agg(F.collect_list("runs").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in steps(batches):
            removed, spans, kept = [], [], []
            for text, found in zip(raw, batch.column("runs").to_pylist(), strict=True):
                if not found:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                pairs = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2).astype(np.int64)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1] + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            cols = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, raw), pa.int64(), size=len(raw)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    return own.join(runs, ["d", "h"], "left").select("doc_id", "text", "runs").mapInArrow(lean(run), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
