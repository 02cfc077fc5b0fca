"""Operator 5: scores of texts under a hierarchical Pitman-Yor model of words, seated by Gibbs sampling.

Every word has a restaurant of the words that follow it (the end of a text stands before its first word). All of these
share one parent, the word restaurant, whose customers are their tables. Its parent is a speller: restaurants of
bytes after the last three, two, one and no bytes, where the restaurants of longer contexts share those of shorter ones
as parents; the customers of the speller are the tables of the word restaurant. So a word after its neighbour falls back on
the word alone, and that on its spelling. As in the base score, all words never seen in training are one outcome: its
probability is what the speller leaves to them.

Sweeps alternate: tables of every word given the speller and the pairs' tables, tables of all pairs of two or more
customers given the words (pairs of one customer have one table), and tables of the speller's dishes given the words' tables (on
the driver, on a count array of fixed size). A gamma draw for each context makes the dishes of a restaurant independent, so all
pairs are drawn at once from their exact law. Predictive probabilities are averaged over the sweeps after the first BURN_IN.

Words live in parts by their hash, pairs in parts by theirs, so neither a frequent word nor a frequent context is one task's
work. Parts send each other what the other lacks, in an agreed order, as packed numbers; a step of texts asks for each
distinct word and pair once. How many parts there are follows from the bytes of the texts, and what a part adds to the speller's
counts is a packed row for each of RANGES ranges of cells, so neither messages nor draws depend on the settings of a cluster.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.arrow import joined, lean, mixed, steps
from mixloom.llm.common import MANY, batches_of, done_with, table, written
from mixloom.llm.pitman_yor import draw_tables

FOLDS, HELD = 7, 2
SWEEPS, BURN_IN = 6, 2
#: Bits by which the last, the second and the third last byte split the speller's restaurants.
BITS = (6, 5, 3)
SPELL_DISCOUNT, STRENGTH = 0.5, 1.0
END = b"\n"
STEP = 12_000_000
#: Tokens that are priced at a time.
SLICE = 200_000
#: Bytes of all texts to a part of the words and of the pairs, and parts at least.
PART_BYTES, LEAST_PARTS = 16_000_000, 8

_R3 = 1 << sum(BITS)
#: Ranges that the speller's cells, mixed, are counted in, and the cells of each.
RANGES = 16
_RANGE = _R3 * 256 // RANGES


def _classes(bits: int) -> np.ndarray:
    out = 1 + (mixed(np.arange(256, dtype=np.uint64)) % np.uint64((1 << bits) - 1)).astype(np.int64)
    if bits >= 5:
        out = np.where(out <= 26, out, out % 5 + 27)[:] if bits == 5 else 28 + out % 36
        out[97:123] = np.arange(1, 27)
    out[32] = 0
    return out.astype(np.int32)


_C1, _C2, _C3 = (_classes(b) for b in BITS)


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells (restaurant * 256 + byte) of all bytes of all words and of their ends, and where each word begins among them."""
    _, arr, starts, ends = joined(words, b"   ")
    size = ends - starts + 1
    first = np.cumsum(size) - size
    at = np.repeat(starts - first, size) + np.arange(size.sum())
    room = ((_C1[arr[at - 1]].astype(np.int64) << BITS[1] | _C2[arr[at - 2]]) << BITS[2]) | _C3[arr[at - 3]]
    return room * 256 + arr[at], first


class Spelling:
    """log-probabilities of the speller's cells. Cells that were never used follow from the parent restaurant's, so what is sent
    is the parent's table, a weight for each restaurant, and the cells used."""

    def __init__(self, p: list[np.ndarray], back: np.ndarray, used: np.ndarray):
        self.parent, self.back = np.log(p[2]).astype(np.float32), np.log(back).astype(np.float32)
        self.at = np.flatnonzero(used).astype(np.int32)
        self.value = np.log(p[3].ravel()[self.at]).astype(np.float32)
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = (np.repeat(self.parent, _R3 // len(self.parent), axis=0) + self.back[:, None]).ravel()
            self._table[self.at] = self.value
        return self._table


@dataclass(frozen=True)
class State:
    """What a sweep starts from: the speller, tables in all, the word restaurant's discount."""

    spelling: Spelling
    tables: float
    discount: float
    sweep: int

    def spelled(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.exp(np.maximum(np.add.reduceat(self.spelling.table()[cells].astype(np.float64), first), -650.0)) if len(first) else np.zeros(0)

    def seat(self, words: list[bytes], c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        keys = np.fromiter((zlib.crc32(w) | len(w) << 32 for w in words), np.uint64, len(words)) + np.uint64(self.sweep << 48)
        return draw_tables(c, np.full(len(c), STRENGTH + self.discount * self.tables), spelled, self.discount, mixed(keys))


def speller(counts: np.ndarray, tables: list[np.ndarray] | None, sweep: int) -> tuple[Spelling, list[np.ndarray]]:
    """Reseats the speller over the counts of its cells; the probabilities of the cells, and its tables by level."""
    d = SPELL_DISCOUNT
    rooms = [1, 1 << BITS[0], 1 << BITS[0] + BITS[1], _R3]
    tables = tables or [np.zeros((r, 256), np.int32) for r in rooms]

    def fold(level: int, t: np.ndarray) -> np.ndarray:
        return t.reshape(rooms[level - 1], -1, 256).sum(axis=1) if level > 1 else t.sum(axis=0, keepdims=True)

    def probabilities(c: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for level in range(4):
            below = np.full((1, 256), 1 / 256) if level == 0 else np.repeat(out[-1], rooms[level] // rooms[level - 1], axis=0)
            n, m = c[level].sum(axis=1, keepdims=True), tables[level].sum(axis=1, keepdims=True)
            out.append(((c[level] - d * tables[level]) + (STRENGTH + d * m) * below) / (STRENGTH + n))
        return out

    def customers() -> list[np.ndarray]:
        c = [None, None, None, counts.reshape(_R3, 256)]
        for level in (3, 2, 1):
            tables[level] = np.minimum(np.maximum(tables[level], c[level] > 0), c[level])
            c[level - 1] = fold(level, tables[level])
        tables[0] = np.minimum(np.maximum(tables[0], c[0] > 0), c[0])
        return c

    p = probabilities(customers())
    for level in (3, 2, 1, 0):
        c = customers()[level]
        at = np.flatnonzero(c.ravel())
        room, byte = at // 256, at % 256
        total = tables[level].sum(axis=1)
        parent = np.full(len(at), 1 / 256) if level == 0 else p[level - 1][room // (rooms[level] // rooms[level - 1]), byte]
        t = draw_tables(c.ravel()[at], STRENGTH + d * (total[room] - tables[level].ravel()[at]), parent, d, mixed(at.astype(np.uint64) + np.uint64(level << 40 | sweep << 48)))
        tables[level] = np.zeros_like(tables[level])
        tables[level].ravel()[at] = t
    c = customers()
    n, m = c[3].sum(axis=1), tables[3].sum(axis=1)
    return Spelling(probabilities(c), (STRENGTH + d * m) / (STRENGTH + n), c[3].ravel() > 0), tables


#: Kinds of the rows that parts, steps and the driver exchange; all share one schema, and blobs are packed whole numbers.
WORDS, TEXTS, IDS, VOCABULARY, QUESTIONS, PAIRS, LINKS, TABLES, STATE, SENT, SEATS, ANSWERS, KNOWN, CELLS, TOTALS = range(15)
_SCHEMA = "step string, part bigint, kind bigint, n bigint, a binary, b binary, c binary, d binary"
_NAMES = ("step", "part", "kind", "n", "a", "b", "c", "d")
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by planes of bytes."""
    x = np.ascontiguousarray(x, np.uint64)
    if not len(x):
        return bytes(9)
    k = max(1, (int(x.max()).bit_length() + 7) // 8)
    return len(x).to_bytes(8, "little") + bytes([k]) + _ZSTD.compress(x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes(), asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, k = int.from_bytes(b[:8], "little"), b[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :k] = np.frombuffer(_ZSTD.decompress(b[9:], n * k, asbytes=True), np.uint8).reshape(k, n).T
    return out.view(np.int64).ravel()


def _squeezed(words: list[bytes]) -> bytes:
    """Words without white space, or the end, which is a line's end."""
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _wide(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:8], "little")
    return _ZSTD.decompress(b[8:], n, asbytes=True).split(b" ") if n else []


def _unique(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of whole numbers from 0 on, in order, and each pair's place among them. Where pairs and positions fit 64 bits
    together they are sorted as values, which takes less than half of the time of sorting positions by them; the result is the same."""
    if not len(upper):
        return upper.astype(np.int64), lower.astype(np.int64), np.zeros(0, np.int64)
    low, bits = np.uint64(int(lower.max()).bit_length()), np.uint64((len(upper) - 1).bit_length())
    key = upper.astype(np.uint64) << low | lower.astype(np.uint64)
    if int(upper.max()).bit_length() + int(low) + int(bits) > 64:
        key, back = np.unique(key, return_inverse=True)
    else:
        at = key << bits | np.arange(len(key), dtype=np.uint64)
        at.sort()
        np.right_shift(at, bits, out=key)
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        key = key[new]
        at &= (np.uint64(1) << bits) - np.uint64(1)
        back = np.empty(len(at), np.int64)
        back[at.view(np.int64)] = np.cumsum(new) - 1
    return (key >> low).astype(np.int64), (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), back


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows in the shared schema; blobs that are missing at the end are null."""
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)], _NAMES)


def _mixed_cells(cells: np.ndarray) -> np.ndarray:
    """A bijective mix of the speller's cells, so its ranges are about as full as each other."""
    return cells * 2654435761 & _R3 * 256 - 1


def _counts(ranges: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
    """Rows of used cells of a range, as distances between them, and how often each is used."""
    return [(None, k, CELLS, 0, pack(np.diff(at, prepend=0)), pack(n)) for k, at, n in ranges if len(at)]


def _cells(cells: np.ndarray, times: np.ndarray) -> list[tuple]:
    """For each range a row of the cells of the speller that are used, and how often."""
    at, back = np.unique(_mixed_cells(cells), return_inverse=True)
    n = np.bincount(back, times, len(at)).astype(np.int64)
    cuts = np.searchsorted(at, np.arange(RANGES + 1) * _RANGE)
    return _counts([(k, at[x:y] - k * _RANGE, n[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def _counted(rows: list[dict]) -> np.ndarray:
    """Sums of the rows of a range, for each of its cells."""
    total = np.zeros(_RANGE, np.int64)
    for r in rows:
        total[np.cumsum(unpack(r["a"]))] += unpack(r["b"])
    return total


def _by_kind(group: pa.Table) -> defaultdict[int, list[dict]]:
    """Rows of a group by kind, each kind in the order of parts, then n, then steps."""
    out = defaultdict(list)
    for r in sorted(group.to_pylist(), key=lambda r: (r["kind"], r["part"], r["n"], r["step"] or "")):
        out[r["kind"]].append(r)
    return out


def _grouped(rows: DataFrame, key: str, f) -> DataFrame:
    """f(rows by kind) for each group, a list of batches in the shared schema."""

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(f(_by_kind(group)))

    return rows.groupBy(key).applyInArrow(lean(run), _SCHEMA)


def postings(docs: DataFrame, parts: int) -> DataFrame:
    """For each step of texts a row of its tokens, as numbers of its words, and rows of those words and their training counts by part.

    A row of tokens also says of each document its id, its tokens, and flags: 1 held out, 2 no id. Words are numbered part by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = count()
        for batch, texts in steps(batches, most=STEP):
            ids = batch.column("doc_id").to_pylist()
            rest = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids]
            train = np.array([r is not None and r != HELD for r in rest])
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            seen = [np.fromiter(map(number.__getitem__, [*t.lower().split(), END]), np.int64) for t in texts]
            n_tokens = np.array([len(x) for x in seen], np.int64)
            words = list(number)
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            tokens = new[np.concatenate(seen)]
            n = np.bincount(tokens, np.repeat(train, n_tokens), len(words)).astype(np.int64)
            cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            own = f"{TaskContext.get().partitionId()}-{next(name)}"
            flags = np.array([(r == HELD) + 2 * (r is None) for r in rest], np.uint8)
            about = np.array([i or 0 for i in ids], np.int64).tobytes() + n_tokens.tobytes() + flags.tobytes()
            rows = [(own, -1, TEXTS, 0, pack(tokens), about)]
            order = order.tolist()
            rows += [(own, p, WORDS, 0, _squeezed([words[i] for i in order[x:y]]), pack(n[x:y])) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _SCHEMA)


def _vocabulary(kinds: dict) -> list[pa.RecordBatch]:
    """Known words of a part, frequent ones first, with training counts; to each step, the ranks of its words (from 1; 0: unknown)."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    rows, part = kinds[WORDS], kinds[WORDS][0]["part"] if kinds[WORDS] else 0
    seen = [np.fromiter(map(number.__getitem__, _wide(r["a"])), np.int64) for r in rows]
    total = np.zeros(len(number), np.int64)
    for at, r in zip(seen, rows, strict=True):
        total[at] += unpack(r["b"])
    words = list(number)
    known = sorted(np.flatnonzero(total).tolist(), key=lambda i: (-total[i], words[i]))
    rank = np.zeros(len(words), np.int64)
    rank[known] = np.arange(1, len(known) + 1)
    out = [(r["step"], part, IDS, 0, pack(rank[at])) for at, r in zip(seen, rows, strict=True)]
    words, c = [words[i] for i in known], total[known]
    out += [(None, part, VOCABULARY, len(words), _squeezed(words), pack(c)), (None, part, TOTALS, 0, np.array([c.sum(), len(words)], np.int64).tobytes())]
    cells, _ = spelling(words) if words else (np.zeros(0, np.int64), None)
    return [_batch(out + _cells(cells, np.ones(len(cells))))]


@dataclass
class Step:
    """Texts of a step: tokens by number, the numbers before them (the end before a first word), ids of the words by number (0:
    unknown), and the distinct pairs of known neighbours, by part: their ids (u, w), cuts between parts, each token's pair or -1."""

    tokens: np.ndarray
    before: np.ndarray
    ids: np.ndarray
    u: np.ndarray
    w: np.ndarray
    cuts: np.ndarray
    pair: np.ndarray
    doc_id: np.ndarray
    n_tokens: np.ndarray
    flags: np.ndarray


def _step(kinds: dict, parts: int) -> Step:
    about = kinds[TEXTS][0]["b"]
    n = len(about) // 17
    doc_id, n_tokens, flags = np.frombuffer(about, np.int64, n), np.frombuffer(about, np.int64, n, 8 * n), np.frombuffer(about, np.uint8, n, 16 * n)
    ids = np.concatenate([np.where((x := unpack(r["a"])) > 0, (x - 1) * parts + r["part"] + 1, 0) for r in kinds[IDS]])
    tokens = unpack(kinds[TEXTS][0]["a"]).astype(np.int32)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    ends = np.cumsum(n_tokens)
    before[ends - n_tokens] = tokens[ends - 1]  # each text ends with the end
    at = np.flatnonzero((ids[before] > 0) & (ids[tokens] > 0))
    u, w, back = _unique(before[at], tokens[at])
    u, w = ids[u], ids[w]
    part = (mixed(u.view(np.uint64) << np.uint64(32) | w.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.int64)
    order = np.argsort(part, kind="stable")
    new = np.empty(len(u), np.int32)
    new[order] = np.arange(len(u))
    pair = np.full(len(tokens), -1, np.int32)
    pair[at] = new[back]
    return Step(tokens, before, ids, u[order], w[order], np.searchsorted(part[order], np.arange(parts + 1)), pair, doc_id, n_tokens, flags)


def _ask(kinds: dict, parts: int) -> list[pa.RecordBatch]:
    """Distinct pairs of a step, to the parts that count them, with training counts."""
    s = _step(kinds, parts)
    train = np.repeat(s.flags == 0, s.n_tokens) & (s.pair >= 0)
    n = np.bincount(s.pair[train], minlength=len(s.u))
    out = []
    for p in range(parts):
        x, y = s.cuts[p], s.cuts[p + 1]
        if x < y:
            first = np.flatnonzero(np.diff(s.u[x:y], prepend=-1))
            out.append((kinds[TEXTS][0]["step"], p, QUESTIONS, 0, pack(s.u[x:y][first]), pack(s.w[x:y]), pack(n[x:y]), pack(np.diff(first, append=y - x))))
    return [_batch(out)]


def _distinct(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Of questions: distinct pairs (u, w), training counts, the questions' sizes, each question's pair."""
    w = [unpack(r["b"]) for r in rows]
    u, v, back = _unique(np.concatenate([np.repeat(unpack(r["a"]), unpack(r["d"])) for r in rows]), np.concatenate(w))
    n = np.bincount(back, np.concatenate([unpack(r["c"]) for r in rows]), len(u)).astype(np.int64)
    return u, v, n, [len(x) for x in w], back


def _pairs(kinds: dict, parts: int) -> list[pa.RecordBatch]:
    """Pairs of two or more customers of a part, by places in the list of their words; to the words' parts, what pairs of one
    customer add for good (LINKS, which also name the words of the list), and first tables of the others, one each."""
    own = kinds[QUESTIONS][0]["part"]
    u, w, n, *_ = _distinct(kinds[QUESTIONS])
    u, w, n = u[n > 0], w[n > 0], n[n > 0]
    ids, back = np.unique(np.concatenate([u, w]), return_inverse=True)
    order = np.lexsort(((ids - 1) // parts, (ids - 1) % parts))
    new = np.empty(len(ids), np.int64)
    new[order] = np.arange(len(ids))
    ids, back = ids[order], new[back]
    u, w = back[: len(u)], back[len(u) :]
    one, more, size = n == 1, n > 1, len(ids)
    su, sw, mu, mw = (np.bincount(x, minlength=size) for x in (u[one], w[one], u[more], w[more]))
    asked = mu + mw > 0
    place = np.cumsum(asked) - 1
    cuts = np.searchsorted((ids - 1) % parts, np.arange(parts + 1))
    out = [(None, own, PAIRS, 0, pack(place[u[more]]), pack(place[w[more]]), pack(n[more])), (None, own, TOTALS, 0, np.array([(n == 1).sum(), (n == 2).sum()], np.int64).tobytes())]
    for p in range(parts):
        x, y = cuts[p], cuts[p + 1]
        if x < y:
            at = asked[x:y]
            out.append((None, p, LINKS, own, pack(np.diff((ids[x:y] - 1) // parts, prepend=0)), pack(su[x:y]), pack(sw[x:y] * 2 + at)))
            out.append((None, p, TABLES, own, pack(mu[x:y][at]), pack(mw[x:y][at])))
    return [_batch(out)]


def _words(kinds: dict, state: State, pair_discount: float) -> list[pa.RecordBatch]:
    """Words of a part given the tables of all pairs: their own tables, their weights as contexts; to the pairs' parts what they need."""
    if not kinds[VOCABULARY]:
        return [_batch([])]
    about = kinds[VOCABULARY][0]
    part, words = about["part"], _wide(about["a"])
    seated, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    tables = {r["n"]: r for r in kinds[TABLES]}
    asked = []
    for r in kinds[LINKS]:
        rank, sw = np.cumsum(unpack(r["a"])), unpack(r["c"])
        seated[rank] += unpack(r["b"])
        n[rank] += sw >> 1
        at = rank[(sw & 1) > 0]
        seated[at] += unpack(tables[r["n"]]["a"])
        n[at] += unpack(tables[r["n"]]["b"])
        asked.append((r["n"], at))
    cells, first = spelling(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    spelled = state.spelled(cells, first)
    t = state.seat(words, n, spelled)
    draw = np.random.Generator(np.random.Philox(key=[state.sweep, part]))
    x = (pair_discount * draw.standard_gamma(STRENGTH / pair_discount + seated)).astype(np.float32)
    s32 = spelled.astype(np.float32)
    out = [(None, to, SENT, part, x[at].tobytes(), pack(n[at]), pack(t[at]), s32[at].tobytes()) for to, at in asked]
    out.append((None, part, STATE, state.sweep, pack(seated), pack(n), pack(t), s32.tobytes()))
    out.append((None, part, TOTALS, 0, np.array([n.sum(), t.sum(), (n == 1).sum(), (n == 2).sum(), round(float(spelled.sum()) * 2**50)], np.int64).tobytes()))
    return [_batch(out + _cells(cells, np.repeat(t, np.diff(np.append(first, len(cells))))))]


@dataclass(frozen=True)
class Totals:
    """Customers and tables of the word restaurant, its discount, and the share of the speller's words that are known."""

    customers: int
    tables: int
    discount: float
    known: float

    def words(self, n: np.ndarray, t: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Probabilities in the word restaurant."""
        return (n - self.discount * t + (STRENGTH + self.discount * self.tables) * spelled) / (STRENGTH + self.customers)

    def unseen(self) -> float:
        return max(1e-300, (STRENGTH + self.discount * self.tables) * (1 - self.known) / (STRENGTH + self.customers))


def _seats(kinds: dict, sweep: int, totals: Totals, discount: float) -> list[pa.RecordBatch]:
    """Tables of a part's pairs given their contexts' weights and the word restaurant; to the words' parts, sums of them."""
    if not kinds[PAIRS]:
        return [_batch([])]
    own = kinds[PAIRS][0]
    u, w, c = (unpack(own[k]) for k in "abc")
    sent = kinds[SENT]
    if not len(c) or not sent:
        return [_batch([(None, r["n"], TABLES, own["part"], pack(np.zeros(0)), pack(np.zeros(0))) for r in sent] + [(None, own["part"], SEATS, sweep, pack(np.zeros(0)))])]
    x, s = (np.concatenate([np.frombuffer(r[k], np.float32) for r in sent]).astype(np.float64) for k in "ad")
    n, t1 = (np.concatenate([unpack(r[k]) for r in sent]) for k in "bc")
    keys = mixed(np.arange(len(c), dtype=np.uint64) + np.uint64(own["part"] << 32)) + np.uint64(sweep)
    t = draw_tables(c, x[u], totals.words(n, t1, s)[w], discount, mixed(keys), flat=True)
    mu, mw = np.bincount(u, t, len(x)), np.bincount(w, t, len(x))
    ends = np.cumsum([len(r["a"]) // 4 for r in sent]).tolist()
    out = [(None, r["n"], TABLES, own["part"], pack(mu[a:b]), pack(mw[a:b])) for r, a, b in zip(sent, [0, *ends], ends, strict=False)]
    return [_batch([*out, (None, own["part"], SEATS, sweep, pack(t))])]


def _answers(kinds: dict) -> list[pa.RecordBatch]:
    """To each question the customers of its pairs, and for pairs of two or more their tables in each draw."""
    if not kinds[QUESTIONS]:
        return [_batch([])]
    _, _, n, sizes, back = _distinct(kinds[QUESTIONS])
    draws = []
    for r in kinds[SEATS]:
        draws.append(np.minimum(n, 1))
        draws[-1][n > 1] = unpack(r["a"])
    out, x = [], 0
    for r, size in zip(kinds[QUESTIONS], sizes, strict=True):
        at = back[x : x + size]
        x += size
        more = at[n[at] > 1]
        out.append((r["step"], r["part"], ANSWERS, 0, pack(n[at]), pack(np.concatenate([t[more] for t in draws]))))
    return [_batch(out)]


def _known(kinds: dict, totals: list[Totals]) -> list[pa.RecordBatch]:
    """To each step, of its known words of a part: customers, tables as contexts and probabilities in each draw."""
    if not kinds[IDS]:
        return [_batch([])]
    c = unpack(kinds[VOCABULARY][0]["b"])
    states = [[unpack(r[k]) for k in "abc"] + [np.frombuffer(r["d"], np.float32)] for r in kinds[STATE]]
    p = [x.words(n, t, s.astype(np.float64)).astype(np.float32) for x, (_, n, t, s) in zip(totals, states, strict=True)]
    out = []
    for r in kinds[IDS]:
        at = unpack(r["a"])
        at = at[at > 0] - 1
        out.append((r["step"], r["part"], KNOWN, 0, pack(c[at]), pack(np.concatenate([s[0][at] for s in states])), None, np.concatenate([x[at] for x in p]).tobytes()))
    return [_batch(out)]


def predictive(s: Step, customers: np.ndarray, pair: np.ndarray, draws: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float) -> np.ndarray:
    """log10 of each token's probability after the word before it, averaged over draws.

    customers: of each word's restaurant as a context; pair: those of each distinct pair; a draw: tables of each word's restaurant, the
    words' probabilities, tables of each pair. A context that was never seen leaves it to the word restaurant.
    """
    p, k = np.zeros(len(s.tokens)), 0
    for tables, words, seats in draws:
        left, weight = np.append(pair - discount * seats, 0.0), STRENGTH + discount * tables
        for x in range(0, len(p), SLICE):
            at = slice(x, x + SLICE)
            p[at] += left[s.pair[at]] + weight[s.before[at]] * words[s.tokens[at]]
        k += 1
    for x in range(0, len(p), SLICE):
        at = slice(x, x + SLICE)
        p[at] = np.log10(np.maximum(p[at] / (k * (STRENGTH + customers[s.before[at]])), 1e-300))
    return p


def _scored(kinds: dict, parts: int, totals: list[Totals], pair_discount: float, n_train: int, n_words: int) -> pa.Table:
    s = _step(kinds, parts)
    known, size, k = s.ids > 0, len(s.ids), len(totals)
    split = lambda x: x.reshape(k, -1)
    c = np.zeros(size, np.int64)
    c[known] = np.concatenate([unpack(r["a"]) for r in kinds[KNOWN]])
    pair = np.concatenate([unpack(r["a"]) for r in kinds[ANSWERS]]) if kinds[ANSWERS] else np.zeros(0, np.int64)
    tables = np.concatenate([split(unpack(r["b"])) for r in kinds[KNOWN]], axis=1)
    p = np.concatenate([split(np.frombuffer(r["d"], np.float32)) for r in kinds[KNOWN]], axis=1)
    more = np.concatenate([split(unpack(r["b"]).astype(np.int32)) for r in kinds[ANSWERS]], axis=1) if kinds[ANSWERS] else np.zeros((k, 0), np.int32)
    kinds.clear()

    def draws() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, total in enumerate(totals):
            words, seated, seats = np.full(size, total.unseen()), np.zeros(size), np.minimum(pair, 1)
            words[known], seated[known], seats[pair > 1] = p[i], tables[i], more[i]
            yield seated, words, seats

    first = np.cumsum(s.n_tokens) - s.n_tokens
    n_known, base, own = (np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64)[s.tokens], np.log10(c + 1.0)[s.tokens], predictive(s, c, pair, draws(), pair_discount)))
    n = len(first)
    return pa.table({"doc_id": pa.array(s.doc_id, mask=(s.flags & 2) > 0), "held_out": pa.array((s.flags & 1) > 0), "n_tokens": pa.array(s.n_tokens), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n, n_train)), "base_score": pa.array(base - s.n_tokens * np.log10(n_train + n_words + 1)), "score": pa.array(own)})


def _sums(rows: DataFrame, n: int) -> list[int]:
    """Sums over the parts' rows of totals, of which there is one each."""
    got = [np.frombuffer(r.a, np.int64) for r in rows.where(F.col("kind") == TOTALS).select("a").collect()]
    return [int(x) for x in np.sum(got, axis=0)] if got else [0] * n


def _summed(kinds: dict) -> list[pa.RecordBatch]:
    """One row for a range of cells, with the sums of all parts."""
    total = _counted(kinds[CELLS])
    at = np.flatnonzero(total)
    return [_batch(_counts([(kinds[CELLS][0]["part"], at, total[at])]))]


def _used(rows: DataFrame) -> np.ndarray:
    total = np.zeros(_R3 * 256, np.int64)
    for r in _grouped(rows.where(F.col("kind") == CELLS), "part", _summed).collect():  # at most RANGES rows, of at most _RANGE cells
        total[r.part * _RANGE :][:_RANGE] = _counted([{"a": r.a, "b": r.b}])
    return total[_mixed_cells(np.arange(_R3 * 256))]


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _parts(docs: DataFrame) -> int:
    """Parts of words and of pairs, from the bytes of all texts: the rows that parts exchange must not grow with a cluster's settings."""
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_PARTS, -(-n // PART_BYTES))


def _only(rows: DataFrame, kind: int) -> DataFrame:
    """The rows of a kind, written by themselves; the table that they are from goes."""
    out = written(rows.where(F.col("kind") == kind), "kept")
    done_with(rows)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Learns from rows whose crc32 of the id as text, modulo 7, is not 2. A null text counts as empty: one token, the end.
    Rows with a null doc_id are scored but not learnt from, and held_out is false. Repeated rows are learnt from as
    often as they stand there. Without training rows base_score and score are 0 for all.
    """
    spark = docs.sparkSession
    batches_of(spark, MANY)
    parts = _parts(docs)
    kind = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    found = written(postings(docs, parts), "postings")
    words = written(_grouped(kind(found, WORDS), "part", _vocabulary), "vocabulary")
    n_train, n_words = _sums(words, 2)
    texts = _only(found, TEXTS)
    told = texts.unionAll(kind(words, IDS))
    asked = written(_grouped(told, "step", lambda kinds: _ask(kinds, parts)), "questions")
    pairs = written(_grouped(asked, "part", lambda kinds: _pairs(kinds, parts)), "pairs")
    pair_discount = _discount(*_sums(pairs, 2))
    messages, counts, tables, n_tables, discount = kind(pairs, TABLES), _used(words), None, n_words, 0.5
    totals: list[Totals] = []
    states, seats, passed = [], [], None
    for sweep in range(SWEEPS):
        spelled, tables = speller(counts, tables, sweep)
        sent = spark.sparkContext.broadcast(State(spelled, n_tables, discount, sweep))
        rows = kind(words, VOCABULARY).unionAll(kind(pairs, LINKS)).unionAll(messages)
        seated = written(_grouped(rows, "part", lambda kinds, sent=sent: _words(kinds, sent.value, pair_discount)), "words")
        sent.unpersist()
        customers, n_tables, ones, twos, share = _sums(seated, 5)
        total = Totals(customers, n_tables, discount, min(1 - 1e-9, share / 2**50))
        if sweep == 0:
            discount = _discount(ones, twos)
        if passed and sweep >= BURN_IN:  # the state is that of the words and of the pairs' tables that they were seated by
            totals.append(total)
            seats.append(_only(passed, SEATS))
        elif passed:
            done_with(passed)
        counts = _used(seated)
        if sweep + 1 < SWEEPS:
            rows = kind(pairs, PAIRS).unionAll(kind(seated, SENT))
            passed = written(_grouped(rows, "part", lambda kinds, sweep=sweep, total=total: _seats(kinds, sweep, total, pair_discount)), "seats")
            messages = kind(passed, TABLES)
        if sweep >= BURN_IN:
            states.append(_only(seated, STATE))
        else:
            done_with(seated)
    done_with(pairs)
    answers, known = kind(asked, QUESTIONS), kind(words, IDS, VOCABULARY)
    for seat, state in zip(seats, states, strict=True):
        answers, known = answers.unionAll(seat), known.unionAll(state)
    answers = written(_grouped(answers, "part", _answers), "answers")
    done_with(asked, *seats)
    told = told.unionAll(answers).unionAll(_grouped(known, "part", lambda kinds: _known(kinds, totals)))

    def finish(group: pa.Table) -> pa.Table:
        return _scored(_by_kind(group), parts, totals, pair_discount, n_train, n_words)

    return told.groupBy("step").applyInArrow(lean(finish), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
