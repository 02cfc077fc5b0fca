"""Arrow batches of texts for the operators that run in Python workers."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that one step in a worker takes at a time; a longer text is a step of its own.
STEP_BYTES = 8_000_000


def clean(b: bytes | None) -> bytes:
    """Null becomes empty; bytes that are not UTF-8 become U+FFFD."""
    if not b:
        return b""
    try:
        b.decode()
    except UnicodeDecodeError:
        b = b.decode("utf-8", "replace").encode()
    return b


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits between stages should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """f, a function of a group or of batches, that gives its memory back to the system when it is done."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(batches):
            yield from f(batches)
            trim()
    else:

        @wraps(f)
        def run(group):
            out = f(group)
            trim()
            return out

    del run.__wrapped__  # Spark looks at the arguments of what it is given
    return run


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text each, and those texts."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), [clean(b) for b in texts.slice(at, to - at).to_pylist()]
            at = to


def joined(texts: list[bytes], gap: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with gap before, between and after them; as bytes, as an array; their starts and ends."""
    buf = gap + gap.join(texts) + gap
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + len(gap))
    return buf, np.frombuffer(buf, np.uint8), ends - sizes, ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_COEF = mixed(np.arange(1, 8193, dtype=np.uint64)) | np.uint64(1)


def word_hashes(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs without white space in arr (which ends in white space)."""
    ink = ~_IS_BLANK[arr]
    edge = np.flatnonzero(np.diff(ink.view(np.int8), prepend=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    where = np.flatnonzero(ink)
    size = end - begin
    first = np.cumsum(size) - size
    inside = np.arange(len(where)) - np.repeat(first, size)
    value = (arr[where].astype(np.uint64) + np.uint64(1)) * _COEF[inside & 8191]
    value *= (inside >> 13).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return begin, end, mixed(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
