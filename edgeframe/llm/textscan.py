"""Vectorised word scanning over Arrow string columns.

Words are found on UTF-8 bytes, which is exact because every separator used here is ASCII. A word's
64-bit hash is a polynomial over random byte values, taken from one running sum over the whole
batch, so no Python code runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 8 + 3 & (2**64 - 1)
_BACK = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that are worked on at once.
SLICE = 1 << 18

#: True for the bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x41:0x5B] = NON_ALNUM[0x61:0x7B] = False


#: Spark's setting of the bytes in a batch for Python, its default, and the bound used here.
BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


#: What clears the tables that a worker process keeps from one task to the next.
HELD: list[Callable[[], None]] = []


def let_go() -> None:
    """Clear the tables that earlier stages left in this worker, and give freed memory back."""
    if not HELD:
        return
    for clear in HELD:
        clear()
    HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def each_batch(rows: DataFrame, run: Callable, schema, keep: bool = False) -> DataFrame:
    """``rows.mapInArrow`` with batches of a few MB, so that the memory of a task does not depend on how long texts are.

    A bound that the session sets itself stays. keep: the tables in :data:`HELD` are this stage's own.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_DEFAULT):
        conf.set(BATCH_SETTING, BATCH)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)

    return rows.mapInArrow(run if keep else lean, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n + n // 4, 1 << 16)
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(size, _U(base), np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the start of each row in them (n + 1); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (n + 1)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~separator[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = at[:-1]
    before[edge[edge < n]] = False  # a row never continues the word of the row before it
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each word, A-Z taken as a-z. Worked out over about ``most`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        a = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, a + most, "right")))
        part = raw[a : end[hi - 1]]
        up, back = _powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, over the array without regard to rows (len - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _STEP[0]
    for i in range(1, k):
        out = out + words[i : n + i] * _STEP[i % 64] * _U(2 * (i // 64) + 1)
    return mix(out + _U(k))


def scan(column: pa.Array, separator: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, first word of each row) over slices of about ``most`` bytes."""
    for lo, hi, raw, at in slices(column, most):
        start, end, first = word_spans(raw, at, separator)
        yield lo, hi, word_hashes(raw, start, end), first


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of about ``most`` bytes at once, 4096 at most; one longer row comes alone."""
    raw, at = text_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + 4096)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
