"""Static range asymmetric numeral system over numpy lanes.

A table of frequencies that add up to 2**16 is shared by the blocks of a group. A block holds up to
``BLOCK`` symbols dealt over lanes: symbol i belongs to lane i % lanes, so that one numpy operation
moves every lane a step. Lane states lie in [2**16, 2**32) and shed 16 bits at a time, at most once
a symbol. Every ``STRIDE`` steps the lane states and the place in the word stream are stored; each
such checkpoint starts a segment that can be decoded without the others.

Block, little-endian: magic u32, symbols u32, lanes u32, stride u32, segments u32, words u32,
crc32 of the ids u32, then place u32 and lane states u32 of every segment, then the words u16.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS, BLOCK, LANES, STRIDE = 16, 1 << 18, 2048, 64
MAGIC = 0x534E4152
_U = np.uint64
_HEAD = 7


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**16, for 1 to 2**16 symbols with counts over 0."""
    total, room = int(counts.sum()), 1 << BITS
    if not (0 < len(counts) <= room and total > 0):
        raise ValueError("1 to 65536 symbols with counts are needed")
    f = np.maximum(1, counts.astype(np.float64) * room / total).astype(np.int64)
    off = room - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if off > 0:
        f[order[0]] += off
    while off < 0:  # take from the most frequent, in proportion
        spare = f[order] - 1
        take = np.minimum(spare, np.maximum(1, spare * -off // max(1, int(spare.sum()))))
        cut = np.cumsum(take)
        take = np.where(cut <= -off, take, np.maximum(0, take - (cut + off)))
        f[order] -= take
        off += int(take.sum())
    return f


class Table:
    """Symbols (any uint32 ids) with their shared frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, quantise(counts[symbols]))

    def pack(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(np.uint32(len(gaps)).tobytes() + gaps.tobytes() + (self.freq - _U(1)).astype("<u2").tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        raw = zlib.decompress(raw)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.uint32), np.frombuffer(raw, "<u2", n, 4 + 4 * n).astype(np.uint64) + _U(1))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block of 1 or more ids, all of them in the table."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 32))
    steps = -(-n // lanes)
    back = np.zeros(int(table.symbols[-1]) + 1, np.int64)
    back[table.symbols] = np.arange(len(table.symbols))
    at = back[ids]
    f, c = table.freq[at], table.start[at]
    x = np.full(lanes, 1 << 16, np.uint64)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y, ft = x[: b - a], f[a:b]
        over = y >= (ft << _U(16))
        words.append((y[over] & _U(0xFFFF)).astype("<u2"))
        y = np.where(over, y >> _U(16), y)
        q = y // ft
        x[: b - a] = (q << _U(16)) + (y - q * ft) + c[a:b]
        if t % STRIDE == 0:
            marks.append(x.astype("<u4"))
    words.reverse()
    marks.reverse()
    place = np.concatenate(([0], np.cumsum([len(w) for w in words])))[:-1][::STRIDE].astype("<u4")
    head = np.array([MAGIC, n, lanes, STRIDE, len(marks), sum(map(len, words)), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    return b"".join([head.tobytes(), place.tobytes(), *(m.tobytes() for m in marks), *(w.tobytes() for w in words)])


def decode(block: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one segment of it. Raises ValueError where a whole block fails its checksum."""
    magic, n, lanes, stride, segments, total, crc = (int(v) for v in np.frombuffer(block, "<u4", _HEAD))
    if magic != MAGIC or len(block) != 4 * (_HEAD + segments * (1 + lanes)) + 2 * total:
        raise ValueError("not a block")
    place = np.frombuffer(block, "<u4", segments, 4 * _HEAD)
    states = np.frombuffer(block, "<u4", segments * lanes, 4 * (_HEAD + segments)).reshape(segments, lanes)
    words = np.frombuffer(block, "<u2", total, 4 * (_HEAD + segments * (1 + lanes))).astype(np.uint64)
    which = np.repeat(np.arange(len(table.freq), dtype=np.int64), table.freq.astype(np.int64))
    base = table.start[which]
    rest = np.arange(1 << BITS, dtype=np.uint64) - base  # slot less start
    scale = table.freq[which]
    steps = -(-n // lanes)
    wanted = range(segments) if segment is None else [segment]
    out = []
    for s in wanted:
        x, p = states[s].astype(np.uint64), int(place[s])
        for t in range(s * stride, min(steps, (s + 1) * stride)):
            m = min(n, (t + 1) * lanes) - t * lanes
            y = x[:m]
            slot = (y & _U(0xFFFF)).astype(np.int64)
            out.append(which[slot])
            y = scale[slot] * (y >> _U(16)) + rest[slot]
            low = np.flatnonzero(y < _U(1 << 16))
            y[low] = (y[low] << _U(16)) | words[p : p + len(low)]
            p += len(low)
            x[:m] = y
    ids = table.symbols[np.concatenate(out)] if out else np.zeros(0, np.uint32)
    if segment is None and not (x == _U(1 << 16)).all():  # where the encoder began
        raise ValueError("final states differ")
    if segment is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum differs")
    return ids
