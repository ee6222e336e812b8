"""Byte-level BPE ids of whole texts, or their numbers without the ids, worked out on bytes.

The pre-token pattern is applied to the UTF-8 bytes of many texts at once. A piece of up to 16 bytes
is its own key, so that a table of plain arrays answers all pieces of a slice together, exactly and
without Python code for each; the library is asked once for each piece that the table doesn't hold.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import bpe
from . import textscan as ts

_U = np.uint64
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
#: Classes are looked up for code points below this; a text with others goes through the library's pieces.
_KNOWN = 0x20000
_SPACE, _QUOTE = 0x20, 0x27
#: The bytes of a piece's key that count, by the piece's length.
_LOW = np.array([2 ** (8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
_HIGH = np.array([2 ** (8 * max(n - 8, 0)) - 1 for n in range(17)], np.uint64)
_ONE, _TWO = np.zeros(256, bool), np.zeros(1 << 16, bool)  # what follows the quote of a contraction
_ONE[list(b"stmd")] = True
_TWO[[a << 8 | b for a, b in (b"re", b"ve", b"ll")]] = True
#: Longer pieces than this are counted anew each time.
_LONG = 128


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    every = "".join("\0" if 0xD800 <= i < 0xE000 else chr(i) for i in range(_KNOWN))
    out = np.full(_KNOWN, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, rf"[{bpe._WS}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pieces(raw: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each piece of the pattern in the first n bytes, and the rows (from at) that it doesn't serve.

    raw: UTF-8 with 16 zeros after it. Not served: white space of several bytes, unknown code points
    and zeros, which a key couldn't tell from its end.
    """
    text, table = raw[:n], _classes()
    kind = table[:256].take(text)
    odd = np.flatnonzero(text == 0)
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        first = raw[lead].astype(np.int32)
        b, c, d = (raw[lead + i].astype(np.int32) & 0x3F for i in (1, 2, 3))
        code = np.where(first < 0xE0, (first & 0x1F) << 6 | b, np.where(first < 0xF0, (first & 0xF) << 12 | b << 6 | c, (first & 7) << 18 | b << 12 | c << 6 | d))
        known = code < _KNOWN
        its = np.where(known, table.take(code, mode="clip"), _OTHER)
        odd = np.concatenate((odd, lead[~known | (its == _BLANK)]))
        kind[lead] = kind[lead + 1] = its
        for i, least in ((2, 0xE0), (3, 0xF0)):
            more = first >= least
            kind[lead[more] + i] = its[more]
    head = np.zeros(n + 3, bool)
    head[at] = True
    start = np.empty(n + 3, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[n:] = True
    start[at] = True
    # white space before something else in the row: its last one stands alone, or is the space of what follows
    blank = kind == _BLANK
    after = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    after = after[~head[after]]
    start[after - 1] = True
    start[after] = text[after - 1] != _SPACE
    quote = np.flatnonzero(text == _QUOTE)
    quote = quote[start[quote] & ~head[quote + 1]]
    one = _ONE[raw[quote + 1]]
    two = _TWO[raw[quote + 1].astype(np.int32) << 8 | raw[quote + 2]] & ~head[quote + 2]
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    return np.flatnonzero(start[:n]), np.unique(np.searchsorted(at, odd, "right") - 1)


class Table:
    """Numbers over 0 of a type by keys of 16 bytes, at most ``most`` of them before it starts anew."""

    def __init__(self, most: int, kind: type = np.uint8):
        bits = max(4, int(most * 3 // 2).bit_length())
        self.most, self.held, self.shift, self.last = most, 0, _U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros((1 << bits, 2), np.uint64)
        self.number = np.zeros(1 << bits, kind)  # 0: free
        self.owner = np.zeros(1 << bits, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * _U(0x9E3779B97F4A7C15) + (high >> _U(29)))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        return ((h * _U(0x94D049BB133111EB)) >> self.shift).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key; 0 where the table doesn't hold it."""
        slot = self._slot(low, high)
        out = self.number.take(slot)
        key = self.keys.take(slot, axis=0)
        wrong = np.flatnonzero(((key[:, 0] != low) | (key[:, 1] != high)) & (out != 0))
        slot = slot[wrong]
        while len(wrong):
            slot = slot + 1 & self.last
            number, key = self.number.take(slot), self.keys.take(slot, axis=0)
            out[wrong] = number
            on = ((key[:, 0] != low[wrong]) | (key[:, 1] != high[wrong])) & (number != 0)
            wrong, slot = wrong[on], slot[on]
        return out

    def clear(self) -> None:
        self.number[:] = 0
        self.held = 0

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Keys that are distinct and not in the table."""
        if self.held + len(low) > self.most:
            self.clear()
            low, high, number = low[: self.most], high[: self.most], number[: self.most]
        self.held += len(low)
        todo, slot = np.arange(len(low)), self._slot(low, high)
        while len(todo):
            self.owner[slot] = todo
            mine = (self.number[slot] == 0) & (self.owner[slot] == todo)
            at, i = slot[mine], todo[mine]
            self.keys[at, 0], self.keys[at, 1], self.number[at] = low[i], high[i], number[i]
            todo, slot = todo[~mine], slot[~mine] + 1 & self.last


class Counter:
    """``counts(texts)`` gives how many ids ``Bpe.encode_all`` gives for each text; null is empty.

    most: short pieces, and an eighth as many longer ones, kept before their table starts anew.
    """

    KIND: type = np.uint8  # of what is known of a short piece: its number of ids

    def __init__(self, path: str, most: int = 1_200_000):
        self.whole = bpe.Bpe(path, most // 8)
        self.short = Table(most, self.KIND)
        self.long: dict[bytes, int] = {}
        self.most = most

    def _learn(self, pieces: list[bytes], step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece of the pattern has, and the ids of all in a row."""
        out = np.zeros(len(pieces), np.int64)
        lines = np.array([b"\n" in p for p in pieces], bool)
        apart = [np.frombuffer(self.whole._ids(pieces[i].decode()), "<u4") for i in np.flatnonzero(lines).tolist()]
        out[lines] = [len(x) for x in apart]
        rest = [p for p in pieces if b"\n" not in p] if apart else pieces
        if not rest:
            return out, np.concatenate(apart) if apart else np.zeros(0, np.uint32)
        # line ends part the pieces and have no ids; the ids are told apart by their bytes
        joined = [b"\n".join(rest[i : i + step]).decode() for i in range(0, len(rest), step)]
        tok = self.whole.tok
        held, tok.pre_tokenizer = tok.pre_tokenizer, self.whole.lines
        try:
            found = tok.encode_batch_fast(joined, add_special_tokens=False)
        finally:
            tok.pre_tokenizer = held
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        ends = np.cumsum(self.whole.width[ids])
        stop = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))
        to = np.searchsorted(ends, stop) + 1
        if to[-1] != len(ends) or not (ends[to - 1] == stop).all():
            raise ValueError("the ids of joined pieces don't end where the pieces do")
        out[~lines] = np.diff(to, prepend=0)
        if apart:
            its, every = np.repeat(lines, out), np.empty(out.sum(), np.uint32)
            every[its], every[~its] = np.concatenate(apart), ids
            ids = every
        return out, ids

    def _known(self, pieces: list[bytes], keep: bool = True) -> np.ndarray:
        """What is to be known of each new piece. keep: also after this slice."""
        return self._learn(pieces)[0]

    def _short(self, data: bytes, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the 8 bytes from each place
        low, high = at[start] & _LOW[size], at[start + 8] & _HIGH[size]
        out = self.short.get(low, high)
        miss = np.flatnonzero(out == 0)
        if len(miss):
            order = np.lexsort((high[miss], low[miss]))
            miss = miss[order]
            a, b = low[miss], high[miss]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            i = miss[new]
            number = self._known([data[x:y] for x, y in zip(start[i].tolist(), (start[i] + size[i]).tolist(), strict=True)]).astype(self.KIND)
            out[miss] = number[np.cumsum(new) - 1]
            self.short.put(a[new], b[new], number)
        return out

    def _long(self, words: list[bytes]) -> list[int]:
        fresh = list({w for w in words if w not in self.long})
        if len(self.long) + len(fresh) > self.most // 8:
            self.long.clear()
            fresh = list(set(words))
        known: dict[bytes, int] = {}
        for keep in (True, False):
            some = [w for w in fresh if (len(w) <= _LONG) == keep]
            known.update(zip(some, self._known(some, keep).tolist(), strict=True))
            if keep:
                self.long.update(known)
        return [known.get(w) or self.long[w] for w in words]

    def _found(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is known of each piece, the first piece of each row, and the rows not served, which have no pieces."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        raw = np.concatenate((raw, np.zeros(16, np.uint8)))
        start, odd = pieces(raw, n, at)
        size = np.diff(start, append=n)
        row = np.searchsorted(start, at)
        if len(odd):
            good = np.ones(len(at) - 1, bool)
            good[odd] = False
            keep = np.repeat(good, np.diff(row))
            start, size, row = start[keep], size[keep], np.concatenate(([0], np.cumsum(keep)))[row]
        data = raw.tobytes()
        known = np.zeros(len(start), np.int64)
        small = size <= 16
        if small.all():
            known[:] = self._short(data, raw, start, size)
        else:
            known[small] = self._short(data, raw, start[small], size[small])
            big = np.flatnonzero(~small)
            known[big] = self._long([data[a:b] for a, b in zip(start[big].tolist(), (start[big] + size[big]).tolist(), strict=True)])
        return known, row, odd

    def _some(self, raw: np.ndarray, at: np.ndarray) -> tuple[Iterable, np.ndarray]:
        """The result of each row, and the rows not served, whose result is empty."""
        many, row, odd = self._found(raw, at)
        return np.diff(np.concatenate(([0], np.cumsum(many)))[row]), odd

    def _of(self, ids: list[bytes]) -> Iterable:
        return [len(x) // 4 for x in ids]

    def _rows(self, texts: pa.Array, most: int, longest: int) -> Iterator[tuple[np.ndarray, Iterable]]:
        """Rows with their results; the results of one row follow one another as its parts do."""
        whole = self.whole
        if not whole.split:
            yield np.arange(len(texts)), self._of(whole.encode_all([t or "" for t in texts.to_pylist()]))
            return
        aside = np.zeros(len(texts), bool)  # added tokens have ids of their own, whatever the pattern says
        for token in whole.added:
            aside |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        long = pc.fill_null(pc.greater(pc.binary_length(texts), longest), False).to_numpy(zero_copy_only=False) & ~aside
        plain = np.flatnonzero(~aside & ~long)
        column = texts if len(plain) == len(texts) else texts.take(pa.array(plain))
        for lo, hi, raw, at in ts.slices(column, most):
            got, odd = self._some(raw, at)
            yield plain[lo:hi], got
            aside[plain[lo:hi][odd]] = True
        for i in np.flatnonzero(long).tolist():
            for part in whole._cut(texts[i].as_py(), most):
                for _, got in self._rows(pa.array([part], pa.large_string()), most, max(longest, 4 * len(part))):
                    yield np.array([i]), got
        left = np.flatnonzero(aside)
        if len(left):
            yield left, self._of(whole.encode_all([texts[i].as_py() for i in left.tolist()]))

    def counts(self, texts: pa.Array, most: int = 1 << 20, longest: int = 1 << 22) -> np.ndarray:
        """most: bytes that are worked on at once. longest: bytes of a text that is not cut."""
        out = np.zeros(len(texts), np.int64)
        for rows, got in self._rows(texts, most, longest):
            out[rows] += got
        return out


class Encoder(Counter):
    """``encode(texts)`` gives the ids that ``Bpe.encode_all`` gives for each text; null is empty.

    What is known of a piece is the place of its ids in a pool, and their number. The pool starts
    anew with the tables, at 8 ids for each short piece that they can hold.
    """

    KIND = np.int64  # place << 32 | number

    def __init__(self, path: str, most: int = 1_200_000):
        super().__init__(path, most)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _known(self, pieces: list[bytes], keep: bool = True) -> np.ndarray:
        many, ids = self._learn(pieces)
        at, to = self.used, self.used + len(ids)
        if to > len(self.pool):
            self.pool = np.concatenate((self.pool[:at], np.zeros(to + to // 2 - at, np.uint32)))
        self.pool[at:to] = ids
        if keep:  # else the next slice may write over them
            self.used = to
        return (at + np.cumsum(many) - many) << 32 | many

    def _some(self, raw: np.ndarray, at: np.ndarray) -> tuple[Iterable, np.ndarray]:
        if self.used > 8 * self.most:
            self.short.clear()
            self.long.clear()
            self.used = 0
        known, row, odd = self._found(raw, at)
        place, many = known >> 32, known & 0xFFFFFFFF
        stop = np.concatenate(([0], np.cumsum(many)))
        ids = self.pool.take(np.repeat(place - stop[:-1], many) + np.arange(stop[-1])).astype("<u4", copy=False).tobytes()
        edge = (4 * stop[row]).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:], strict=False)], odd

    def _of(self, ids: list[bytes]) -> Iterable:
        return ids

    def encode(self, texts: pa.Array, most: int = 1 << 20, longest: int = 1 << 22) -> list[bytes]:
        """Little-endian uint32 ids as bytes; ``most`` and ``longest`` as in :meth:`counts`."""
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        for rows, got in self._rows(texts, most, longest):
            for i, ids in zip(rows.tolist(), got, strict=True):
                out[i].append(ids)
        return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=1)
def load(path: str) -> Counter:
    """One per worker process, until a stage without it."""
    ts.HELD.append(load.cache_clear)
    return Counter(path)


@functools.lru_cache(maxsize=1)
def load_encoder(path: str) -> Encoder:
    """As :func:`load`."""
    ts.HELD.append(load_encoder.cache_clear)
    return Encoder(path)
