"""Byte-level BPE through the tokenizers library, with a memo over pre-tokens.

A byte-level BPE file splits a text by a fixed pattern and then merges inside each piece, so the ids
of a text are the ids of its pieces in a row. Pieces repeat far more often than texts do; each
worker asks the library once per piece and keeps a bounded table of the answers.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import textscan as ts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token pattern of byte-level BPE files that set use_regex, white space spelled out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_BLANK = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_STOPS, _LATIN_END = ".,;:!?", "\u0250"


class Bpe:
    """``encode_all(texts)`` gives little-endian uint32 ids as bytes, a value for each text.

    These are the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the
    strings of added tokens in a text give their one id.

    The text falls at single spaces between other characters, where the pattern always splits; such
    chunks are looked up whole, each distinct one of a slice once. Texts with other runs of white
    space go piece by piece. most: chunks, and pieces, kept before their table starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.lines = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        added = spec.get("added_tokens") or []
        self.split = self.split and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # the library parts a text by added tokens before anything else; of two at one place the longer counts
        self.part = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        self.find = regex.compile(PATTERN).findall
        self.most = most
        self.memo: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.safe = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)
        for piece, i in self.tok.get_vocab().items():
            self.width[i] = len(piece)  # one letter stands for one byte

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        words = []
        for p in pieces:
            if p[-1] in _BLANK:
                self.memo[p] = self._ids(p)
            else:
                words.append(p)
        self.memo.update(zip(words, self._batch(words), strict=True))

    def _batch(self, words: list[str], step: int = 64) -> Iterator[bytes]:
        """Ids of each word; no word ends in a blank."""
        # joined by line ends, which the pattern always splits off; the ids are told apart by their bytes
        joined = ["\n".join(words[i : i + step]) for i in range(0, len(words), step)]
        return self._apart(words, joined, step, 1)

    def _plain(self, words: list[str], step: int = 64) -> Iterator[bytes]:
        """Ids of words of one space and letters, which the pattern never splits: line ends alone part them."""
        joined = ["\n".join(words[i : i + step]) for i in range(0, len(words), step)]
        held = self.tok.pre_tokenizer
        self.tok.pre_tokenizer = self.lines
        try:
            return self._apart(words, joined, step, 0)
        finally:
            self.tok.pre_tokenizer = held

    def _apart(self, words: list[str], joined: list[str], step: int, gap: int) -> Iterator[bytes]:
        """Ids of each word from those of the joined ones, where ``gap`` ids stand for each line end."""
        found = self.tok.encode_batch_fast(joined, add_special_tokens=False)
        return self._cut_ids(words, [np.array(e.ids, "<u4") for e in found], step, gap)

    def _cut_ids(self, words: list[str], found: list[np.ndarray], step: int, gap: int) -> Iterator[bytes]:
        for i, ids in enumerate(found):
            part = words[step * i : step * i + step]
            ends = np.cumsum(self.width[ids])
            sizes = np.array([len(w.encode()) for w in part])
            stop = np.cumsum(sizes + gap) - gap
            to = np.searchsorted(ends, stop) + 1
            if not (ends[to - 1] == stop).all():
                raise ValueError("the ids of joined words don't end where the words do")
            frm = np.concatenate(([0], to[:-1] + gap))
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip((4 * frm).tolist(), (4 * to).tolist(), strict=True))

    def _pieces(self, found: list[list[str]]) -> list[bytes]:
        memo = self.memo
        missing = {p for x in found for p in x if p not in memo}
        if len(memo) + len(missing) > self.most:
            memo.clear()
            missing = set().union(*found)
        self._learn(missing)
        return [b"".join(map(self.memo.__getitem__, x)) for x in found]

    def _known(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of each distinct chunk after one space; None for chunks that a blank starts or ends.

        A Latin word with one mark after it is that word and the mark, as the pattern parts them.
        """
        known = self.chunks
        out = [known.get(c) for c in chunks]
        missing = [i for i, ids in enumerate(out) if ids is None and (c := chunks[i]) and c[0] not in _BLANK and c[-1] not in _BLANK]
        core = {i: c[:-1] for i in missing if (c := chunks[i])[-1] in _STOPS and c[:-1].isalpha() and max(c) < _LATIN_END}
        fresh = list({core.get(i) or chunks[i] for i in missing})
        if len(known) + len(fresh) > self.most:
            known.clear()
            fresh = list({core.get(i) or chunks[i] for i in missing})
        else:
            fresh = [c for c in fresh if c not in known]
        plain = [c for c in fresh if c.isalpha() and max(c) < _LATIN_END]
        mixed = [c for c in fresh if not c.isalpha() or max(c) >= _LATIN_END]
        known.update(zip(plain, self._plain([" " + c for c in plain]), strict=True))
        known.update(zip(mixed, self._batch([" " + c for c in mixed]), strict=True))
        marks = dict(zip(_STOPS, self._pieces([[c] for c in _STOPS]), strict=True))
        for i in missing:
            c = chunks[i]
            out[i] = known[core[i]] + marks[c[-1]] if i in core else known[c]
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = lists.offsets.to_numpy()
        tail = np.ones(len(lists.values), bool)
        tail[first[:-1]] = False
        coded = lists.values.filter(pa.array(tail)).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        edge = first - np.arange(len(first))  # first chunk of each text, its head left out
        ids = self._known(coded.dictionary.to_pylist())
        odd = np.concatenate(([0], np.cumsum(np.array([x is None for x in ids], bool)[at])))
        odd = odd[edge[1:]] > odd[edge[:-1]]
        # ids of all chunks in a row, gathered from those of the distinct ones
        pool = np.frombuffer(b"".join(x or b"" for x in ids), "<u4")
        size = np.array([len(x or b"") // 4 for x in ids], np.int64)
        start = np.cumsum(size) - size
        many = size[at]
        stop = np.cumsum(many)
        every = pool[np.repeat(start[at] - stop + many, many) + np.arange(many.sum())].tobytes()
        bound = 4 * np.concatenate(([0], stop))[edge]
        heads = lists.values.take(pa.array(first[:-1])).to_pylist()
        # other runs of white space: piece by piece
        whole = [bool(o or (h and h[-1] in _BLANK and b > a)) for o, h, a, b in zip(odd.tolist(), heads, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        front = self._pieces([self.find(t if w else h) for t, h, w in zip(texts, heads, whole, strict=True)])
        return [f if w else f + every[a:b] for f, w, a, b in zip(front, whole, bound[:-1].tolist(), bound[1:].tolist(), strict=True)]

    def _cut(self, text: str, most: int) -> list[str]:
        """Slices of about ``most`` characters that fall at chunk borders."""
        out, at = [], 0
        while len(text) - at > most and (m := self.safe.search(text, at + most)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode_all(self, texts: list[str], most: int = 1 << 22) -> list[bytes]:
        if not self.split:
            return [self._ids(t) for t in texts]
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if self.part and any(a in t for a in self.added):
                out += self._some(some) if some else []
                out.append(b"".join(self.added.get(p) or self.encode_all([p], most)[0] for p in self.part(t) if p))
                some, size = [], 0
                continue
            if len(t) > most:
                out += self._some(some) if some else []
                out.append(b"".join(self._some([p])[0] for p in self._cut(t, most)))
                some, size = [], 0
                continue
            some.append(t)
            size += len(t)
            if size > most:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some) if some else out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=1)
def load(path: str, most: int = 1_000_000) -> Bpe:
    """One per worker process, until a stage without it."""
    ts.HELD.append(load.cache_clear)
    return Bpe(path, most)
