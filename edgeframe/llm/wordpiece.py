"""Token counts with a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces popped
when it is followed, so greedy longest-match counts come from a few table steps per byte; pieces are
never built. Children are kept by row displacement: every node has an offset, its child on byte b is
at offset + b, and the entry names the node it belongs to. The tables are a few MB, made once and
broadcast. All words of a batch take their steps together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return [bytes(letters[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special]


class Automaton:
    """``counts`` gives the greedy longest-match lengths of many byte strings.

    A byte that is no piece itself counts as one unknown piece where it can't be matched.
    """

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(False)
                at = children[at][b]
            ends[at] = at > 0
        known = {b: c for b, c in children[0].items() if ends[c]}
        n = len(children)
        fail, popped = [0] * n, [0] * n
        rest = [0] * n  # pieces still to pop when the word ends here

        def follow(v: int, b: int) -> tuple[int, int]:
            """Where the links of v lead on byte b, and what they pop."""
            count = 0
            while True:
                child = (children[v] if v else known).get(b)
                if child is not None:
                    return child, count
                if not v:
                    return 0, count + 1
                count += popped[v]
                v = fail[v]

        level = list(children[0].values())
        for c in level:
            popped[c] = 1
        while level:
            deeper = []
            for v in level:
                rest[v] = popped[v] + rest[fail[v]]
                for b, child in children[v].items():
                    if ends[child]:
                        popped[child] = 1
                    else:
                        fail[child], count = follow(fail[v], b)
                        popped[child] = popped[v] + count
                    deeper.append(child)
            level = deeper
        children[0] = known
        self.offset, self.owner, self.child = _displaced(children)
        self.fail, self.popped, self.rest = np.array(fail, np.int32), np.array(popped, np.int32), np.array(rest, np.int32)
        self.popped[0] = 1  # of a byte outside the vocabulary

    def counts(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(start)
        total = np.zeros(n, np.int64)
        order = np.argsort(start - end, kind="stable")  # longest first: those still running are a prefix
        size = (end - start)[order]
        at = start[order]
        node, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        step = 0
        while m := int(np.searchsorted(-size, -step, "left")):  # words with more than ``step`` bytes
            letter = raw[at[:m] + step].astype(np.int32)
            place = self.offset[node[:m]] + letter
            found = self.owner[place] == node[:m]
            left = np.flatnonzero(~found)
            node[:m][found] = self.child[place[found]]
            while len(left):  # links, until a child or the root takes the byte
                v = node[left]
                count[left] += self.popped[v]
                left, v = left[v > 0], v[v > 0]
                v = self.fail[v]
                place = self.offset[v] + letter[left]
                found = self.owner[place] == v
                node[left] = np.where(found, self.child[place], v)
                left = left[~found]
            step += 1
        total[order] = count + self.rest[node]
        return total


def _displaced(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each node, node that owns each entry, child at it): the rows of all nodes laid over each other."""
    entries = sum(map(len, children))
    # a row finds room beyond all others at the latest
    owner = np.full(256 * sum(len(c) > 1 for c in children) + entries + 4096, -1, np.int32)
    child = np.zeros(len(owner), np.int32)
    offset = np.zeros(len(children), np.int32)
    free = owner < 0
    low = 0  # no entry below is free
    for v in sorted((v for v in range(len(children)) if len(children[v]) > 1), key=lambda v: -len(children[v])):
        letters = np.array(sorted(children[v]))
        first = max(0, low - int(letters[0]))
        while True:
            good = np.ones(2048, bool)
            for b in letters:
                good &= free[first + b : first + b + 2048]
            if good.any():
                break
            first += 2048
        offset[v] = first + int(good.argmax())
        owner[offset[v] + letters] = v
        child[offset[v] + letters] = [children[v][b] for b in letters.tolist()]
        free[offset[v] + letters] = False
        while not free[low]:
            low += 1
    # nodes with one child take any entry
    single = [v for v in range(len(children)) if len(children[v]) == 1]
    letters = np.array([b for v in single for b in children[v]], np.int64)
    place = np.flatnonzero(free[255:])[: len(single)] + 255
    owner[place], child[place], offset[single] = single, [c for v in single for c in children[v].values()], place - letters
    stop = int(offset.max()) + 256
    return offset, owner[:stop], child[:stop]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            for lo, hi, raw, at in ts.slices(batch.column(1)):
                start, end, first = ts.word_spans(raw, at, ts.SPACE)
                lead = np.zeros(len(start), np.int64)
                inner = start > np.repeat(at[:-1], np.diff(first))
                # one space before a word belongs to it
                lead[inner] = raw[start[inner] - 1] == 32
                total = np.concatenate(([0], np.cumsum(auto.counts(raw, start - lead, end))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], ["doc_id", "n_words", "n_pieces"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_pieces of each row of docs (doc_id, text).

    Words are runs other than ASCII white space; a word takes the one space before it along, other
    white space counts nothing. n_pieces is the number of pieces that greedy longest-match cuts the
    words into. Null or empty text: 0 and 0. Null and repeated doc_ids are reported row by row;
    other columns are ignored; long texts are counted whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(byte_vocabulary(vocabulary)))  # as large as the vocabulary
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ts.each_batch(base, _count(shared), "doc_id long, n_words long, n_pieces long")
