"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one numpy pass over the UTF-8 bytes of whole texts. The trees are complete
binary trees of one depth, flattened into arrays, so a batch of documents walks all trees level by
level with one gather each. Learning takes a bounded sample of labelled rows to the driver (a matrix
of ``SAMPLE`` x features floats); scoring touches only the document's own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

#: Bound of learning: labelled documents.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 4, 80, 0.15, 1.0, 5.0
CUT = 0.3

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "lower", "digit", "blank", "newline", "beyond_ascii", "sentence_end", "comma", "exclamation",
    "pipe", "symbol", "quote", "words_distinct", "words_top", "words_repeated_next", "pairs_distinct", "lines_distinct", "mean_line", "words_ending_odd", "capital_words",
)

KINDS = 13
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10,), range(128, 256), b".?", b",;:", b"!", b"|", b"#$%&*@^~<>=+\\_`{}[]/", b"\"'()-"), 1):
    _KIND[list(_chars)] = _i
_ODD_END = np.isin(np.arange(KINDS), (8, 9, 10, 11))
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _runs(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in each of n rows, and the count of the most frequent one."""
    # 16 bits of the row over 48 of the hash: one sort
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    own = (key[head] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, own, np.diff(np.append(head, len(key))))
    return np.bincount(own, minlength=n), most


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x FEATURES, float32, of fewer than 65536 rows; a row without bytes is all zeros, as are shares of nothing."""
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(raw):
        return out
    start, end, first = ts.word_spans(raw, at, ts.SPACE)
    words = ts.word_hashes(raw, start, end)
    ls, le, line_first = ts.word_spans(raw, at, _LINE)
    lines = ts.word_hashes(raw, ls, le)
    kind = _KIND[raw]
    size, m, many_lines = np.diff(at), np.diff(first), np.diff(line_first)
    every = np.arange(n)
    of_word, of_line = np.repeat(every, m), np.repeat(every, many_lines)
    some, one = np.maximum(size, 1), np.maximum(m, 1)

    def tally(row: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x, n)

    bytes_of = np.bincount(np.repeat(every * KINDS, size) + kind, minlength=n * KINDS).reshape(n, KINDS) if n > 1 else np.bincount(kind, minlength=KINDS)[None, :]
    out[:, 4:16] = bytes_of[:, 1:] / some[:, None]
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(m)
    length = end - start
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of_word, length)
    out[:, 2], out[:, 3] = tally(of_word, length) / one, np.log1p(longest)
    distinct, most = _runs(of_word, words, n)
    out[:, 16], out[:, 17] = distinct / one, most / one
    inside = of_word[1:] == of_word[:-1]  # neighbours in one row
    next_one = np.maximum(m - 1, 1)
    out[:, 18] = tally(of_word[1:][inside], words[1:][inside] == words[:-1][inside]) / next_one
    out[:, 19] = _runs(of_word[1:][inside], ts.runs(words, 2)[inside], n)[0] / next_one
    out[:, 20] = _runs(of_line, lines, n)[0] / np.maximum(many_lines, 1)
    out[:, 21] = np.where(many_lines > 0, np.log1p(size / np.maximum(many_lines, 1)), 0)
    out[:, 22] = tally(of_word, _ODD_END[kind[end - 1]]) / one
    out[:, 23] = tally(of_word, kind[start] == 1) / one
    return out


@dataclass
class Trees:
    """Flattened complete trees: inner node i of a tree has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray  # same; right where the value is greater
    leaf: np.ndarray  # trees x 2**depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1] if self.feature.size else 0
        depth = inner.bit_length()
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1 (logistic loss, second-order gains). One class: its smoothed share."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    if n < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: at most edges[b]
    cell = binned + np.arange(width) * BINS
    raw = np.full(n, base)
    features_, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            many, low = 2**level, 2**level - 1
            key = (node[:, None] * (width * BINS) + cell).ravel()
            shape = (many, width, BINS)
            gs = np.bincount(key, np.repeat(g, width), many * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, width), many * width * BINS).reshape(shape).cumsum(2)
            cs = np.bincount(key, minlength=many * width * BINS).reshape(shape).cumsum(2)
            gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(cs < LEAST) | (ct - cs < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, s = divmod(b, BINS)
                if gain[k, j, s] > 1e-9 and s < len(edges[j]):
                    feature[low + k], cut[low + k] = j, edges[j][s]
            node = 2 * node + (x[np.arange(n), feature[low + node]] > cut[low + node])
        gl, hl = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = -rate * gl / (hl + L2)
        raw += leaf[node]
        features_.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(base, np.stack(features_), np.stack(cuts), np.stack(leaves))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in ts.slices(batch.column(1)):
            x = features(raw, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, batch.column(2).slice(lo, hi - lo)], ["doc_id", "x", "h"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Trees from docs (doc_id, text) and labels (doc_id, ``label`` 0 or 1).

    Learns from the ``sample`` labels with the smallest hash of id; labels that are null or neither 0
    nor 1 are passed over, repeated ones count each. Of rows that repeat a doc_id, the text with the
    smallest hash counts for the label. No labels at all: a constant score of 0.5.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = chosen.groupBy("doc_id").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    # at most ``sample`` ids with as many labels; one row of statistics an id
    found = ts.each_batch(text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h")), _rows, "doc_id long, x array<float>, h long")
    found = found.groupBy("doc_id").agg(F.min_by("x", F.struct("h", "x")).alias("x"))
    rows = found.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", F.explode("ys").alias("y")).orderBy("doc_id", "y").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks]).reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= cut) of each row of docs (doc_id, text).

    Null text counts as empty, which scores like any text without bytes. Null and repeated doc_ids
    are reported row by row; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in ts.slices(batch.column(1)):
                s = shared.value.score(features(raw, at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ts.each_batch(base, run, "doc_id long, score double, predicted int")


def accept(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in ts.slices(batch.column(at_text)):
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.score(features(raw, at)) >= cut))

    return ts.each_batch(docs, run, docs.schema)
