"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter is an array of masks: bit l of a slot says that language l may own an
n-gram that falls there; beyond 64 languages a mask takes more words. The AND over an n-gram's slots gives all languages that contain it in
one lookup. A document's score for a language is its count of n-grams with that bit, less the count
expected from the filter's false positives; the largest corrected share decides.

Learning counts n-grams over a bounded sample of labelled documents per language and keeps the most
frequent ``grams`` of each. The model (slots x 8 bytes, for every 64 languages) does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts

#: Bounds of learning: documents per language, n-grams kept per language.
SAMPLE, GRAMS = 4000, 12_000
SLOT_BITS, HASHES, WORD = 20, 3, 64
_U = np.uint64
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter, or 0 where it is no letter."""
    fold = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


_FOLD: list[np.ndarray] = []


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, row of each, letters of each row) of UTF-8 rows.

    Letters are folded to lower case and everything else to one blank; the n-grams are three
    characters that are not blank in the middle, within one row.
    """
    if not _FOLD:
        _FOLD.append(_tables())
    text = raw.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
    if len(heads) != len(points):  # only where the bytes are no UTF-8
        heads = np.linspace(0, max(0, len(raw) - 1), len(points)).astype(np.int64)
    first = np.searchsorted(heads, at)
    folded = _FOLD[0][np.minimum(points, 0x10FFFF)]
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    letters = np.add.reduceat(np.concatenate((folded > 0, [False])).astype(np.int64), first[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
    letters[np.diff(first) == 0] = 0
    padded = np.concatenate(([0], folded, [0])).astype(np.uint64)
    edge = np.concatenate(([-1], row, [-1]))
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[edge[:-2] != row] = 0
    right[edge[2:] != row] = 0
    mid = np.flatnonzero(folded)
    h = ts.mix((left[mid] << _U(42)) | (folded[mid].astype(np.uint64) << _U(21)) | right[mid])
    return h, row[mid], letters


def parts(raw: np.ndarray, most: int = ts.SLICE) -> Iterator[np.ndarray]:
    """One long row in parts of about ``most`` bytes, cut at ASCII white space, which no n-gram spans.

    Where none comes within as many bytes again, the cut is before a character; the two n-grams over
    it then count a blank there.
    """
    lo = 0
    while len(raw) - lo > 2 * most:
        near = raw[lo + most : lo + 2 * most]
        spot = np.flatnonzero(ts.SPACE[near])
        if not len(spot):
            spot = np.flatnonzero((near & 0xC0) != 0x80)
        hi = lo + most + (int(spot[0]) if len(spot) else 0)
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # 2**SLOT_BITS slots x words of 64 languages
    false_rate: np.ndarray  # of each language

    @classmethod
    def of(cls, langs: list[str], owned: dict[str, np.ndarray]) -> Model:
        masks = np.zeros((1 << SLOT_BITS, -(-len(langs) // WORD)), np.uint64)
        for i, lang in enumerate(langs):
            for slot in _slots(owned[lang]):
                np.bitwise_or.at(masks[:, i // WORD], slot, _U(1) << _U(i % WORD))
        fill = np.array([((masks[:, i // WORD] >> _U(i % WORD)) & _U(1)).mean() for i in range(len(langs))])
        return cls(langs, masks, fill**HASHES)

    def counts(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """n x languages: n-grams whose mask has the language's bit."""
        out = np.zeros((n, len(self.langs)))
        slots = list(_slots(h))
        for word in range(self.masks.shape[1]):
            mask = np.full(len(h), ~_U(0))
            for slot in slots:
                mask &= self.masks[slot, word]
            for i in range(word * WORD, min(len(self.langs), (word + 1) * WORD)):
                out[:, i] = np.bincount(row, (mask >> _U(i % WORD)) & _U(1), n)
        return out

    def _tally(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: n-grams by language, n-grams, letters."""
        n = len(at) - 1
        if n == 1 and len(raw) > 2 * ts.SLICE:
            some = [self._tally(p, np.array([0, len(p)])) for p in parts(raw)]
            return tuple(sum(x) for x in zip(*some, strict=True))
        h, row, letters = grams(raw, at)
        return self.counts(h, row, n), np.bincount(row, minlength=n).astype(float), letters

    def judge(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(at) - 1
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        own, total, letters = self._tally(raw, at)
        true = np.maximum(0.0, (own - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best = true.argmax(1)
        score = np.where(letters > 0, np.minimum(1.0, true[np.arange(n), best] / np.maximum(total, 1.0)), 0.0)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)], score


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    step = (h >> _U(32)) | _U(1)
    for i in range(HASHES):
        yield ((h + step * _U(i * i + i + 1)) >> _U(64 - SLOT_BITS) if i else h & _U((1 << SLOT_BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, raw, at in ts.slices(batch.column(1)):
            own = langs[lo:hi]
            some = ((p, np.array([0, len(p)])) for p in parts(raw)) if hi - lo == 1 else ((raw, at),)
            for part, ends in some:
                h, row, _ = grams(part, ends)
                for lang in set(own):
                    g, c = np.unique(h[np.isin(row, np.flatnonzero(own == lang))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])


def learn(rows: DataFrame, sample: int = SAMPLE, keep: int = GRAMS) -> Model:
    """A model from rows (doc_id, text, lang); rows without text or lang are passed over.

    The sample takes the ``sample`` rows of each language with the smallest hash of id and text, so
    it does not depend on partitioning; it is found in one scan, as a bound on the hash that leaves
    about half as many more. Every language is learned. What reaches the driver is a count and at
    most ``keep`` n-grams a language. No rows: a model that knows no language.
    """
    rows = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model.of([], {})
    bound = {lang: int(-(2**63) + 2**64 * (1.5 * sample / n)) for lang, n in size.items() if n > 2 * sample}
    if bound:
        most = F.element_at(F.create_map(*(F.lit(x) for pair in bound.items() for x in pair)), F.col("lang"))
        rows = rows.where(F.col("h") < F.coalesce(most, F.lit(2**63 - 1)))
    picked = rows.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= sample)
    counts = ts.each_batch(picked.select("lang", "text"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("i") <= keep)
    owned: dict[str, list[int]] = {lang: [] for lang in size}
    for r in top.select("lang", "gram").collect():
        owned[r.lang].append(r.gram)
    return Model.of(sorted(owned), {k: np.array(v, np.int64).view(np.uint64) for k, v in owned.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text).

    Null text or text without letters: ``und`` with score 0. Ties go to the first language by name.
    Null and repeated doc_ids are reported row by row; other columns are ignored. Very long texts
    are judged whole, in parts whose counts add up. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for every 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in ts.slices(batch.column(1)):
                lang, score = shared.value.judge(raw, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ts.each_batch(base, run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least ``least``.

    Null, empty and long texts, repeated rows and empty tables as in :func:`predict`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in ts.slices(batch.column(at_text)):
                lang, score = shared.value.judge(raw, at)
                good = (score >= least) & np.array([x != UNKNOWN for x in lang], bool)
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return ts.each_batch(docs, run, docs.schema)
