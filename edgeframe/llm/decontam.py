"""Benchmark decontamination by winnowing.

A fingerprint is the smallest k-gram hash of each window of k-gram hashes, the right one on a tie.
With k-grams of 5 words and windows of 6, any 10 words that a document shares with an item give both
the same fingerprint. Documents look their fingerprints up in the benchmark's; each hit is extended
by testing the 10-word windows over it, which keeps the work linear in the document however often a
phrase repeats. Items of fewer than 10 words are windows of their own length.

A benchmark of up to ``BLOCK_BYTES`` is broadcast as lookup tables; documents are then read once and
never shuffled. A larger one is joined: its windows are a table, and documents look their fingerprints
up in a Bloom filter of fixed size, so that only windows over likely hits are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .scratch import Scratch

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:long,last:long>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def winnow(grams: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Sorted places of the fingerprints among the k-gram hashes of many rows.

    first: first k-gram of each row; the last entry ends the last row. A row of fewer than ``window``
    k-grams has none: no shared span is long enough.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = grams[:n].copy()
    at = np.zeros(n, np.int64)
    for i in range(1, window):
        other = grams[i : n + i]
        less = other <= best
        best[less] = other[less]
        at[less] = i
    row_end = np.repeat(first[1:], np.diff(first))[:n]  # windows must end inside their row
    fits = np.arange(n) + window <= row_end
    return np.unique((np.arange(n) + at)[fits])


def row_grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes that lie inside one row, the word each starts at, and the first of each row (n + 1)."""
    count = np.maximum(0, np.diff(first) - k + 1)
    to = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(first[:-1] - to[:-1], count) + np.arange(to[-1])
    return ts.runs(words, k)[start] if len(start) else np.zeros(0, np.uint64), start, to


def item_windows(words: np.ndarray, first: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: (length, hash of each window, row it is from). Rows of fewer words than ``window`` are one."""
    size = np.diff(first)
    for n in np.unique(size[(size > 0) & (size < window)]).tolist():
        rows = np.flatnonzero(size == n)
        yield n, _runs_at(words, first[rows], n), rows
    grams, start, _ = row_grams(words, first, window)
    yield window, grams, np.searchsorted(first, start, "right") - 1


def fingerprints(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the fingerprints of all rows."""
    small, at, to = row_grams(words, first, gram)
    chosen = winnow(small, to, window - gram + 1)
    return small[chosen], at[chosen]


def over(at: np.ndarray, first: np.ndarray, window: int, gram: int) -> np.ndarray:
    """First words of the windows that hold a whole fingerprint which starts at one of ``at``."""
    near = (at[:, None] - np.arange(window - gram + 1)).ravel()
    near = np.unique(near[near >= 0])
    row = np.searchsorted(first, near, "right") - 1
    return near[near + window <= first[np.minimum(row + 1, len(first) - 1)]]


class Block:
    """Lookup tables of some items. texts and ids are lists; items without words are left out."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = ids, window, gram
        marks: list[np.ndarray] = []
        keys: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for lo, _, words, first in ts.scan(pa.array(texts, pa.string()), ts.NON_ALNUM):
            for n, hashes, rows in item_windows(words, first, window):
                keys.setdefault(n, []).append(hashes)
                owners.setdefault(n, []).append(rows + lo)
            marks.append(fingerprints(words, first, window, gram)[0])
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in keys.items():
            k, o = np.concatenate(parts), np.concatenate(owners[n])
            order = np.lexsort((o, k))
            unique, at = np.unique(k[order], return_index=True)
            if len(unique):
                self.tables[n] = unique, np.concatenate((at, [len(k)])), o[order]

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: (length, word where an occurring window starts, key of the window in tables[length])."""
        for n, (unique, _, _) in self.tables.items():
            if n < self.window:
                grams, start, _ = row_grams(words, first, n)
            else:
                marks, at = fingerprints(words, first, n, self.gram)
                start = over(at[_inside(marks, self.marks)], first, n, self.gram)
                grams = _runs_at(words, start, n)
            place = np.minimum(np.searchsorted(unique, grams), len(unique) - 1)
            hit = unique[place] == grams
            yield n, start[hit], place[hit]


def _inside(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _runs_at(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    near = words[start[:, None] + np.arange(n)]  # each row is one run
    out = near[:, 0] * ts._STEP[0]
    for i in range(1, n):
        out = out + near[:, i] * ts._STEP[i]
    return ts.mix(out + np.uint64(n))


def _hits(block: Block, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and the ids of the items that each row holds a window of."""
    change = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for size, start, key in block.find(words, first):
        np.add.at(change, start, 1)
        np.add.at(change, start + size, -1)
        _, at, owner = block.tables[size]
        row = np.searchsorted(first, start, "right") - 1
        for r, k in np.unique(np.stack((row, key), 1), axis=0).tolist():
            items.setdefault(r, set()).update(block.ids[o] for o in owner[at[k] : at[k + 1]].tolist())
    return np.cumsum(change[:-1]) > 0, items


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(1), ts.NON_ALNUM):
                n = hi - lo
                hit, items = _hits(shared.value, words, first)
                total = np.concatenate(([0], np.cumsum(hit)))
                hits = total[first[1:]] - total[first[:-1]]
                found = [sorted(items.get(r, ())) for r in range(n)]
                spans = [_spans(hit[first[r] : first[r + 1]]) if hits[r] else [] for r in range(n)]
                digest = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.diff(first)), pa.array(hits), pa.array([len(f) for f in found], pa.int64()), pa.array(digest), pa.array(hits > 0), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )

    return run


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs of
    non-ASCII characters, digits and letters, A-Z lower-cased. A window is ``window`` consecutive
    words of an item, or the whole item where it has fewer; a document word inside any occurrence of
    a window is hit, and spans gives the hit runs as first and last word. items: ids (as strings,
    sorted, each once) of the items with an occurring window.

    Null text has no words. Items without words or with a null id are left out. Null and repeated
    doc_ids are reported row by row. Long texts are scanned whole. An empty benchmark hits nothing;
    empty docs give no rows. A benchmark of more than ``block_bytes`` of text is joined, not broadcast.
    """
    block = _block(benchmark, window, gram, block_bytes)
    if block is not None:
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return ts.each_batch(base, _scan(block), SCHEMA)
    rows, hits, owned = _joined(docs, benchmark, window, gram)
    spans = hits.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    spans = spans.select(*KEY, F.array_sort("runs").alias("runs")).mapInArrow(_merged, "k1 long, k2 long, n_hit long, spans array<struct<first:long,last:long>>")
    items = owned.groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("items"))
    # a text without hits has no row on the right
    out = rows.select("doc_id", *KEY, "n_words").join(spans.join(items, KEY), KEY, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), "items", F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark.

    Null, empty and long texts, repeated rows and empty tables as in :func:`contamination`.
    """
    block = _block(benchmark, window, gram, block_bytes)
    if block is None:
        _, hits, _ = _joined(docs, benchmark, window, gram)
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key())
        return whole.join(hits.select(*KEY).distinct(), KEY, "left_anti").select("row.*")
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(at_text), ts.NON_ALNUM):
                hit, _ = _hits(block.value, words, first)
                total = np.concatenate(([0], np.cumsum(hit)))
                yield batch.slice(lo, hi - lo).filter(pa.array(total[first[1:]] == total[first[:-1]]))

    return ts.each_batch(docs, run, docs.schema)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")


def _block(benchmark: DataFrame, window: int, gram: int, block_bytes: int):
    """The broadcast lookup tables of all items, or None where these hold more than ``block_bytes``."""
    if not 0 < gram <= window:
        raise ValueError("gram must be 1 to window")
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 32)).first()[0] or 0) > block_bytes:
        return None
    rows = items.collect()  # block_bytes at most
    return benchmark.sparkSession.sparkContext.broadcast(Block([r.id for r in rows], [r.text for r in rows], window, gram))


#: Columns that name a text: two 64-bit hashes.
KEY = ["k1", "k2"]
#: Bits of the Bloom filter of fingerprints, 8 MB.
FILTER_BITS = 26


def _key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return (ts.mix(h + np.uint64(n)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words) of every row, (k1, k2, start, n) of every occurring window, (k1, k2, id) of every item."""
    scratch = Scratch(docs.sparkSession, "decontam")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(1), ts.NON_ALNUM):
                ids = batch.column(0).slice(lo, hi - lo)
                for n, hashes, rows in item_windows(words, first, window):
                    slots = _slot(hashes, n) if n < window else np.zeros(len(hashes), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), n, np.int32)), pa.array(hashes.view(np.int64)), ids.take(pa.array(rows)), pa.array(slots + 1, mask=np.full(len(rows), n == window))], ["n", "h", "id", "slot"])
                marks = _slot(fingerprints(words, first, window, gram)[0], window)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(marks), pa.int32()), pa.nulls(len(marks), pa.int64()), pa.nulls(len(marks), pa.string()), pa.array(marks + 1)], ["n", "h", "id", "slot"])

    made = scratch.keep(ts.each_batch(_items(benchmark), of_items, "n int, h long, id string, slot long"), "windows")
    windows = made.where("n is not null").select("n", "h", "id").distinct()
    short = sorted(r.n for r in made.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    # a fixed number of pieces of 4 KB, whatever the benchmark's size
    for r in made.where("slot is not null").groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toLocalIterator():
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def likely(h: np.ndarray, n: int) -> np.ndarray:
        slot = _slot(h, n)
        return (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(1), ts.NON_ALNUM):
                marks, at = fingerprints(words, first, window, gram)
                start = over(at[likely(marks, window)], first, window, gram)
                found = [(np.full(len(start), window, np.int32), start, _runs_at(words, start, window))]
                for n in short:
                    hashes, start, _ = row_grams(words, first, n)
                    some = likely(hashes, n)
                    found.append((np.full(int(some.sum()), n, np.int32), start[some], hashes[some]))
                n, start, h = (np.concatenate(x) for x in zip(*found, strict=True))
                row = np.searchsorted(first, start, "right") - 1
                order = np.argsort(row, kind="stable")
                to = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int32)
                seen = pa.StructArray.from_arrays([pa.array(n[order]), pa.array((start - first[row])[order]), pa.array(h[order].view(np.int64))], ["n", "start", "h"])
                ids, k1, k2 = (batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays([ids, k1, k2, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(to), seen)], ["doc_id", *KEY, "n_words", "seen"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_key())
    rows = scratch.keep(ts.each_batch(base, of_docs, "doc_id long, k1 long, k2 long, n_words long, seen array<struct<n:int,start:long,h:long>>"), "rows")
    seen = rows.where("size(seen) > 0").dropDuplicates(KEY).select(*KEY, F.inline("seen"))
    hits = scratch.keep(seen.join(windows.select("n", "h").distinct(), ["n", "h"], "left_semi"), "hits")
    owned = hits.select(*KEY, "n", "h").distinct().join(windows, ["n", "h"]).select(*KEY, "id")
    return rows, hits.select(*KEY, "start", "n"), owned


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a text, in order of their starts, as the stretches that they cover."""
    for batch in batches:
        hits, spans = [], []
        for runs in batch.column(2).to_pylist():
            own: list[dict[str, int]] = []
            for r in runs:
                last = r["start"] + r["n"] - 1
                if own and r["start"] <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(own[-1]["last"], last)
                else:
                    own.append({"first": r["start"], "last": last})
            hits.append(sum(x["last"] - x["first"] + 1 for x in own))
            spans.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(_SPAN))], [*KEY, "n_hit", "spans"])
