"""Variable-capacity best-fit packing.

Each task packs the documents of its own partition, so nothing is shuffled and no group outgrows a
task: after ``flush`` pieces the task closes its bins and starts anew. Within such a run the pieces
go longest first into the fullest open bin that takes them. Where none does, each permitted size is
tried on the lengths still to come: the size whose cost per token that it would hold is least is
opened. The cost of a size grows faster than the size (a sequence is attended to all over), so that
a long bin is worth opening for long pieces only. At the end each bin shrinks to the smallest
permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpecount
from . import textscan as ts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces that a size is tried on; what is left of the bin then counts as filled where enough is to come.
AHEAD = 16
SCHEMA = "doc_id long, piece long, n_pieces long, length long, bin_id long, bin_capacity long, bin_offset long"


def attention_cost(capacity: int) -> float:
    """Cost of a sequence: a part in proportion to its length, and one to the square of it."""
    return capacity + capacity * capacity / 8192


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and the capacity of each bin; every length is 1 to the largest capacity.

    Equal lengths keep their order; of bins with the same room the last one that came to it is
    filled first, and of sizes with the same cost per token the smaller one is opened.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    # rising[j]: lengths from the smallest; a length's place from the other end tells what is still to come
    rising = down[::-1].tolist()
    sums = [0, *accumulate(rising)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by the room left in them
    filled = 0  # bit r: there are bins with room r
    used: list[int] = []

    def holds(n: int, capacity: int, left: int) -> int:
        """Tokens of a bin opened for n, filled longest first from the ``left`` smallest lengths."""
        space = capacity - n
        for _ in range(AHEAD):
            left = bisect_right(rising, space, 0, left)
            if not left:
                return capacity - space
            left -= 1
            space -= rising[left]
        return capacity - space + min(space, sums[left])

    for i, (place, n) in enumerate(zip(order.tolist(), down.tolist(), strict=True)):
        fit = filled >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                filled &= ~(1 << left)
        else:
            to_come = len(down) - i - 1
            left = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / holds(n, c, to_come), c))
            b = len(used)
            used.append(0)
        where[place], offset[place] = b, used[b]
        used[b] += n
        left -= n
        if left:
            room[left].append(b)
            filled |= 1 << left
    small = np.searchsorted(sizes, used)
    return where, offset, np.array(sizes, np.int64)[small] if used else np.zeros(0, np.int64)


def pieces(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, pieces of the row, length) where rows longer than ``most`` fall into pieces of that length and a rest."""
    many = np.maximum(1, -(-lengths // most))
    row = np.repeat(np.arange(len(lengths)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, piece, many[row], np.minimum(most, lengths[row] - piece * most)


def _pack(capacities: tuple[int, ...], cost: Callable[[int], float], flush: int):
    most = max(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins, held = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            nonlocal bins
            ids = pa.concat_arrays([b.column(0) for b in held])
            row, piece, many, n = pieces(np.concatenate([b.column(1).to_numpy() for b in held]), most)
            where, offset, size = best_fit(n, capacities, cost)
            out = [ids.take(pa.array(row)), pa.array(piece), pa.array(many), pa.array(n), pa.array((shard << 40) + bins + where), pa.array(size[where]), pa.array(offset)]
            bins += len(size)
            held.clear()
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in SCHEMA.split(", ")])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows + int(batch.column(1).to_numpy().sum() // most)  # at least the pieces
            if count >= flush:
                yield close()
                count = 0
        if count:
            yield close()

    return run


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpecount.load(path).counts
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1)) + 1)], ["doc_id", "length"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and length: ids of the whole text with its end id; null or empty text has 1.

    A row for each row of docs, also for null and repeated doc_ids; other columns are ignored. Long
    texts are encoded in parts that meet where tokens never cross.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ts.each_batch(rows, _lengths(tokenizer), "doc_id long, length long", keep=True)


def pack_documents(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost, flush: int = 100_000) -> DataFrame:
    """:func:`pack` of :func:`token_lengths`, both in one Python worker of a task."""
    count, fill = _lengths(tokenizer), _pack(tuple(capacities), cost, flush)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ts.each_batch(rows, lambda batches: fill(count(batches)), SCHEMA, keep=True)


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost, flush: int = 100_000) -> DataFrame:
    """A row for each piece of each row of ``lengths`` (doc_id, length).

    Columns: doc_id, piece (from 0), n_pieces, length, bin_id, bin_capacity, bin_offset. Pieces of a
    bin fill it from offset 0 without gaps; no bin is overfull. A null or smaller length counts as
    1, a null doc_id is packed like any other, repeated rows are packed each, ties keep the order of
    the rows. Rows longer than the largest capacity fall into pieces of it and a rest. Extra columns
    are ignored; an empty table gives no rows.

    cost: of a bin of each capacity. flush: about how many pieces a task packs together.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(1), F.coalesce(F.col("length").cast("long"), F.lit(1))).alias("length"))
    return rows.mapInArrow(_pack(tuple(capacities), cost, flush), SCHEMA)
