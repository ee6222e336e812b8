"""K-d tree partitioning into shards of near equal bytes.

A node of the tree is split at the weighted median of its widest dimension. The median is found by
distributed histograms of 2048 cells on a 55-bit order key (dimension, then text, then row): a few
aggregations per level over a narrow table, each returning a bounded number of cells. The text is
read once, for its size and hash. Equal texts have equal coordinates and stay together unless their
group straddles a cut and is too heavy to leave whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import ranges
from .scratch import Scratch

CELL = 11
KEY_BITS = 55  # 12 of the dimension, 32 of the text, 11 of the row
ROW_BITS = 11
SLACK = 0.001  # share of a node's bytes that a cut may be off to keep a group whole

DIMENSIONS = ("size", "script", "lines")


def _dimension(name: str) -> Column:
    """A dimension in 12 bits, from the text alone: size, share of bytes beyond ASCII, or lines."""
    if name == "size":
        value = F.log2(F.col("size").cast("double")) * 128
    elif name == "script":
        value = (F.col("size") - 1 - F.col("chars")) / F.greatest(F.col("chars"), F.lit(1)) * 1365
    else:
        value = F.log2(F.col("lines").cast("double") + 1) * 128
    return F.least(F.lit(4095), F.floor(value)).cast("long")


@dataclass
class Node:
    parts: int  # shards below it
    first: int  # its first shard
    path: list[tuple[str, int, bool]] = field(default_factory=list)  # (dimension, cut, right of it)


def _key(dim: str) -> Column:
    text = F.col("text_crc32").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.col(f"d_{dim}"), 43).bitwiseOR(F.shiftleft(text, ROW_BITS)).bitwiseOR(F.col("tie"))


def _where(nodes: list[Node], value) -> Column:
    """value(node) of the node that a row lies in; the tests are nested as in the tree."""

    def build(group: list[tuple[list[tuple[str, int, bool]], Node]]) -> Column:
        if len(group) == 1:
            return F.lit(value(group[0][1]))
        dim, cut, _ = group[0][0][0]
        left = build([(p[1:], n) for p, n in group if not p[0][2]])
        right = build([(p[1:], n) for p, n in group if p[0][2]])
        return F.when(_key(dim) < cut, left).otherwise(right)

    return build([(n.path, n) for n in nodes])


def kd_shards(docs: DataFrame, shards: int = 16, chunk: int = 100_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: unsigned, of null 0. law is
    ``bytes``. slot numbers the rows of a shard from 0 without gaps, in order of doc_id (null
    first), then text hash. Null and repeated doc_ids are placed row by row; exact repeats of a row
    may share their order key and then stay in one shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"), (F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("")))).alias("lines"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("mix"))
    base = base.select("doc_id", "size", "text_crc32", *(_dimension(n).alias(f"d_{n}") for n in DIMENSIONS), F.shiftrightunsigned(F.xxhash64("doc_id", "mix"), 64 - ROW_BITS).alias("tie"))
    flat = scratch.keep(base, "points")
    leaves = [Node(shards, 0)]
    if shards > 1 and flat.limit(1).count():
        leaves = _grow(flat, leaves)
    placed = flat.select("doc_id", "size", "text_crc32", "tie", _where(leaves, lambda n: n.first).cast("int").alias("shard"))
    # rows of a shard are numbered in chunks by ranges of doc_id, so that no task holds a whole shard
    placed = placed.withColumn("chunk", ranges(flat, "doc_id", chunk).column)
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))  # shards x chunks rows
    before = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "tie")) - 1)
    return ranked.join(before, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def _grow(flat: DataFrame, nodes: list[Node]) -> list[Node]:
    while any(n.parts > 1 for n in nodes):
        at = {id(n): i for i, n in enumerate(nodes)}
        where = _where(nodes, lambda n: at[id(n)])
        # widest dimension: the largest spread on the common 12-bit scale
        spread = flat.select(where.alias("node"), *(F.col(f"d_{d}") for d in DIMENSIONS)).groupBy("node").agg(*(F.stddev_pop(f"d_{d}").alias(d) for d in DIMENSIONS)).collect()
        widest = {r.node: max(DIMENSIONS, key=lambda d: r[d] or 0.0) for r in spread}
        open_ = {i: widest.get(i, "size") for i, n in enumerate(nodes) if n.parts > 1}
        cuts = _medians(flat, nodes, where, open_)
        grown: list[Node] = []
        for i, n in enumerate(nodes):
            if i not in open_:
                grown.append(n)
                continue
            left = n.parts // 2
            grown.append(Node(left, n.first, [*n.path, (open_[i], cuts[i], False)]))
            grown.append(Node(n.parts - left, n.first + left, [*n.path, (open_[i], cuts[i], True)]))
        nodes = grown
    return nodes


def _medians(flat: DataFrame, nodes: list[Node], where: Column, open_: dict[int, str]) -> dict[int, int]:
    """The order key at which each open node is cut: rows below it carry the left shards' part of the bytes."""
    rows = flat.select(where.alias("node"), "size", *(_key(d).alias(f"k_{d}") for d in set(open_.values())))
    key = F.coalesce(*(F.when(F.col("node").isin([i for i, d in open_.items() if d == dim]), F.col(f"k_{dim}")) for dim in set(open_.values())))
    rows = rows.select("node", "size", key.alias("key")).where("key is not null")
    low = dict.fromkeys(open_, 0)  # the cut lies in [low, low + 2**bits)
    below = dict.fromkeys(open_, 0)
    want: dict[int, float] = {}
    whole: dict[int, int] = {}
    done: dict[int, int] = {}
    bits = KEY_BITS
    while bits and len(done) < len(open_):
        bits -= CELL
        left = [i for i in open_ if i not in done]
        inside = F.lit(False)
        for i in left:
            inside = inside | ((F.col("node") == i) & (F.shiftright("key", bits + CELL) == low[i] >> (bits + CELL)))
        cells = rows.where(inside).groupBy("node", F.shiftright("key", bits).alias("cell")).agg(F.sum("size").alias("w")).collect()  # at most 2048 a node
        by: dict[int, list[tuple[int, int]]] = {i: [] for i in left}
        for r in cells:
            by[r.node].append((r.cell, r.w))
        for i in left:
            got = sorted(by[i])
            if i not in want:
                whole[i] = sum(w for _, w in got)
                want[i] = whole[i] * (nodes[i].parts // 2) / nodes[i].parts
            total = below[i]
            cell, w = low[i] >> bits, 0
            for cell, w in got:
                if total + w >= want[i]:
                    break
                total += w
            # borders of these cells never part equal texts until the last round; near enough is then better
            near = SLACK * whole[i] if bits >= ROW_BITS else 0.0
            if want[i] - total <= near:
                done[i] = cell << bits
            elif total + w - want[i] <= near:
                done[i] = (cell + 1) << bits
            elif not bits:
                done[i] = cell if want[i] - total <= total + w - want[i] else cell + 1
            low[i], below[i] = cell << bits, total
    return {i: done.get(i, low[i]) for i in open_}
