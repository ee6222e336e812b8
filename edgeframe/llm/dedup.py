"""Near-duplicate classes by one-permutation MinHash.

Plan: one pass turns every text into a set id and 32 band keys. Documents with equal sets collapse
into one node, so a group of copies costs one node however large it is. In every bucket one hub is
compared with all others (a star: pairs stay linear in the bucket), on full shingle sets. The hub
is the node whose buckets are fullest: among versions of one text that is the version with the
fewest edits of its own, which is nearer to each version than any other version is, so a version
that links with any mostly links with it.

Links between two nodes of a star that the hub does not join are found exactly, without looking at
all pairs. A node is its hub's set but for a difference: shingles that it lacks and shingles that it
adds. Two nodes of different components are linked only if their differences overlap by a number
that follows from their sizes (:func:`_remaining`). So the overlaps are searched by a prefix-filter
join on the elements of the differences, least frequent first, and only elements that nodes of
different components hold count. Versions with edits of their own share next to none.
Components come from alternating large-star and small-star steps.

Shuffled: band keys (8 bytes each), the sets of documents that have a candidate partner, and
differences. Nothing is broadcast or collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textscan as ts
from .scratch import Scratch

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(77))
#: Row j: the order in which an empty bin j looks for a filled one.
_LOOK = np.stack([_RNG.permutation(BINS) for _ in range(BINS)])
_MULT = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | _U(1)

SIGNED = "doc_id long, n_shingles long, node long, bands array<long>"


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words gives one, of none nothing."""
    grams = ts.runs(words, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            yield np.unique(grams[a : b - k + 1])
        elif n:
            yield ts.runs(words[a:b], int(n))
        else:
            yield np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; an empty bin copies the first filled one in its own fixed order."""
    bins = (grams >> _U(57)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    out[bins[head]] = grams[head]
    filled[bins[head]] = True
    if len(head) < BINS:
        empty = np.flatnonzero(~filled)
        look = _LOOK[empty]
        out[empty] = out[look[np.arange(len(empty)), filled[look].argmax(1)]]
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words, first in ts.scan(batch.column(1), ts.SPACE):
                n = hi - lo
                count = np.zeros(n, np.int64)
                node = np.zeros(n, np.uint64)
                sig = np.zeros((n, BINS), np.uint64)
                for i, grams in enumerate(shingle_sets(words, first, k)):
                    count[i] = len(grams)
                    if len(grams):
                        node[i] = (ts.mix(grams + _U(0x9E3779B97F4A7C15))).sum(dtype=np.uint64)
                        sig[i] = signature(grams)
                node = ts.mix(node + count.astype(np.uint64))
                keys = ts.mix((sig.reshape(n, BANDS, ROWS) * _MULT).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n).cast(pa.int64()), pa.array(count), pa.array(node.view(np.int64)), lists], ["doc_id", "n_shingles", "node", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(1), ts.SPACE):
                sets = list(shingle_sets(words, first, k))
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["node", "grams"])

    return run


def _with_node(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, text, row) with the node of their text (null without shingles)."""
    names = [*docs.columns, "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in ts.scan(batch.column(1), ts.SPACE):
                sets = list(shingle_sets(words, first, k))
                count = np.array([len(s) for s in sets], np.uint64)
                node = np.array([ts.mix(s + _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(ts.mix(node + count).view(np.int64), mask=count == 0)], names)

    return ts.each_batch(docs, run, StructType([*docs.schema.fields, StructField("node", LongType())]))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their near-duplicate group: that with the smallest doc_id.

    Rows with a null doc_id stay, and rows without words. Rows that repeat a doc_id are decided one by
    one by their texts: of those that are the kept document of one group, the smallest row stays.
    Columns may have any names; an empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*columns).alias("row"))
    rows = Scratch(docs.sparkSession, "one_of_each").keep(near_duplicates(docs, k, percent).select("doc_id", "kept", "node", "root"), "rows")
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    gone = rows.where("not kept").select("doc_id").union(repeated).distinct()
    alone = whole.join(gone, "doc_id", "left_anti").select("row.*")
    if not repeated.limit(1).count():
        return alone
    again = _with_node(whole.join(repeated, "doc_id", "left_semi").select("doc_id", F.col("row.text").cast("string").alias("text"), "row"), k)
    kept = rows.where("kept and node is not null").join(repeated, "doc_id", "left_semi").select("doc_id", "node", "root").distinct()
    chosen = again.join(kept, ["doc_id", "node"]).groupBy("root").agg(F.min_by("row", F.struct("node", "text", F.to_json("row"))).alias("row"))
    return alone.unionByName(again.where("node is null").select("row.*")).unionByName(chosen.select("row.*"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root): the smallest node reachable from each node of ``edges`` (u, v), v over root only.

    Alternating large-star and small-star; each step is one groupBy and one join on the node, and
    its result is written to the shared folder. The number of steps grows with the logarithm of the
    longest path.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        step = scratch.keep(large, "large")
        least = step.groupBy("v").agg(F.min("u").alias("m"))
        small = step.join(least, "v").select(F.col("u").alias("a"), "v", "m")
        small = small.select("v", F.col("m").alias("u")).union(small.where("a <> m").select(F.col("a").alias("v"), F.col("m").alias("u"))).where("u <> v").distinct()
        after = scratch.keep(small, "small")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first()
        scratch.drop(now, step)
        now = after
        if tuple(seen) == mark:
            return now.select("v", F.col("u").alias("root"))
        mark = tuple(seen)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links, node, root.

    docs: doc_id long, text string; other columns are ignored. Words are runs of bytes other than
    ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles of the whole text,
    or the whole sequence where there are fewer words. Two documents are linked when
    ``100 * |A & B| >= percent * |A | B|``, counted on full sets.

    Empty or null text: n_shingles 0, its own component, kept. Null doc_id: linked with nothing,
    component_id null, kept. Repeated doc_ids: every row is reported, with the verdict of its own
    text. n_links counts the confirmed links of the text's class that were needed to join the
    component; copies of one text are one class (column node, a 64-bit hash of the set; null for
    rows linked with nothing); column root is the same for the nodes of one component, also where
    components share a component_id because of repeated doc_ids. Very long texts are scanned whole,
    in slices. Empty table: empty result.

    Every linked pair that shares a bucket ends in one component; a pair at 0.8 shares none of the
    32 buckets with probability 5e-8, which is the only way to miss a link.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(ts.each_batch(base, _sign(k), SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = scratch.keep(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch.keep(keyed.join(crowded, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("c").alias("w"))
    buckets = scratch.keep(shared.join(weight, "node").select("key", "node", "w"), "buckets")
    hubs = buckets.groupBy("key").agg(F.max(F.struct("w", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    pairs = scratch.keep(buckets.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    scratch.drop(shared, buckets)
    sets = _sets_of(pairs, nodes, base, k, scratch)
    stars = scratch.keep(_differences(pairs, sets, percent), "stars")
    links = stars.where("linked").select("u", "v")
    final = components(links, scratch)
    left = _remaining(stars, final, percent, scratch)
    more = _confirmed(left, sets, percent, scratch)
    scratch.drop(sets, left, pairs)
    links = links.union(more)
    final = components(final.select(F.col("root").alias("u"), "v").union(more), scratch)

    degree = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", F.col("doc_id").alias("least")).join(final.withColumnRenamed("v", "node"), "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    name = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = placed.join(name, "root").select("node", "component_id", "n_links", "root")
    alone = F.expr("n_shingles = 0 or doc_id is null")
    out = signed.select("doc_id", "n_shingles", F.when(~alone, F.col("node")).alias("node")).join(label, "node", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "root")


def _sets_of(pairs: DataFrame, nodes: DataFrame, base: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(node, grams), a row for each node in ``pairs`` (u, v); one document stands for each node."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    who = nodes.select("doc_id", "node").join(wanted, "node")
    sets = scratch.keep(ts.each_batch(base.join(who, "doc_id").select("node", "text"), _check(k), "node long, grams array<long>"), "sets", "none")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # rows that repeat both doc_id and text
        sets = scratch.keep(sets.dropDuplicates(["node"]), "sets", "none")
    return sets


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair (hub u, v) with ``linked``, and v's difference from the hub's set of n shingles.

    less: how many of the hub's shingles v lacks; x: these, then those that v adds.
    """
    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u")
    both = both.select("u", "v", F.size("gu").cast("long").alias("n"), F.size("gv").alias("m"), F.array_except("gu", "gv").alias("lacks"), F.array_except("gv", "gu").alias("adds"))
    same = F.col("n") - F.size("lacks")
    return both.select("u", "v", "n", (100 * same >= percent * (F.col("m") + F.size("lacks"))).alias("linked"), F.size("lacks").alias("less"), F.concat("lacks", "adds").alias("x"))


def _remaining(stars: DataFrame, final: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of nodes of one star that may be linked although they lie in different components.

    Let node a lack d and add e shingles against its hub of n. Two nodes whose differences share x
    elements have n - d - d' + x shingles in common, so with W = 100 d + percent e and
    C = (100 - percent) n they are linked if and only if (100 + percent) x >= W + W' - C; with the
    hub itself, if and only if W <= C. Of a pair in different components one node, a, is not in the
    hub's, so W > C. As x is at most d' + e', which is at most W' / percent, this gives
    x >= (W - C) / 100 for a and x > W' / (100 + percent) for the other. Of two sets that share t
    elements, the first (size - t + 1) of each, in one order of all elements, have one in common:
    these prefixes are joined, least frequent elements first. An element whose holders all lie in
    one component is none that the two could share, and is left out.
    """
    root = final.select("v", "root")
    heads = stars.select("u", "v").join(root, "v", "left").withColumn("rv", F.coalesce("root", "v")).drop("root")
    heads = heads.join(root.withColumnRenamed("v", "u"), "u", "left").withColumn("ru", F.coalesce("root", "u")).drop("root")
    open_ = heads.groupBy("u").agg(F.bool_or(F.col("ru") != F.col("rv")).alias("mixed")).where("mixed").select("u")
    heads = scratch.keep(heads.join(open_, "u", "left_semi"), "heads")
    cost = F.lit(100) * F.col("less") + F.lit(percent) * (F.size("x") - F.col("less"))
    own = stars.join(heads, ["u", "v"]).select("u", "v", "ru", "rv", cost.cast("long").alias("w"), (F.lit(100 - percent) * F.col("n")).cast("long").alias("c"), "less", F.posexplode("x").alias("i", "g"))
    own = scratch.keep(own.select("u", "v", "ru", "rv", "w", "c", (F.col("i") < F.col("less")).alias("lacked"), "g"), "elements")
    held = own.groupBy("u", "g").agg(F.count("*").alias("f"), F.min("rv").alias("lo"), F.max("rv").alias("hi")).where("lo <> hi").select("u", "g", "f")
    kept = own.join(held, ["u", "g"]).groupBy("u", "v", "ru", "rv", "w", "c").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("x"), F.count_if("lacked").alias("less"), F.count_if(~F.col("lacked")).alias("more"))
    kept = scratch.keep(kept, "kept")
    scratch.drop(own)

    def prefix(rows: DataFrame, name: str, length: Column) -> DataFrame:
        rows = rows.withColumn("k", length.cast("int")).where("k > 0")
        return rows.select("u", "c", F.explode(F.slice("x", F.lit(1), F.col("k"))).alias("s"), *(F.col(q).alias(f"{q}_{name}") for q in ("v", "rv", "w", "less", "more"))).withColumn("g", F.col("s.g")).drop("s")

    apart = prefix(kept.where("rv <> ru"), "a", F.size("x") + 1 - F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("c")) / 100)))
    other = prefix(kept, "b", F.size("x") - F.floor(F.col("w") / (100 + percent))).drop("c")
    at_most = F.least("less_a", "less_b") + F.least("more_a", "more_b")
    found = apart.join(other, ["u", "g"]).where((F.col("rv_a") != F.col("rv_b")) & ((100 + percent) * at_most >= F.col("w_a") + F.col("w_b") - F.col("c")))
    found = found.select(F.least("v_a", "v_b").alias("u"), F.greatest("v_a", "v_b").alias("v")).distinct()
    tested = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    out = scratch.keep(found.join(tested, ["u", "v"], "left_anti"), "remaining")
    scratch.drop(heads, kept)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that are linked, by their full sets."""
    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u")
    shared = F.size(F.array_intersect("gu", "gv")).cast("long")
    return scratch.keep(both.where(100 * shared >= percent * (F.size("gu") + F.size("gv") - shared)).select("u", "v"), "more")


def _check(k: int):
    """Sets of rows (node, text) whose text really has that node."""
    make = _sets(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            flat = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = batch.column(1).offsets.to_numpy()
            count = np.diff(at).astype(np.uint64)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ts.mix(flat + _U(0x9E3779B97F4A7C15)), dtype=np.uint64)))
            node = ts.mix(total[at[1:]] - total[at[:-1]] + count).view(np.int64)
            same = node == batch.column(0).to_numpy()
            yield batch.filter(pa.array(same))

    return run
