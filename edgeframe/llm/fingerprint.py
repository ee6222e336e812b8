"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame functions only.

A text falls into paragraphs, long ones at the first sentence end after ``SHORT`` characters or else
after ``LONG``; each distinct piece has a 64-bit digest. A sketch has parts of ``HASHES`` x ``WIDTH`` cells; a digest
is added to one cell of every row of its part: count, XOR of digests, XOR of check hashes. The
sketches of two versions subtract cell by cell, and peeling takes out cells that hold one digest
until all differing digests are known or nothing moves. On failure the sketch is built anew with
four times the parts; beyond ``PARTS`` the digests are compared themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import ranges

HASHES, WIDTH = 4, 12
CELLS = HASHES * WIDTH
PARTS = (1, 4, 16, 64, 256)
ROUNDS = 10
#: Rows of a range of doc_ids, and the ranges whose first ids are broadcast.
ROWS, MOST_FIRSTS = 2_500, 200_000
SHORT, LONG = 90, 240
_PIECES = rf"[^\n]{{{SHORT},{LONG}}}?[.!?](?: |$|(?=\n))|[^\n]{{1,{LONG}}}"


def digests(text: Column) -> Column:
    """array<long>: digests of the distinct paragraph pieces; empty for null or empty text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 32)


def _cell(key: Column, row: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 13 * row), F.lit(WIDTH)).cast("int") + row * WIDTH


def _part(key: Column, parts: int) -> Column:
    return F.shiftrightunsigned(key, 52).bitwiseAND(F.lit(parts - 1).cast("long"))


def _holds(mask: Column, j: Column) -> Column:
    """Is j one of the cells in the bit mask?"""
    return F.call_function("shiftright", mask, j).bitwiseAND(F.lit(1).cast("long")) == 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mask(key: Column) -> Column:
    out = F.lit(0).cast("long")
    for row in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), _cell(key, row)))
    return out


def _added(keys: Column) -> Column:
    """array<struct(k, m, h)> of digests: key, its cells, its check hash."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _mask(k).alias("m"), _check(k).alias("h")))


def _cells(keys: Column) -> Column:
    """The cells of one part with these digests, as array<struct(c, k, h)>."""
    return _let(_added(keys), _fill)


def _fill(added: Column) -> Column:
    def cell(j: Column) -> Column:
        own = F.filter(added, lambda x: _holds(x["m"], j))
        return F.aggregate(own, F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h")), lambda a, x: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)


def sketch(keys: Column, parts: int) -> Column:
    """array of parts, each an array of cells."""
    if parts == 1:
        return F.array(_cells(keys))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda p: _cells(F.filter(keys, lambda k: _part(k, parts) == p)))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell difference of two sketches of one size."""
    cell = lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, cell))


def _peel(cells: Column) -> Column:
    """Number of digests that peel out of one part, or null where some remain."""

    def pure(x: Column) -> Column:
        return (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"])

    def singles(cells: Column) -> Column:
        """Each digest that lies alone in a cell, with its cells and the side it is from."""
        full = lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), x["h"].alias("h"), _mask(x["k"]).alias("m"))
        return F.transform(F.array_distinct(F.filter(cells, pure)), full)

    def less(out: Column) -> Callable[[Column, Column], Column]:
        take = lambda a, o: F.struct((a["c"] - o["c"]).alias("c"), a["k"].bitwiseXOR(o["k"]).alias("k"), a["h"].bitwiseXOR(o["h"]).alias("h"))
        return lambda x, j: F.aggregate(F.filter(out, lambda o: _holds(o["m"], j)), x, take)

    def step(state: Column, _: Column) -> Column:
        some = lambda out: F.when(F.size(out) == 0, state).otherwise(F.struct(F.transform(state["cells"], less(out)).alias("cells"), (state["n"] + F.size(out)).alias("n")))
        return _let(singles(state["cells"]), some)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"))
    empty = lambda s: F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s), s["n"]))


def differing(a: Column, b: Column, first: Column) -> Column:
    """Number of digests in one of two digest arrays only, by sketches of growing size.

    first: the difference of their smallest sketches.
    """
    attempts = []
    for parts in PARTS:
        peeled = F.transform(first if parts == PARTS[0] else subtract(sketch(a, parts), sketch(b, parts)), _peel)
        attempts.append(F.aggregate(peeled, F.lit(0), lambda n, x: n + x))  # null where a part failed
    return F.coalesce(*attempts, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column, first: Column) -> Column:
    """Share of common digests among all digests of two arrays, 0 to 1; 1 where both are empty."""
    both = F.size(a) + F.size(b)
    value = lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))
    return F.when(a == b, F.lit(1.0)).otherwise(_let(differing(a, b, first), value))


def serialise(cells: Column) -> Column:
    """A part's cells as text: per cell the count (16 bits), the digests (64) and the checks (32), base64."""
    packed = F.transform(cells, lambda x: F.concat(F.lpad(F.hex(x["c"].cast("long")), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 8, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(packed, ""))), "\r\n", "")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text and next_text: the text of the next doc_id, after the last that of the first.

    Null ids come first; rows with equal ids follow one another in the order of their texts. One
    shuffle by ranges of about ``rows`` ids; the first row of each range is also sent to the range
    before. The first ids of the ranges are broadcast if there are at most ``MOST_FIRSTS``, and
    joined by a second shuffle beyond that.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cut = ranges(ids, "doc_id", rows)
    reach = cut.column
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    firsts = ids.select(reach.alias("reach"), key.alias("key")).groupBy("reach").agg(F.min("key").alias("key"))
    whole = Window.orderBy("reach")  # a row for each range
    firsts = firsts.select("key", F.coalesce(F.lag("reach").over(whole), F.max("reach").over(Window.partitionBy())).alias("before"))
    if cut.n <= MOST_FIRSTS:
        firsts = F.broadcast(firsts)  # a row of 16 bytes for each range
    dealt = base.select("doc_id", "text", key.alias("key"), reach.alias("reach")).join(firsts, "key", "left")
    dealt = dealt.select("doc_id", "text", "key", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("reach").alias("reach"), F.lit(0).alias("ghost")))).otherwise(F.array(F.struct(F.col("reach").alias("reach"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("reach"), F.lit(1).alias("ghost"))))).alias("to"))
    dealt = dealt.select("doc_id", "text", "key", "to.reach", "to.ghost")
    order = Window.partitionBy("reach").orderBy("ghost", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("ghost = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_pieces.

    docs: doc_id, text; other columns are ignored. Null text is empty. The edited text is the text
    with its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. near_*: share of common paragraph digests, counted by peeling the subtracted sketches.
    Equal texts have equal fingerprints. Repeated rows are each reported; a table of one document
    has itself as the next; an empty table gives no rows.
    """
    pair = with_next(docs, rows)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    pair = pair.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    keys = pair.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("b"))
    small = keys.select("*", *(sketch(F.col(c), PARTS[0]).alias(f"s{c}") for c in "aeb"))
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return small.select(
        "doc_id", "n_chars", "edited_sha256", serialise(F.get("sa", 0)).alias("fingerprint"), serialise(F.get("se", 0)).alias("edited_fingerprint"),
        likeness(a, e, subtract(F.col("sa"), F.col("se"))).alias("near_edited"), likeness(a, b, subtract(F.col("sa"), F.col("sb"))).alias("near_next"), F.size(a).cast("long").alias("n_pieces"),
    )
