"""Values carried forward in time without a window over all of it.

Time is cut into buckets of about equally many records. The last value of every lane in each bucket
is carried to the next ones over a table of as many rows as buckets (of each key); all other windows
lie within a bucket, so neither a busy signal nor a burst of changes meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..wave import Signal, Wave


def timeline(wave: Wave, signals: list[Signal], floor: int, end: int, size: int | None = None) -> tuple[DataFrame, int]:
    """One row per tick in [floor, end] that has records of the signals, and one at ``floor``.

    Columns: bucket, tick, and for signal i: v{i}, its last record of the tick; lo{i} and hi{i}, the
    extreme texts of its records; c{i}, whether it has any. Earlier records count as of ``floor``.
    With the rows comes the number of buckets.
    """
    own = wave.changes_in([s.backend_sid for s in signals]).where(F.col("tick") <= end).select("backend_sid", "tick", "seq", "raw")
    anchor = wave.spark.range(1).select(F.lit(None).cast("string").alias("backend_sid"), F.lit(floor).cast("long").alias("tick"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("raw"))
    own = own.withColumn("t", F.greatest("tick", F.lit(floor)))
    bucket = wave.buckets(own.where(F.col("tick") >= floor), "t", size)
    own = own.unionByName(anchor.withColumn("t", F.lit(floor).cast("long")))
    aggs: list[Column] = []
    for i, s in enumerate(signals):
        mine = F.col("backend_sid") == s.backend_sid
        raw = F.when(mine, F.col("raw"))
        aggs += [F.max_by(raw, F.when(mine, F.struct("tick", "seq"))).alias(f"v{i}"), F.min(raw).alias(f"lo{i}"), F.max(raw).alias(f"hi{i}"), F.coalesce(F.bool_or(mine), F.lit(False)).alias(f"c{i}")]
    return own.groupBy("t").agg(*aggs).withColumn("bucket", bucket.column).withColumnRenamed("t", "tick"), bucket.n


def filled(rows: DataFrame, lanes: Sequence[str], buckets: int, order: Sequence[str] = ("tick",), key: Sequence[str] = ()) -> DataFrame:
    """rows (bucket, ...) with each lane's last value that is not null: ``now_{lane}`` up to the row, ``was_{lane}`` before it.

    order: columns that order the rows of a key; key: columns that part them (none: all are one).
    """
    inside = Window.partitionBy(*key, "bucket").orderBy(*order)
    upto, until = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    if buckets == 1:
        return rows.select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"{name}_{c}") for name, w in (("now", upto), ("was", until)) for c in lanes))
    past = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    place = F.struct(*order)
    lasts = rows.groupBy(*key, "bucket").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in lanes))
    carry = lasts.select(*key, "bucket", *(F.last(c, ignorenulls=True).over(past).alias(f"past_{c}") for c in lanes))
    rows = rows.join(carry, [*key, "bucket"])
    return rows.select(
        *(c for c in rows.columns if not c.startswith("past_")),
        *(F.coalesce(F.last(c, ignorenulls=True).over(upto), f"past_{c}").alias(f"now_{c}") for c in lanes),
        *(F.coalesce(F.last(c, ignorenulls=True).over(until), f"past_{c}").alias(f"was_{c}") for c in lanes),
    )


def followed_by(rows: DataFrame, end: Column, buckets: int, order: Sequence[str] = ("tick",), key: Sequence[str] = ()) -> DataFrame:
    """Rows (bucket, tick, ...) with ``next_tick``: the tick of the next row of the key, or ``end`` after the last."""
    inside = F.lead("tick").over(Window.partitionBy(*key, "bucket").orderBy(*order))
    if buckets == 1:
        return rows.withColumn("next_tick", F.coalesce(inside, end))
    heads = rows.groupBy(*key, "bucket").agg(F.min("tick").alias("head"))
    after = heads.select(*key, "bucket", F.lead("head").over(Window.partitionBy(*key).orderBy("bucket")).alias("after"))  # a row for each bucket
    return rows.withColumn("next_tick", inside).join(after, [*key, "bucket"]).withColumn("next_tick", F.coalesce("next_tick", "after", end)).drop("after")
