"""Values at points in time: snapshot, compare, as-of for many points; and per-signal summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WaveError
from ..functions.values import UNDEF, shown
from ..plans.timeline import filled, followed_by
from ..wave import Wave


def _order() -> Column:
    return F.struct("tick", "seq")


def _shown(wave: Wave, column: str | Column) -> Column:
    return shown(F.col(column) if isinstance(column, str) else column, F.col("kind"), F.col("width"), wave.wide)


def snapshot(wave: Wave, at: int, pattern: str | None = None) -> DataFrame:
    """path, value, undefined, width, type: the last value at or before ``at`` of every selected signal.

    Signals with a value come first, each part by path.
    """
    last = wave.changes_of(pattern).where(F.col("tick") <= at).groupBy("backend_sid").agg(F.max_by("raw", _order()).alias("raw"), F.lit(True).alias("known"))
    rows = wave.selected(pattern).join(last, "backend_sid", "left").withColumn("undefined", F.col("known").isNull())
    return rows.select("path", _shown(wave, "raw").alias("value"), "undefined", "width", "type").orderBy("undefined", "path")


def compare(wave: Wave, t1: int, t2: int, pattern: str | None = None) -> DataFrame:
    """path, at_t1, at_t2, width, type of the signals whose value differs; absent differs from present."""
    if t2 < t1:
        raise WaveError("second compare time must be >= first")
    rows = _two_points(wave, t1, t2, pattern).where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("path", F.coalesce(_shown(wave, "a"), F.lit(UNDEF)).alias("at_t1"), F.coalesce(_shown(wave, "b"), F.lit(UNDEF)).alias("at_t2"), "width", "type").orderBy("path")


def unchanged(wave: Wave, t1: int, t2: int, pattern: str | None = None) -> DataFrame:
    """One row n: selected signals with a value at ``t2`` that is the one at ``t1``."""
    return _two_points(wave, t1, t2, pattern).agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n"))


def _two_points(wave: Wave, t1: int, t2: int, pattern: str | None) -> DataFrame:
    """One pass over the changes up to t2, one row a signal that has any."""
    early = F.col("tick") <= t1
    last = wave.changes_of(pattern).where(F.col("tick") <= t2).groupBy("backend_sid").agg(F.max_by(F.when(early, F.col("raw")), F.when(early, _order())).alias("a"), F.max_by("raw", _order()).alias("b"))
    return last.join(wave.selected(pattern), "backend_sid")


def asof(wave: Wave, points: DataFrame, bucket: int | None = None) -> DataFrame:
    """points (backend_sid, tick, ...) with ``raw``: the signal's last value at or before each point.

    Points and changes of a signal meet in one pass in order of time, bucket by bucket; nothing is
    multiplied.
    """
    extra = [c for c in points.columns if c not in ("backend_sid", "tick")]
    marked = points.select("backend_sid", "tick", F.lit(2**63 - 1).alias("seq"), F.lit(None).cast("string").alias("raw"), F.struct(*(extra or [F.lit(1).alias("one")])).alias("point"))
    cut = wave.buckets(wave.changes, "tick", bucket)
    marked = marked.unionByName(wave.changes.select("backend_sid", "tick", "seq", "raw"), allowMissingColumns=True)
    rows = filled(marked.withColumn("bucket", cut.column), ["raw"], cut.n, ("tick", "seq"), ("backend_sid",))
    return rows.where(F.col("point").isNotNull()).select("backend_sid", "tick", *(F.col("point")[c].alias(c) for c in extra), F.col("now_raw").alias("raw"))


def summary(wave: Wave, t0: int = 0, t1: int | None = None, pattern: str | None = None, bucket: int | None = None) -> DataFrame:
    """Per-signal statistics of a window, active signals first, then static, then undefined, by path.

    Columns: kind, path, value, changes, rise_count, fall_count, init, last, first_at, last_at, unique,
    width, type. The baseline is the last value before the window (at tick 0 if it starts there).
    """
    border = t0 - 1 if t0 else 0
    rows = wave.changes_of(pattern)
    rows = (rows if t1 is None else rows.where(F.col("tick") <= t1)).select("backend_sid", "tick", "seq", "raw")
    inside = F.col("tick") > border
    order = ("tick", "seq")
    cut = wave.buckets(rows, "tick", bucket)
    sid = ("backend_sid",)
    rows = followed_by(filled(rows.withColumn("bucket", cut.column), ["raw"], cut.n, order, sid), F.lit(None), cut.n, order, sid)
    # what lies before the baseline matters to no figure
    rows = rows.where(inside | F.coalesce(F.col("next_tick") > border, F.lit(True)))
    edge_of = lambda a, b: F.count_if(inside & (F.col("was_raw") == a) & (F.col("raw") == b))
    stats = rows.groupBy("backend_sid").agg(
        F.count_if(inside).alias("changes"), edge_of("0", "1").alias("rise"), edge_of("1", "0").alias("fall"),
        F.max_by(F.when(~inside, F.col("raw")), F.when(~inside, _order())).alias("base"), F.max_by("raw", _order()).alias("final"), F.min(F.when(inside, F.col("tick"))).alias("first_at"), F.max(F.when(inside, F.col("tick"))).alias("last_at"), F.count_distinct("raw").alias("n_values"),
    )
    all_ = wave.selected(pattern).withColumnRenamed("kind", "value_kind").join(stats, "backend_sid", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    show = lambda c: shown(F.col(c), F.col("value_kind"), F.col("width"), wave.wide)
    kind = F.when(F.col("changes") > 0, "active").when(F.col("final").isNotNull(), "static").otherwise("undefined")
    bit = F.col("width") == 1
    edge = lambda c: F.when(bit, F.coalesce(c, F.lit(0)))
    out = all_.select(
        kind.alias("kind"), "path", F.when(kind == "static", show("final")).alias("value"), "changes", edge("rise").alias("rise_count"), edge("fall").alias("fall_count"),
        F.coalesce(show("base"), F.lit(UNDEF)).alias("init"), F.coalesce(show("final"), F.lit(UNDEF)).alias("last"), "first_at", "last_at", F.coalesce("n_values", F.lit(0)).alias("unique"), "width", "type",
    )
    return out.orderBy(F.when(F.col("kind") == "active", 0).when(F.col("kind") == "static", 1).otherwise(2), "path")


def summary_counts(rows: DataFrame) -> DataFrame:
    """One row of selected, defined, undefined, active and static counts over summary rows."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return rows.agg(F.count("*").alias("selected"), F.count_if(F.col("kind") != "undefined").alias("defined"), is_("undefined").alias("undefined"), is_("active").alias("active"), is_("static").alias("static"))
