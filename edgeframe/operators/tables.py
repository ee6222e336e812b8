"""info, list and dump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import shown
from ..wave import Wave


def info(wave: Wave) -> DataFrame:
    """One row: the file's metadata with signal, declaration and type counts, time span and scopes."""
    counts = wave.decls.agg(F.count("*").alias("reference_count"), F.count_distinct("backend_sid").alias("signal_count"))
    kinds = type_counts(wave).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "type", "n"))), lambda s: F.struct(s["type"].alias("type"), s["n"].alias("n"))).alias("var_types"))
    places = wave.decls.agg(F.array_sort(F.collect_set(F.when(F.col("scope_path") != "", F.col("scope_path")))).alias("scopes"))
    one = wave.meta.select("*", (F.col("t_max") - F.col("t_min")).alias("duration"), F.lit(0).alias("synthesized_buses"))
    return one.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(places))  # one row each


def type_counts(wave: Wave) -> DataFrame:
    """type, n: declarations of each type (aliases count), most frequent first."""
    return wave.decls.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def scopes(wave: Wave) -> DataFrame:
    return wave.decls.where("scope_path <> ''").select("scope_path").distinct().orderBy("scope_path")


def list_signals(wave: Wave, pattern: str | None = None) -> DataFrame:
    """path, width, type, id: a row for each alias of each signal that has a matching alias, by path."""
    return wave.selected(pattern).select(F.explode("aliases").alias("path"), "width", "type", F.col("sid").alias("id")).orderBy("path", "id")


def dump(wave: Wave, t0: int = 0, t1: int | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """tick, path, value, width, type of the records in [t0, t1], by tick and declaration; seq decides ties."""
    rows = wave.changes_of(pattern).where(F.col("tick") >= t0)
    rows = rows if t1 is None else rows.where(F.col("tick") <= t1)
    rows = rows.join(wave.selected(pattern).select("backend_sid", "path", "width", "type", "kind", "decl_order"), "backend_sid")
    rows = rows.orderBy("tick", "decl_order", "seq")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("tick", "path", shown(F.col("raw"), F.col("kind"), F.col("width"), wave.wide).alias("value"), "width", "type")
