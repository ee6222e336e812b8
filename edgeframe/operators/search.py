"""Condition search: intervals, segments of shown values, and events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WaveError
from ..functions.conditions import Term, parse_conditions
from ..functions.values import UNDEF, canonical, shown_canonical
from ..plans.timeline import filled, followed_by, timeline
from ..wave import Signal, Wave


@dataclass
class Search:
    """mode is interval, segment or event.

    rows: begin_ticks and end_ticks (half-open), or time_ticks; with shown signals also ``values``
    (array of struct path, value in order of the path) and ``meta`` (raw, width, type).
    """

    mode: str
    rows: DataFrame
    t0: int
    t1: int
    condition: str
    resolved: str
    show: list[Signal]
    changed: Signal | None


def search(wave: Wave, condition: str, show: str | None = None, changed: str | None = None, begin: int = 0, end: int | None = None, bucket: int | None = None) -> Search:
    """Where the AND-list ``condition`` holds between ``begin`` and ``end`` (default: the last tick)."""
    if end is None:
        if wave.time_range is None:
            raise WaveError("search cannot evaluate condition: VCD data section contains no value changes")
        end = wave.time_range[1]
    if end < begin:
        raise WaveError("end time must be >= begin time")
    terms = parse_conditions(condition)
    bound: dict[tuple, tuple[Term, Signal]] = {}
    for term in terms:
        signal = wave.resolve_one(term.pattern, "condition")
        bound.setdefault((signal.backend_sid, term.op, term.target), (term, signal))
    shows = wave.resolve_many(show)
    trigger = wave.resolve_one(changed, "--changed") if changed is not None else None
    if trigger and not shows:
        shows = [trigger]
    used: dict[str, Signal] = {s.backend_sid: s for s in [*(s for _, s in bound.values()), *shows, *([trigger] if trigger else [])]}
    place = {sid: i for i, sid in enumerate(used)}
    # events look at the state before the first tick, spans at the state with it
    line, buckets = timeline(wave, list(used.values()), begin - 1 if trigger else begin, end, bucket)
    # what depends on one signal alone is worked out once for each of its records, then carried forward
    record = lambda s: F.col(f"v{place[s.backend_sid]}")
    lanes = {f"term{j}": F.when(record(s).isNotNull(), t.holds(record(s), s.width)) for j, (t, s) in enumerate(bound.values())}
    for j, s in enumerate(shows):
        lanes |= {f"raw{j}": record(s), f"text{j}": canonical(record(s), s.kind, s.width)}
    if trigger:
        lanes["own"] = record(trigger)
    t = place[trigger.backend_sid] if trigger else 0
    rows = filled(line.select("bucket", "tick", *([f"c{t}", f"lo{t}", f"hi{t}"] if trigger else []), *(c.alias(name) for name, c in lanes.items())), list(lanes), buckets)

    def holds(when: str) -> Column:
        return reduce(and_, (F.coalesce(f"{when}_term{j}", F.lit(False)) for j in range(len(bound))))

    values = F.array(*(F.struct(F.lit(s.path).alias("path"), F.coalesce(shown_canonical(F.col(f"now_text{j}"), s.kind, s.width), F.lit(UNDEF)).alias("value")) for j, s in enumerate(shows)))
    meta = F.array(*(F.struct(F.lit(s.path).alias("path"), F.col(f"now_raw{j}").alias("raw"), F.lit(s.width).alias("width"), F.lit(s.type).alias("type")) for j, s in enumerate(shows)))
    mode = "event" if trigger else "segment" if shows else "interval"
    if trigger:
        old = F.col("was_own")
        # an event's record always fires, but for the very first one at tick 0
        fires = (F.col("tick") != 0) | old.isNotNull() if trigger.kind == "event" else old.isNotNull() & ((F.col(f"lo{t}") != old) | (F.col(f"hi{t}") != old))
        rows = rows.where((F.col("tick") >= begin) & F.col(f"c{t}") & fires & holds("now")).select(F.col("tick").alias("time_ticks"), values.alias("values"), meta.alias("meta")).orderBy("time_ticks")
    else:
        moved = reduce(or_, (~F.col(f"now_text{j}").eqNullSafe(F.col(f"was_text{j}")) for j in range(len(shows))), F.lit(False))
        edge = (F.col("tick") == begin) | (holds("now") != holds("was")) | (holds("now") & moved)
        spans = followed_by(rows.where(edge).withColumn("ok", holds("now")), F.lit(end), buckets).where("ok")
        if begin == end:
            spans = spans.where(F.lit(False))
        extra = [values.alias("values"), meta.alias("meta")] if shows else []
        rows = spans.select(F.col("tick").alias("begin_ticks"), F.col("next_tick").alias("end_ticks"), *extra).orderBy("begin_ticks")
    typed = ",".join(t.typed for t, _ in bound.values())
    resolved = ",".join(f"{s.path}{t.op}{t.value}" for t, s in bound.values())
    return Search(mode, rows, begin, end, typed, resolved, shows, trigger)
