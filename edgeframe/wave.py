"""A waveform as four DataFrames, and the tables derived from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .errors import WaveError
from .functions import names
from .plans.ranges import Ranges, ranges

META = "path string, size_bytes long, timescale string, ts_sec double, date string, version string, t_min long, t_max long"
DECLS = "decl_idx long, full_path string, scope_path string, width int, type string, kind string, backend_sid string"
#: Records of a bucket of time, about; bytes of a file that is one bucket.
BUCKET, WHOLE = 250_000, 16 << 20
#: Signals that are named to a source one by one.
MOST_LISTED = 1000
CHANGES = "backend_sid string, tick long, seq long, raw string"


def merge_aliases(decls: DataFrame) -> DataFrame:
    """Signals: declarations of one backend_sid merged, numbered in byte order of the path.

    path is the smallest of the paths, decl_order the first declaration's place; width, type and
    kind are the first declaration's; scopes are distinct, in order of first sight.
    """
    first = decls.groupBy("backend_sid").agg(
        F.array_sort(F.collect_set("full_path")).alias("aliases"), F.min("decl_idx").alias("decl_order"), *(F.min_by(c, "decl_idx").alias(c) for c in ("width", "type", "kind")),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("scope_path") != "", F.struct("decl_idx", "scope_path")))), lambda s: s["scope_path"])).alias("scopes"),
    )
    first = first.withColumn("path", F.element_at("aliases", 1))
    # as many rows as signals; one partition numbers them
    return first.withColumn("sid", (F.row_number().over(Window.orderBy("path", "decl_order")) - 1).cast("long")).select("sid", "path", "aliases", "width", "type", "kind", "scopes", "decl_order", "backend_sid")


#: signal ids, or None for all
Scan = Callable[["Sequence[str] | None"], DataFrame]


@dataclass
class Signal:
    path: str
    width: int
    type: str
    kind: str
    backend_sid: str


@dataclass
class Wave:
    """meta, decls and changes have the columns of META, DECLS and CHANGES; changes carry one row a record.

    scan: reads the records of some signals only, where the source can do better than filter ``changes``.
    """

    meta: DataFrame
    decls: DataFrame
    changes: DataFrame
    ts_sec: float = 1e-12
    scan: Scan | None = None
    signals: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.signals = merge_aliases(self.decls)

    @property
    def spark(self) -> SparkSession:
        return self.changes.sparkSession

    @cached_property
    def wide(self) -> bool:
        """Do signals of more than 64 bits occur?"""
        return self.decls.where("kind = 'bits' and width > 64").limit(1).count() > 0

    @cached_property
    def head(self) -> Row | None:
        """The one row of ``meta``."""
        return self.meta.first()

    @property
    def time_range(self) -> tuple[int, int] | None:
        r = self.head
        return None if r is None or r.t_min is None else (r.t_min, r.t_max)

    def buckets(self, rows: DataFrame, name: str, size: int | None) -> Ranges:
        """Ranges of time with about ``size`` rows (None: ``BUCKET``). A file of up to ``WHOLE`` bytes is one, without a scan."""
        if size is None and self.head is not None and 0 < self.head.size_bytes <= WHOLE:
            return Ranges(F.lit(0).cast("long"), 1)
        return ranges(rows, name, size or BUCKET)

    def selected(self, pattern: str | None = None) -> DataFrame:
        """Signals any alias of which matches the comma-separated patterns."""
        patterns = names.split_patterns(pattern)
        return self.signals.where(names.any_alias(F.col("aliases"), patterns)) if patterns else self.signals

    def changes_of(self, pattern: str | None = None) -> DataFrame:
        """Changes of the selected signals. Up to ``MOST_LISTED`` signals are named to the source, which then reads only theirs."""
        if not names.split_patterns(pattern):
            return self.changes
        own = self.selected(pattern).select("backend_sid")
        some = [r.backend_sid for r in own.limit(MOST_LISTED + 1).collect()]
        if len(some) > MOST_LISTED:
            return self.changes.join(own, "backend_sid", "left_semi")
        return self.changes_in(some)

    def changes_in(self, sids: Sequence[str]) -> DataFrame:
        """Changes of the named signals."""
        if not sids:
            return self.changes.where(F.lit(False))
        own = F.col("backend_sid").isin(list(sids))
        return (self.scan(sids) if self.scan else self.changes).where(own)

    def records(self, signals: DataFrame) -> DataFrame:
        """Changes of the given signals with their attributes; signals are as many as declared, not as changes."""
        return self.changes.join(signals.select("backend_sid", "sid", "path", "width", "type", "kind", "decl_order"), "backend_sid")

    def _rows(self, where) -> list[Signal]:
        rows = self.signals.where(where).orderBy("path").select("path", "width", "type", "kind", "backend_sid").collect()
        return [Signal(**r.asDict()) for r in rows]

    def _exact(self, pattern: str) -> list[Signal]:
        low = pattern.lower()
        return [] if names.is_glob(pattern) else self._rows(F.exists("aliases", lambda a: F.lower(a) == low))

    def resolve_one(self, pattern: str, role: str) -> Signal:
        """The one signal that a pattern names."""
        found, how = self._exact(pattern.strip()), "exactly matches"
        if not found:
            found, how = self._rows(names.any_alias(F.col("aliases"), [names.check_pattern(pattern.strip())])), "matches"
        if not found:
            raise WaveError(f"{role} pattern {pattern!r} matches no signals")
        if len(found) > 1:
            raise WaveError(f"{role} pattern {pattern!r} {how} {len(found)} signals; use list to choose a more specific name, examples: {', '.join(s.path for s in found[:5])}")
        return found[0]

    def resolve_many(self, text: str | None) -> list[Signal]:
        """Signals of a comma-separated list, each once, by path."""
        out: dict[str, Signal] = {}
        missing = []
        for pattern in filter(None, map(str.strip, (text or "").split(","))):
            found = self._exact(pattern) or self._rows(names.any_alias(F.col("aliases"), [names.check_pattern(pattern)]))
            out.update((s.backend_sid, s) for s in found)
            if not found:
                missing.append(pattern)
        if missing:
            raise WaveError(f"--show matches no signals: {', '.join(missing)}")
        return sorted(out.values(), key=lambda s: s.path.encode())

    def hold(self, pattern: str | None = None) -> Wave:
        """This wave with the records of the selected signals (all: None) read once and kept, for several commands.

        Let go with :meth:`release`. Aliases share their signal's records.
        """
        return Wave(self.meta, self.decls, self.changes_of(pattern).persist(), self.ts_sec)

    def release(self) -> None:
        self.changes.unpersist()

    def save(self, path: str) -> None:
        """Write the wave as Parquet, changes ranged by signal and sorted by time, for repeated queries."""
        self.meta.write.mode("overwrite").parquet(f"{path}/meta")
        self.decls.write.mode("overwrite").parquet(f"{path}/decls")
        self.changes.repartitionByRange("backend_sid", "tick").sortWithinPartitions("backend_sid", "tick", "seq").write.mode("overwrite").parquet(f"{path}/changes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Wave:
        meta = spark.read.schema(META).parquet(f"{path}/meta")
        r = meta.select("ts_sec").first()
        return cls(meta, spark.read.schema(DECLS).parquet(f"{path}/decls"), spark.read.schema(CHANGES).parquet(f"{path}/changes"), r.ts_sec if r else 1e-12)
