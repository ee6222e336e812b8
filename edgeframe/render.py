"""Documents of command results: compact JSON with stable keys, and text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import WaveError
from .functions.times import fmt_time, parse_time, parse_window
from .functions.values import UNDEF
from .operators import points, tables
from .operators.search import search
from .wave import Wave

DEFAULT_LIMIT = 200


class Page:
    """At most ``limit`` rows (0: all, streamed) of a frame, and how many there are or that there are more."""

    def __init__(self, df: DataFrame, limit: int, exact: bool):
        self.truncated = False
        if not limit:
            self.shown = self.total = df.count()
            self.rows: Iterable[Row] = df.toLocalIterator(prefetchPartitions=True)
            return
        rows = df.limit(limit + 1).collect()
        self.truncated = len(rows) > limit
        self.rows = rows[:limit]
        self.shown = len(self.rows)
        self.total = df.count() if self.truncated and exact else len(rows)

    def note(self, noun: str, exact: bool) -> list[str]:
        return [f"... truncated: {self.shown}/{self.total}{'' if exact else '+'} {noun} shown. (use --limit 0 to see all)"] if self.truncated else []


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def compact_parts(doc: dict[str, Any]) -> Iterator[str]:
    """A document piece by piece; iterators become arrays."""
    for i, (key, value) in enumerate(doc.items()):
        yield f"{',' if i else '{'}{compact(key)}:"
        if isinstance(value, Iterator):
            yield "["
            for j, row in enumerate(value):
                yield f"{',' if j else ''}{compact(row)}"
            yield "]"
        else:
            yield compact(value)
    yield "}" if doc else "{}"


def _time(ticks: int | None, ts: float, name: str) -> dict[str, Any]:
    return {f"{name}_ticks": ticks, f"{name}_h": fmt_time(ticks, ts)}


class Command:
    """One command over a wave; ``doc()`` is its JSON document and ``text()`` its lines."""

    def __init__(self, wave: Wave, limit: int | None = None, verbose: bool = False, **args: str | None):
        self.wave, self.verbose, self.args = wave, verbose, args
        self.held: DataFrame | None = None  # read more than once, let go with the output
        self.ts = wave.ts_sec
        self.limit = limit if limit is not None else 0 if verbose else DEFAULT_LIMIT

    def arg(self, name: str) -> str | None:
        return self.args.get(name)

    def h(self, ticks: int | None) -> str | None:
        return fmt_time(ticks, self.ts)

    def typed(self, r) -> dict[str, Any]:
        return {"width": r.width, "type": r.type} if self.verbose else {}

    def text(self) -> Iterable[str]:
        raise NotImplementedError

    def doc(self) -> dict[str, Any]:
        raise NotImplementedError

    def parts(self, as_json: bool) -> Iterator[str]:
        """The output, a piece at a time: no more than a few rows are held however long it is."""
        try:
            if as_json:
                yield from compact_parts(self.doc())
                yield "\n"
            else:
                for line in self.text():
                    yield f"{line}\n"
        finally:
            if self.held is not None:
                self.held.unpersist()

    def run(self, as_json: bool) -> str:
        return "".join(self.parts(as_json))[:-1]


class Info(Command):
    def row(self):
        return tables.info(self.wave).first()

    def doc(self) -> dict[str, Any]:
        r = self.row()
        out: dict[str, Any] = {"file": r.path, "size_bytes": r.size_bytes, "timescale": r.timescale, "date": r.date, "version": r.version, "comments": [], "signal_count": r.signal_count, "reference_count": r.reference_count, "synthesized_buses": 0, "var_types": {t.type: t.n for t in r.var_types}}
        for name, ticks in (("time_min", r.t_min), ("time_max", r.t_max), ("duration", r.duration)):
            out |= {name: self.h(ticks)} | _time(ticks, self.ts, name)
        return out | {"scopes": r.scopes}

    def text(self) -> Iterable[str]:
        r = self.row()
        count = str(r.signal_count) if r.signal_count == r.reference_count else f"{r.signal_count} unique ({r.reference_count} $var refs via aliases)"
        lines = [f"File      : {r.path}", f"Size      : {r.size_bytes:,} bytes"]
        lines += [f"{label}: {value}" for label, value in (("Date      ", r.date), ("Tool      ", r.version)) if value]
        lines += [f"Timescale : {r.timescale}", f"Signals   : {count}", "Types     : " + ", ".join(f"{t.type}={t.n}" for t in r.var_types)]
        lines.append(f"Time      : {self.h(r.t_min)} ~ {self.h(r.t_max)} ({self.h(r.duration)})")
        return lines + [f"  scope: {s}" for s in r.scopes]


class List(Command):
    def page(self) -> Page:
        return Page(tables.list_signals(self.wave, self.arg("filter")), self.limit, True)

    def doc(self) -> dict[str, Any]:
        p = self.page()
        rows = ({"path": r.path, "width": r.width, "type": r.type} | ({"id": r.id} if self.verbose else {}) for r in p.rows)
        return {"shown": p.shown, "truncated": p.truncated, "signals": rows, "total": p.total, "total_is_exact": True}

    def text(self) -> Iterator[str]:
        p = self.page()
        yield f"Matched: {p.total}/{self.wave.signals.count()}"
        yield from (f"  {r.path:<60} {r.width:>5} {r.type}" for r in p.rows)
        yield from p.note("signals", True)


class Dump(Command):
    def page(self) -> Page:
        self.t0, self.t1 = parse_window(self.arg("begin"), self.arg("end"), self.ts)
        return Page(tables.dump(self.wave, self.t0, self.t1, self.arg("filter")), self.limit, False)

    def doc(self) -> dict[str, Any]:
        p = self.page()
        rows = ({"time": self.h(r.tick)} | _time(r.tick, self.ts, "time") | {"path": r.path, "value": r.value} | self.typed(r) for r in p.rows)
        return {"shown": p.shown, "truncated": p.truncated, "events": rows, "total": p.total, "total_is_exact": not p.truncated}

    def text(self) -> Iterator[str]:
        p, now = self.page(), None
        if not p.shown:
            yield "(no changes in range)"
        for r in p.rows:
            if r.tick != now:
                now = r.tick
                yield f"T={self.h(now)}"
            yield f"  {r.path:<55}{f' w={r.width} {r.type}' if self.verbose else ''} = {r.value}"
        yield from p.note("events", False)


class Summary(Command):
    def load(self) -> Page:
        self.t0, self.t1 = parse_window(self.arg("begin"), self.arg("end"), self.ts)
        rows = self.held = points.summary(self.wave, self.t0, self.t1, self.arg("filter")).persist()  # a row a signal
        self.counts = points.summary_counts(rows).first()
        return Page(rows if self.verbose else rows.where("kind <> 'undefined'"), self.limit, True)

    def doc(self) -> dict[str, Any]:
        p = self.load()
        c = self.counts
        window = {"begin": self.h(self.t0), "end": self.h(self.t1)} | _time(self.t0, self.ts, "begin") | _time(self.t1, self.ts, "end")
        return {"window": window, **{k: c[k] for k in ("selected", "defined", "undefined", "active", "static")}, "shown": p.shown, "truncated": p.truncated, "rows": (self._row(r) for r in p.rows)}

    def _row(self, r) -> dict[str, Any]:
        out: dict[str, Any] = {"path": r.path, "kind": r.kind, "value": r.value, "changes": r.changes, "rise_count": r.rise_count, "fall_count": r.fall_count, "init": r.init, "last": r.last}
        if r.first_at is not None:
            out |= _time(r.first_at, self.ts, "first") | _time(r.last_at, self.ts, "last")
        if r.unique:
            out["unique"] = r.unique
        return out | self.typed(r)

    def text(self) -> Iterator[str]:
        p = self.load()
        c = self.counts
        yield from (f"Window: {self.h(self.t0)}..{self.h(self.t1) or '(end)'}", f"Selected: {c.selected}, Defined: {c.defined}, Undefined: {c.undefined}", f"Active: {c.active}, Static: {c.static}")
        part = None
        for r in p.rows:
            if r.kind != part:
                part = r.kind
                yield from ("", part.upper())
            line = f"  {r.path:<45}" + (f" w={r.width} {r.type}" if self.verbose or part == "undefined" else "")
            if part == "static":
                line += f" value={r.value}"
            elif part == "active":
                line += f" chg={r.changes}" + ("" if r.rise_count is None else f" r={r.rise_count} f={r.fall_count}") + f" init={r.init} last={r.last}"
                line += f" first@{self.h(r.first_at) or '-'} last@{self.h(r.last_at) or '-'} uniq={r.unique}" if self.verbose else ""
            yield line
        if not c.selected:
            yield "(no selected signals)"
        yield from p.note("rows", True)


class Snapshot(Command):
    def load(self) -> Page:
        self.at = parse_time(self.arg("at") or "", self.ts)
        rows = self.held = points.snapshot(self.wave, self.at, self.arg("filter")).persist()  # a row a signal
        self.known, self.undefined = rows.agg(F.count_if(~F.col("undefined")), F.count_if("undefined")).first()
        return Page(rows if self.verbose else rows.where("not undefined"), self.limit, True)

    def doc(self) -> dict[str, Any]:
        p = self.load()
        rows = ({"path": r.path, "value": r.value} | ({"undefined": True} if r.undefined else {}) | self.typed(r) for r in p.rows)
        return {"at": self.h(self.at)} | _time(self.at, self.ts, "at") | {"selected": self.known + self.undefined, "known": self.known, "undefined": self.undefined, "shown": p.shown, "truncated": p.truncated, "signals": rows}

    def text(self) -> Iterator[str]:
        p = self.load()
        yield f"Known snapshot @ {self.h(self.at)}" if self.known else f"No known values at {self.h(self.at)}."
        if self.verbose:
            yield f"Selected: {self.known + self.undefined}, Known: {self.known}, Undefined: {self.undefined}"
        for r in p.rows:
            yield f"  {r.path:<55}" + (f" w={r.width} {r.type}" if self.verbose and not r.undefined else "") + f" = {UNDEF if r.undefined else r.value}"
        yield from p.note("signals", True)


class Compare(Command):
    def load(self) -> Page:
        parts = [x.strip() for x in (self.arg("at") or "").split(",") if x.strip()]
        if len(parts) != 2:
            raise WaveError("compare requires --at T1,T2")
        self.t1, self.t2 = (parse_time(x, self.ts) for x in parts)
        return Page(points.compare(self.wave, self.t1, self.t2, self.arg("filter")), self.limit, True)

    def doc(self) -> dict[str, Any]:
        p = self.load()
        rows = ({"path": r.path, "at_t1": r.at_t1, "at_t2": r.at_t2} | self.typed(r) for r in p.rows)
        head = {"t1": self.h(self.t1)} | _time(self.t1, self.ts, "t1") | {"t2": self.h(self.t2)} | _time(self.t2, self.ts, "t2")
        return head | {"shown": p.shown, "truncated": p.truncated, "diffs": rows, "total": p.total, "total_is_exact": True}

    def text(self) -> Iterator[str]:
        p = self.load()
        same = points.unchanged(self.wave, self.t1, self.t2, self.arg("filter")).first().n
        yield from (f"Compare: {self.h(self.t1)} vs {self.h(self.t2)}", f"{p.total} changed, {same} unchanged")
        yield from (f"  {r.path:<48} {r.at_t1} -> {r.at_t2}" for r in p.rows)
        yield from p.note("diffs", True)


class Search(Command):
    NOUN = {"interval": "interval", "segment": "segment", "event": "event"}

    def load(self) -> Page:
        t0 = parse_time(self.arg("begin"), self.ts) if self.arg("begin") is not None else 0
        t1 = parse_time(self.arg("end"), self.ts) if self.arg("end") is not None else None
        self.found = search(self.wave, self.arg("condition") or "", self.arg("show"), self.arg("changed"), t0, t1)
        return Page(self.found.rows, self.limit, False)

    def doc(self) -> dict[str, Any]:
        p = self.load()
        s = self.found
        out: dict[str, Any] = {"mode": s.mode, "condition": s.condition, "condition_resolved": s.resolved}
        if s.changed:
            out["changed"] = s.changed.path
        out |= {"show": [x.path for x in s.show]} | _time(s.t0, self.ts, "begin") | _time(s.t1, self.ts, "end") | {"shown": p.shown, "truncated": p.truncated}
        return out | {f"{self.NOUN[s.mode]}s": (self._row(r) for r in p.rows), "total": p.total, "total_is_exact": not p.truncated}

    def _row(self, r) -> dict[str, Any]:
        s = self.found
        out = _time(r.time_ticks, self.ts, "time") if s.mode == "event" else _time(r.begin_ticks, self.ts, "begin") | _time(r.end_ticks, self.ts, "end")
        if s.mode != "interval":
            out["values"] = {v.path: v.value for v in r["values"]}
            if self.verbose:
                out["meta"] = {m.path: {"raw": m.raw, "width": m.width, "type": m.type} for m in r.meta}
        return out

    def text(self) -> Iterator[str]:
        p = self.load()
        s, noun = self.found, self.NOUN[self.found.mode]
        if not p.shown:
            where = f"{s.changed.path} changed and {s.resolved}" if s.changed else s.resolved
            yield f"No {noun} in {self.h(s.t0)}..{self.h(s.t1)} where {where}."
            return
        yield f"Found: {p.total}{'+' if p.truncated else ''} {noun}(s)"
        for r in p.rows:
            values = s.resolved if s.mode == "interval" else " ".join(f"{v.path}={v.value}" for v in r["values"])
            yield f"  T={self.h(r.time_ticks):<12} {values}" if s.mode == "event" else f"  {self.h(r.begin_ticks):<12}..{self.h(r.end_ticks):<12} {values}"
        yield from p.note(f"{noun}s", False)


COMMANDS: dict[str, type[Command]] = {"info": Info, "list": List, "dump": Dump, "summary": Summary, "snapshot": Snapshot, "compare": Compare, "search": Search}
