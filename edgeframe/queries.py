"""Registered queries over the driver's tables, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import EPOCH, events_wave, orders_wave
from .functions.conditions import parse_conditions
from .functions.values import shown
from .operators import points, tables
from .operators.search import search
from .wave import Wave

HALF_DAY = 43_200_000_000
T1, T2, T3 = 5 * 86_400_000_000, 12 * 86_400_000_000, 20 * 86_400_000_000


def events(spark: SparkSession, sf_dir: str, coarse: int = 1) -> Wave:
    return events_wave(spark.read.parquet(f"{sf_dir}/events.parquet"), coarse)


def orders(spark: SparkSession, sf_dir: str) -> Wave:
    return orders_wave(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _ch(coarse: int = 1) -> str:
    bit = "event_type IN ('error','signup')"
    return f"""ch AS (SELECT concat('top.u', user_id % 16, '.', event_type) AS path, user_id % 16 AS usr, event_type AS nm, (epoch_us(ts) - {EPOCH}) // {coarse} AS tick, event_id AS seq,
 CASE WHEN {bit} THEN 1 ELSE 8 END AS width,
 CASE WHEN {bit} THEN CASE WHEN event_id % 17 = 0 THEN 'x' WHEN value > 20 THEN '1' ELSE '0' END
      WHEN event_id % 17 = 0 THEN 'xxxxxxxx' WHEN event_id % 19 = 0 THEN 'zzzzzzzz'
      ELSE lpad(bin(CAST(floor(value) AS BIGINT) % 256), 8, '0') END AS raw FROM events),
 decl AS (SELECT DISTINCT ascii(nm) * 1000 + length(nm) * 100 + usr AS decl_idx, path AS full_path, concat('top.u', usr) AS scope_path, width, 'wire' AS type, path AS key FROM ch
 UNION ALL SELECT DISTINCT ascii(nm) * 1000 + length(nm) * 100 + usr + 1000000, concat('zalias.', nm, '.u', usr), concat('zalias.', nm), width, 'reg', path FROM ch),
 sig AS (SELECT key AS path, any_value(width) AS width, min(decl_idx) AS decl_order FROM decl GROUP BY key)"""


def _number(raw: str) -> str:
    return "(" + " + ".join(f"CAST(substr({raw}, {i + 1}, 1) = '1' AS BIGINT) * {1 << (7 - i)}" for i in range(8)) + ")"


def _fmt(raw: str, width: str) -> str:
    return f"CASE WHEN {raw} IS NULL THEN NULL WHEN {width} = 1 THEN {raw} WHEN regexp_matches({raw}, '[xz]') THEN concat('b', {raw}) ELSE concat({_number(raw)}, ' (0x', lpad(lower(hex({_number(raw)})), 2, '0'), ')') END"


def _summary_sql(t0: int, t1: int | None) -> str:
    b = t0 - 1 if t0 else 0
    upto = f"WHERE tick <= {t1}" if t1 is not None else ""
    return f"""WITH {_ch()}, w AS (SELECT *, lag(raw) OVER (PARTITION BY path ORDER BY tick, seq) AS prev, lead(tick) OVER (PARTITION BY path ORDER BY tick, seq) AS nxt FROM ch {upto}),
 st AS (SELECT path, count(*) FILTER (tick > {b}) AS changes, count(*) FILTER (tick > {b} AND prev = '0' AND raw = '1') AS r, count(*) FILTER (tick > {b} AND prev = '1' AND raw = '0') AS f,
 max_by(raw, row(tick, seq)) FILTER (tick <= {b}) AS base, max_by(raw, row(tick, seq)) AS final, min(tick) FILTER (tick > {b}) AS first_at, max(tick) FILTER (tick > {b}) AS last_at,
 count(DISTINCT raw) FILTER (tick > {b} OR nxt > {b} OR nxt IS NULL) AS uq FROM w GROUP BY path),
 su AS (SELECT CASE WHEN coalesce(changes, 0) > 0 THEN 'active' WHEN final IS NOT NULL THEN 'static' ELSE 'undefined' END AS kind, sig.path, sig.width, coalesce(changes, 0) AS changes, r, f, base, final, first_at, last_at, coalesce(uq, 0) AS uq FROM sig LEFT JOIN st USING (path))
 SELECT kind, path, CASE WHEN kind = 'static' THEN {_fmt("final", "width")} END AS value, changes, CASE WHEN width = 1 THEN coalesce(r, 0) END AS rise_count, CASE WHEN width = 1 THEN coalesce(f, 0) END AS fall_count,
 coalesce({_fmt("base", "width")}, '(undef)') AS init, coalesce({_fmt("final", "width")}, '(undef)') AS last, first_at, last_at, uq AS "unique", width, 'wire' AS type FROM su"""


def _snapshot_sql(t: int) -> str:
    return f"""WITH {_ch()}, v AS (SELECT path, max_by(raw, row(tick, seq)) AS raw FROM ch WHERE tick <= {t} GROUP BY path)
 SELECT sig.path, {_fmt("raw", "width")} AS value, raw IS NULL AS undefined, width, 'wire' AS type FROM sig LEFT JOIN v USING (path)"""


def _compare_sql(t1: int, t2: int) -> str:
    return f"""WITH {_ch()}, v AS (SELECT path, max_by(raw, row(tick, seq)) FILTER (tick <= {t1}) AS a, max_by(raw, row(tick, seq)) AS b FROM ch WHERE tick <= {t2} GROUP BY path)
 SELECT path, coalesce({_fmt("a", "width")}, '(undef)') AS at_t1, coalesce({_fmt("b", "width")}, '(undef)') AS at_t2, width, 'wire' AS type FROM v JOIN sig USING (path) WHERE a IS DISTINCT FROM b"""


def _sql_term(column: str, width: int, op: str, value: str) -> str:
    """A term as SQL: values of full width here, so only x and z need care."""
    (term,) = parse_conditions(f"s{op}{value}")
    known = f"NOT regexp_matches({column}, '[xz]')"
    if term.target.number is not None:
        same = f"({known} AND {column} = '{term.target.number:0{width}b}')"
    else:
        text = term.target.text
        head = text[0] if text[0] in "xz" else "0"
        same = f"({column} = '{text.rjust(width, head)}')" if len(text) <= width else "false"
    return f"coalesce({same}, false)" if op != "!=" else f"coalesce({known} AND NOT {same}, false)"


def _search_sql(terms: list[tuple[str, int, str, str]], show: list[tuple[str, int]] = (), changed: tuple[str, int] | None = None, t0: int = 0, t1: int | None = None, coarse: int = 1) -> str:
    """terms: (path, width, op, value); show and changed: (path, width)."""
    paths = list(dict.fromkeys([t[0] for t in terms] + [s[0] for s in show] + ([changed[0]] if changed else [])))
    n = {p: i for i, p in enumerate(paths)}
    floor = t0 - 1 if changed else t0
    end = f"{t1}" if t1 is not None else "(SELECT max(tick) FROM ch)"
    agg = ", ".join(f"max_by(raw, row(tick, seq)) FILTER (path = '{p}') AS v{i}, min(raw) FILTER (path = '{p}') AS lo{i}, max(raw) FILTER (path = '{p}') AS hi{i}" for p, i in n.items())
    fill = ", ".join(f"last_value(v{i} IGNORE NULLS) OVER (ORDER BY t) AS n{i}, last_value(v{i} IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b{i}" for i in n.values())
    holds = " AND ".join(_sql_term(f"n{n[p]}", w, op, v) for p, w, op, v in terms)
    quoted = ", ".join(f"'{p}'" for p in paths)
    base = f"""WITH {_ch(coarse)}, src AS (SELECT path, tick, seq, raw, greatest(tick, {floor}) AS t FROM ch WHERE tick <= {end} AND path IN ({quoted}) UNION ALL SELECT NULL, {floor}, -1, NULL, {floor}),
 tk AS (SELECT t, {agg} FROM src GROUP BY t), fl AS (SELECT *, {fill} FROM tk), ok AS (SELECT *, {holds} AS ok FROM fl)"""
    text = lambda p, w: f"coalesce({_fmt(f'n{n[p]}', str(w))}, '(undef)')"
    if changed:
        c = n[changed[0]]
        cols = "".join(f", {text(p, w)} AS v{i}" for i, (p, w) in enumerate(show or [changed]))
        return f"{base} SELECT t AS time_ticks{cols} FROM ok WHERE ok AND t >= {t0} AND b{c} IS NOT NULL AND lo{c} IS NOT NULL AND (lo{c} <> b{c} OR hi{c} <> b{c})"
    key = "concat_ws('|'" + "".join(f", {text(p, w)}" for p, w in show) + ")" if show else "''"
    cols = "".join(f", {text(p, w)} AS v{i}" for i, (p, w) in enumerate(show))
    keep = "".join(f", v{i}" for i in range(len(show)))
    return f"""{base}, ky AS (SELECT t, ok, CASE WHEN ok THEN {key} END AS k{cols} FROM ok), ed AS (SELECT *, row_number() OVER (ORDER BY t) AS rn, lag(ok) OVER (ORDER BY t) AS po, lag(k) OVER (ORDER BY t) AS pk FROM ky),
 eg AS (SELECT *, coalesce(lead(t) OVER (ORDER BY t), {end}) AS e FROM ed WHERE rn = 1 OR ok IS DISTINCT FROM po OR k IS DISTINCT FROM pk)
 SELECT t AS begin_ticks, e AS end_ticks{keep} FROM eg WHERE ok AND {t0} < {end}"""


ERR, SIGN, CLICK, VIEW, BUY = "top.u3.error", "top.u5.signup", "top.u3.click", "top.u7.view", "top.u2.purchase"


def _found(wave: Wave, shows: int = 0, **args) -> DataFrame:
    s = search(wave, **args)
    first = ["time_ticks"] if s.mode == "event" else ["begin_ticks", "end_ticks"]
    return s.rows.select(*first, *(F.col("values")[i]["value"].alias(f"v{i}") for i in range(shows)))


def _values(wave: Wave) -> Column:
    return shown(F.col("raw"), F.col("kind"), F.col("width"), wave.wide)


def _searches() -> dict[str, tuple[dict, dict]]:
    """name: (arguments of search, arguments of its SQL)."""
    return {
        "search_interval": ({"condition": f"{ERR}=1"}, {"terms": [(ERR, 1, "=", "1")]}),
        "search_interval_and": ({"condition": f"{ERR}=1,{SIGN}==0"}, {"terms": [(ERR, 1, "=", "1"), (SIGN, 1, "==", "0")]}),
        "search_interval_ne": ({"condition": f"{CLICK}!=3"}, {"terms": [(CLICK, 8, "!=", "3")]}),
        "search_interval_4state": ({"condition": f"{CLICK}=x"}, {"terms": [(CLICK, 8, "=", "x")]}),
        "search_interval_hex": ({"condition": f"{CLICK}=0x15"}, {"terms": [(CLICK, 8, "=", "0x15")]}),
        "search_window_end": ({"condition": f"{ERR}!=1", "begin": T1, "end": T2}, {"terms": [(ERR, 1, "!=", "1")], "t0": T1, "t1": T2}),
        "search_zero_width": ({"condition": f"{ERR}!=1", "begin": T2, "end": T2}, {"terms": [(ERR, 1, "!=", "1")], "t0": T2, "t1": T2}),
        "search_segment": ({"condition": f"{ERR}=1", "show": CLICK, "shows": 1}, {"terms": [(ERR, 1, "=", "1")], "show": [(CLICK, 8)]}),
        "search_segment_multi": ({"condition": f"{SIGN}=0", "show": f"{VIEW},{CLICK}", "shows": 2, "begin": T1, "end": T3}, {"terms": [(SIGN, 1, "=", "0")], "show": [(CLICK, 8), (VIEW, 8)], "t0": T1, "t1": T3}),
        "search_event": ({"condition": f"{ERR}=1", "changed": CLICK, "shows": 1}, {"terms": [(ERR, 1, "=", "1")], "changed": (CLICK, 8)}),
        "search_event_show": ({"condition": f"{ERR}!=1", "changed": SIGN, "show": f"{CLICK},{ERR}", "shows": 2, "begin": T1}, {"terms": [(ERR, 1, "!=", "1")], "changed": (SIGN, 1), "show": [(CLICK, 8), (ERR, 1)], "t0": T1}),
        "search_event_ties": ({"condition": f"{ERR}=1", "changed": SIGN, "shows": 1, "coarse": HALF_DAY}, {"terms": [(ERR, 1, "=", "1")], "changed": (SIGN, 1), "coarse": HALF_DAY}),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_events(f: Callable[[Wave], DataFrame]):
        return lambda spark, sf_dir: f(events(spark, sf_dir))

    def finder(args: dict):
        args = dict(args)
        coarse = args.pop("coarse", 1)
        return lambda spark, sf_dir: _found(events(spark, sf_dir, coarse), **args)

    def info_meta(w: Wave) -> DataFrame:
        return tables.info(w).select("signal_count", "reference_count", F.col("t_min").alias("time_min_ticks"), F.col("t_max").alias("time_max_ticks"), F.col("duration").alias("duration_ticks"), F.array_join("scopes", ",").alias("scopes"), F.array_join(F.transform("var_types", lambda t: F.concat(t["type"], F.lit("="), t["n"].cast("string"))), ",").alias("var_types"))

    def asof_multi(w: Wave) -> DataFrame:
        at = w.changes.select("backend_sid").distinct().select("backend_sid", F.explode(F.array(*(F.lit(t).cast("long") for t in (T1, T2, T3)))).alias("tick"))
        return points.asof(w, at).select(F.col("backend_sid").alias("path"), "tick", "raw")

    out = {
        "info_meta": on_events(info_meta),
        "info_types": on_events(tables.type_counts),
        "info_scopes": on_events(tables.scopes),
        "signal_table": on_events(lambda w: w.signals.select("sid", "path", F.array_join("aliases", ",").alias("aliases"), "width", "type", "kind", F.array_join("scopes", ",").alias("scopes"), "decl_order")),
        "list_all": on_events(tables.list_signals),
        "list_filter_substr": on_events(lambda w: tables.list_signals(w, "U1.click, error")),
        "list_filter_glob": on_events(lambda w: tables.list_signals(w, "top.u1?.*,*view.u3")),
        "dump_window": on_events(lambda w: tables.dump(w, T1, T1 + 3_600_000_000 * 6)),
        "dump_topk": on_events(lambda w: tables.dump(w, T2, None, None, 201)),
        "dump_filter": on_events(lambda w: tables.dump(w, 0, T2, "top.u3.*")),
        "summary_full": on_events(points.summary),
        "summary_window": on_events(lambda w: points.summary(w, T1, T2)),
        "summary_static_active_counts": on_events(lambda w: points.summary_counts(points.summary(w, 3_600_000_000, 7_200_000_000 * 8))),
        "snapshot_at": on_events(lambda w: points.snapshot(w, T2)),
        "snapshot_undefined": on_events(lambda w: points.snapshot(w, 7_200_000_000)),
        "compare_diff": on_events(lambda w: points.compare(w, T1, T2)),
        "compare_undef": on_events(lambda w: points.compare(w, 3_600_000_000, 86_400_000_000)),
        "compare_unchanged": on_events(lambda w: points.unchanged(w, T1, T1 + 3_600_000_000)),
        "asof_multi": on_events(asof_multi),
        "fmt_val": on_events(lambda w: w.records(w.signals).select("path", "tick", _values(w).alias("value"))),
        "fmt_val_xz": on_events(lambda w: w.records(w.signals).where(F.col("raw").rlike("[xz]")).groupBy(_values(w).alias("value")).agg(F.count("*").alias("n"))),
        "orders_snapshot": lambda spark, sf_dir: points.snapshot(orders(spark, sf_dir), 9500),
        "orders_summary": lambda spark, sf_dir: points.summary(orders(spark, sf_dir), 9000, 10000).select("kind", "path", "changes", "init", "last", "first_at", "last_at", "unique"),
    }
    return out | {name: finder(args) for name, (args, _) in _searches().items()}


def oracle_sql() -> dict[str, str]:
    listed = "SELECT d.full_path AS path, d.width, 'wire' AS type, s.id FROM decl d JOIN (SELECT path AS key, row_number() OVER (ORDER BY path) - 1 AS id FROM sig) s USING (key)"
    dumped = f"SELECT tick, path, {_fmt('raw', 'ch.width')} AS value, ch.width, 'wire' AS type FROM ch"
    ord_ = "WITH oc AS (SELECT concat('shop.c', o_custkey % 32) AS path, epoch_us(o_orderdate) // 86400000000 AS tick, o_orderkey AS seq, o_orderstatus AS raw FROM orders)"
    counted = _summary_sql(3_600_000_000, 7_200_000_000 * 8)
    out = {
        "info_meta": f"""WITH {_ch()} SELECT (SELECT count(*) FROM sig) AS signal_count, (SELECT count(*) FROM decl) AS reference_count, min(tick) AS time_min_ticks, max(tick) AS time_max_ticks, max(tick) - min(tick) AS duration_ticks,
 (SELECT string_agg(scope_path, ',' ORDER BY scope_path) FROM (SELECT DISTINCT scope_path FROM decl)) AS scopes, (SELECT string_agg(concat(type, '=', n), ',' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM decl GROUP BY type)) AS var_types FROM ch""",
        "info_types": f"WITH {_ch()} SELECT type, count(*) AS n FROM decl GROUP BY type",
        "info_scopes": f"WITH {_ch()} SELECT DISTINCT scope_path FROM decl",
        "signal_table": f"WITH {_ch()} SELECT row_number() OVER (ORDER BY key) - 1 AS sid, key AS path, string_agg(full_path, ',' ORDER BY full_path) AS aliases, any_value(width) AS width, 'wire' AS type, 'bits' AS kind, string_agg(scope_path, ',' ORDER BY decl_idx) AS scopes, min(decl_idx) AS decl_order FROM decl GROUP BY key",
        "list_all": f"WITH {_ch()} {listed}",
        "list_filter_substr": f"WITH {_ch()} {listed} WHERE key IN (SELECT key FROM decl WHERE lower(full_path) LIKE '%u1.click%' OR lower(full_path) LIKE '%error%')",
        "list_filter_glob": f"WITH {_ch()} {listed} WHERE key IN (SELECT key FROM decl WHERE full_path LIKE 'top.u1_.%' OR full_path LIKE '%view.u3')",
        "dump_window": f"WITH {_ch()} {dumped} WHERE tick BETWEEN {T1} AND {T1 + 3_600_000_000 * 6}",
        "dump_topk": f"WITH {_ch()} SELECT tick, path, value, width, type FROM (SELECT tick, ch.path, seq, decl_order, {_fmt('raw', 'ch.width')} AS value, ch.width, 'wire' AS type FROM ch JOIN sig USING (path) WHERE tick >= {T2} ORDER BY tick, decl_order, seq LIMIT 201)",
        "dump_filter": f"WITH {_ch()} {dumped} WHERE tick <= {T2} AND path LIKE 'top.u3.%'",
        "summary_full": _summary_sql(0, None),
        "summary_window": _summary_sql(T1, T2),
        "summary_static_active_counts": f"SELECT count(*) AS selected, count(*) FILTER (kind <> 'undefined') AS defined, count(*) FILTER (kind = 'undefined') AS undefined, count(*) FILTER (kind = 'active') AS active, count(*) FILTER (kind = 'static') AS static FROM ({counted})",
        "snapshot_at": _snapshot_sql(T2),
        "snapshot_undefined": _snapshot_sql(7_200_000_000),
        "compare_diff": _compare_sql(T1, T2),
        "compare_undef": _compare_sql(3_600_000_000, 86_400_000_000),
        "compare_unchanged": f"WITH {_ch()}, v AS (SELECT path, max_by(raw, row(tick, seq)) FILTER (tick <= {T1}) AS a, max_by(raw, row(tick, seq)) AS b FROM ch WHERE tick <= {T1 + 3_600_000_000} GROUP BY path) SELECT count(*) FILTER (a IS NOT DISTINCT FROM b) AS n FROM v",
        "asof_multi": f"WITH {_ch()}, p AS (SELECT path, t.tick FROM (SELECT DISTINCT path FROM ch) CROSS JOIN (VALUES ({T1}), ({T2}), ({T3})) t(tick)) SELECT p.path, p.tick, max_by(raw, row(ch.tick, seq)) AS raw FROM p LEFT JOIN ch ON ch.path = p.path AND ch.tick <= p.tick GROUP BY p.path, p.tick",
        "fmt_val": f"WITH {_ch()} SELECT path, tick, {_fmt('raw', 'width')} AS value FROM ch",
        "fmt_val_xz": f"WITH {_ch()} SELECT {_fmt('raw', 'width')} AS value, count(*) AS n FROM ch WHERE regexp_matches(raw, '[xz]') GROUP BY 1",
        "orders_snapshot": f"{ord_} SELECT s.path, v.raw AS value, v.raw IS NULL AS undefined, 1 AS width, 'string' AS type FROM (SELECT DISTINCT path FROM oc) s LEFT JOIN (SELECT path, max_by(raw, row(tick, seq)) AS raw FROM oc WHERE tick <= 9500 GROUP BY path) v USING (path)",
        "orders_summary": f"""{ord_}, w AS (SELECT *, lead(tick) OVER (PARTITION BY path ORDER BY tick, seq) AS nxt FROM oc WHERE tick <= 10000), st AS (SELECT path, count(*) FILTER (tick > 8999) AS changes, max_by(raw, row(tick, seq)) FILTER (tick <= 8999) AS base, max_by(raw, row(tick, seq)) AS final,
 min(tick) FILTER (tick > 8999) AS first_at, max(tick) FILTER (tick > 8999) AS last_at, count(DISTINCT raw) FILTER (tick > 8999 OR nxt > 8999 OR nxt IS NULL) AS uq FROM w GROUP BY path)
 SELECT CASE WHEN coalesce(changes, 0) > 0 THEN 'active' WHEN final IS NOT NULL THEN 'static' ELSE 'undefined' END AS kind, s.path, coalesce(changes, 0) AS changes, coalesce(base, '(undef)') AS init, coalesce(final, '(undef)') AS last, first_at, last_at, coalesce(uq, 0) AS "unique" FROM (SELECT DISTINCT path FROM oc) s LEFT JOIN st USING (path)""",
    }
    return out | {name: _search_sql(**args) for name, (_, args) in _searches().items()}
