"""Registered queries over signals of all kinds, documents of commands, files and messages, with their SQL."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import EPOCH, NINE, mixed_wave
from .errors import WaveError
from .functions.names import check_pattern
from .functions.values import shown
from .operators import points
from .operators.search import search
from .queries import CLICK, ERR, T1, T2, _ch, _fmt, events
from .render import COMMANDS
from .sinks.vcd import write_vcd
from .sources.registry import open_wave
from .wave import Wave

Query = Callable[[SparkSession, str], DataFrame]
#: The 72-bit value of a purchase of 21.
WIDE = (1 << 71) + 21


def mixed(spark: SparkSession, sf_dir: str) -> Wave:
    return mixed_wave(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a local one in local sessions."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise WaveError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="edgeframe-")
    out = f"{where.removeprefix('file://')}/edgeframe-{uuid.uuid4().hex[:12]}"
    os.makedirs(out)
    return out


def _source() -> str:
    """mx: the records of the mixed wave; ms: its signals."""
    state = lambda n: f"substr('{NINE}', CAST({n} % 9 + 1 AS BIGINT), 1)"
    return f"""e0 AS (SELECT *, user_id % 2 AS usr, CAST(floor(value) AS BIGINT) AS whole FROM events),
 mx AS (SELECT concat('mix.m', usr, '.', event_type) AS path, event_type AS nm, usr, (epoch_us(ts) - {EPOCH}) // 1000 AS tick, event_id AS seq, whole,
 CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 72 ELSE 1 END AS width,
 CASE event_type WHEN 'click' THEN 'real' WHEN 'view' THEN CASE WHEN usr = 0 THEN 'event' ELSE 'str' END ELSE 'bits' END AS kind,
 CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN CAST(whole AS VARCHAR) ELSE rtrim(rtrim(printf('%.2f', value), '0'), '.') END
  WHEN 'view' THEN CASE WHEN usr = 0 THEN '' ELSE replace(props, ' ', '') END
  WHEN 'error' THEN CASE WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 11 = 0 THEN 'z' WHEN event_id % 7 = 0 THEN '1x' ELSE bin(whole % 16) END
  WHEN 'signup' THEN concat({state("event_id")}, {state("(event_id // 9)")}, CASE WHEN event_id % 23 = 0 THEN '1' ELSE '' END)
  ELSE CASE WHEN event_id % 29 = 0 THEN 'x1' ELSE concat('1', lpad(bin(whole), 71, '0')) END END AS raw FROM e0),
 ms AS (SELECT path, any_value(width) AS width, any_value(kind) AS kind, any_value(nm) AS nm, any_value(usr) AS usr FROM mx GROUP BY path)"""


def _norm(raw: str) -> str:
    """Four states of the nine."""
    return f"translate(lower({raw}), 'hluw-', '10xxx')"


def _ext(bits: str, width: str) -> str:
    return f"CASE WHEN length({bits}) >= {width} THEN {bits} ELSE lpad({bits}, {width}, CASE WHEN {bits}[1] IN ('x', 'z') THEN {bits}[1] ELSE '0' END) END"


def _mixed_fmt(raw: str = "raw") -> str:
    """Display text, written out for each width that the wave has."""
    full = f"({_ext(_norm(raw), 'width')})"
    digits = lambda n: " + ".join(f"CAST({full}[{i + 1}] = '1' AS BIGINT) * {1 << (n - 1 - i)}" for i in range(n))
    four, two = digits(4), digits(2)
    return f"""CASE WHEN {raw} IS NULL THEN NULL WHEN kind = 'event' THEN 'triggered' WHEN kind <> 'bits' THEN {raw}
 WHEN length({raw}) > width THEN concat('b', repeat('x', width)) WHEN regexp_matches({full}, '[xz]') THEN concat('b', {full})
 WHEN width = 4 THEN concat({four}, ' (0x', lower(hex({four})), ')') WHEN width = 2 THEN concat({two}, ' (0x', lower(hex({two})), ')')
 ELSE (SELECT concat(CAST(2361183241434822606848::HUGEINT + n AS VARCHAR), ' (0x8', lpad(lower(hex(n)), 17, '0'), ')') FROM (SELECT list_sum(list_transform(range(1, 17), lambda j : CASE WHEN {full}[56 + j] = '1' THEN 1::BIGINT << (16 - j) ELSE 0 END))::BIGINT AS n)) END"""


#: Conditions on one signal of the mixed wave: (signal, width, operator, value).
CONDITIONS = {
    "mixed_search_real_as_bits": ("mix.m0.click", 1, "=", "2"),
    "mixed_search_nine_number": ("mix.m0.signup", 2, "=", "3"),
    "mixed_search_nine_pattern": ("mix.m1.signup", 2, "=", "1x"),
    "mixed_search_nine_ne": ("mix.m0.signup", 2, "!=", "0"),
    "mixed_search_short_pattern": ("mix.m1.error", 4, "=", "z"),
    "mixed_search_wide_hex": ("mix.m0.purchase", 72, "=", f"0x{WIDE:x}"),
    "mixed_search_wide_binary": ("mix.m1.purchase", 72, "!=", f"b{WIDE:b}"),
}


def _condition_sql(signal: str, width: int, op: str, value: str) -> str:
    number = {"2": 2, "3": 3, "0": 0}.get(value, WIDE if value[0] in "0b" else None)
    known, logic = "regexp_matches(lower(v), '^[01hl]+$')", "regexp_matches(lower(v), '^[01xzhluw-]+$')"
    if number is not None:
        same = f"({known} AND ltrim({_norm('v')}, '0') = '{number:b}')" if number else f"({known} AND ltrim({_norm('v')}, '0') = '')"
    else:
        head = value[0] if value[0] in "xz" else "0"
        same = f"({logic} AND {_ext(_norm('v'), str(width))} = '{value.rjust(width, head)}')"
    holds = same if op == "=" else f"(NOT {same} AND NOT ({logic} AND NOT {known}))"
    return f"""WITH {_source()}, tk AS (SELECT tick, arg_max(raw, seq) AS v FROM mx WHERE path = '{signal}' GROUP BY tick UNION ALL SELECT 0, NULL WHERE NOT EXISTS (SELECT 1 FROM mx WHERE path = '{signal}' AND tick = 0)),
 ok AS (SELECT tick, coalesce({holds}, false) AS ok FROM tk), ed AS (SELECT *, lag(ok) OVER (ORDER BY tick) AS po FROM ok), eg AS (SELECT tick, ok, coalesce(lead(tick) OVER (ORDER BY tick), (SELECT max(tick) FROM mx)) AS e FROM ed WHERE po IS NULL OR po <> ok)
 SELECT tick AS begin_ticks, e AS end_ticks FROM eg WHERE ok"""


def _docs() -> dict[str, tuple[str, int | None, bool, dict[str, str]]]:
    """name: command, limit, verbose, arguments; over the events wave."""
    return {
        "list_short": ("list", 5, False, {}), "list_all": ("list", 0, False, {"filter": "error"}), "list_verbose": ("list", None, True, {}), "dump_short": ("dump", 7, False, {}), "dump_default": ("dump", None, False, {}), "dump_all": ("dump", 0, False, {"filter": "top.u3.*"}),
        "search_short": ("search", 3, False, {"condition": f"{ERR}=1"}), "search_all": ("search", 0, False, {"condition": f"{ERR}=1"}), "compare_short": ("compare", 4, False, {"at": f"{T1},{T2}"}), "snapshot_short": ("snapshot", 6, False, {"at": str(T2)}),
    }


def _doc(wave: Wave, name: str) -> str:
    command, limit, verbose, args = _docs()[name]
    return COMMANDS[command](wave, limit, verbose, **args).run(True)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _message(make: Callable[[], object]) -> str:
    try:
        make()
    except WaveError as e:
        return str(e)
    return ""


def queries() -> dict[str, Query]:
    def on(f: Callable[[Wave], DataFrame]) -> Query:
        return lambda spark, sf_dir: f(mixed(spark, sf_dir))

    def found(condition: tuple[str, int, str, str]) -> Query:
        signal, _, op, value = condition
        return on(lambda w: search(w, f"{signal}{op}{value}").rows)

    def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
        wave = events(spark, sf_dir)
        rows = []
        for name in _docs():
            d = json.loads(_doc(wave, name))
            rows.append((name, d["shown"], d["truncated"], d.get("total"), d.get("total_is_exact")))
        return _table(spark, rows, "name string, shown long, truncated boolean, total long, exact boolean")

    def list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, [(i, line) for i, line in enumerate(COMMANDS["list"](events(spark, sf_dir), 4, False).text())], "line long, text string")

    def times(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = json.loads(_doc(events(spark, sf_dir), "dump_default"))
        return _table(spark, [(r["time_ticks"], r["time_h"]) for r in d["events"]], "time_ticks long, time_h string").distinct()

    def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        wave = events(spark, sf_dir)
        some = [search(wave, c) for c in (f"{ERR}=1, zalias.error.u3==1 ,{CLICK}!=x", "u3.error=1,top.u3.ERROR=1,u3.error=0x1")]
        return _table(spark, [(s.condition, s.resolved) for s in some], "condition string, resolved string")

    def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = json.loads(COMMANDS["snapshot"](events(spark, sf_dir), None, False, at="7200000000").run(True))
        return _table(spark, [(d["selected"], d["known"], d["undefined"], d["shown"])], "selected long, known long, undefined long, shown long")

    def vcd(spark: SparkSession, sf_dir: str) -> Wave:
        where = f"{_shared(spark)}/events.vcd"
        with open(where, "w") as f:
            write_vcd(events(spark, sf_dir), f)
        return open_wave(spark, where)

    def vcd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = vcd(spark, sf_dir)
        return w.records(w.signals).select("path", "tick", "raw")

    def vcd_head(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = vcd(spark, sf_dir)
        many = w.decls.agg(F.count("*").alias("reference_count"), F.count_distinct("backend_sid").alias("signal_count"), F.count_distinct("scope_path").alias("scopes"))
        return w.meta.select("timescale", "t_min", "t_max").crossJoin(many)  # one row each

    def parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = f"{_shared(spark)}/events.parquet"
        events(spark, sf_dir).save(where)
        return points.snapshot(open_wave(spark, where), T2)

    def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _shared(spark)
        tries = {
            "missing": lambda: open_wave(spark, "/nonexistent/a.vcd"), "folder": lambda: open_wave(spark, os.path.dirname("/usr/bin/env") + "/"), "foreign": lambda: open_wave(spark, "a.fsdb"),
            "long": lambda: check_pattern("x" * 257), "wildcards": lambda: check_pattern("?" * 17),
            "broken": lambda: (open(f"{folder}/b.vcd", "w").write("no header"), open_wave(spark, f"{folder}/b.vcd")),
        }
        return _table(spark, [(name, _message(f)) for name, f in tries.items()], "name string, message string")

    return {
        "mixed_fmt": on(lambda w: w.records(w.signals).select("path", "tick", F.col("seq").alias("seq"), shown(F.col("raw"), F.col("kind"), F.col("width"), True).alias("value"))),
        "mixed_snapshot": on(lambda w: points.snapshot(w, T2 // 1000).select("path", "value", "undefined", "width")),
        "mixed_summary": on(lambda w: points.summary(w).select("path", "kind", "changes", "rise_count", "fall_count", "last", "first_at", "last_at", "unique")),
        "mixed_event_changed": on(lambda w: search(w, "mix.m0.error!=0", changed="mix.m0.view").rows.select("time_ticks")),
        "page_totals": totals, "list_json": lambda spark, sf_dir: _table(spark, [(_doc(events(spark, sf_dir), "list_short"),)], "doc string"), "list_text": list_text, "times_text": times, "search_labels": labels,
        "snapshot_counts": counts, "vcd_records": vcd_records, "vcd_head": vcd_head, "parquet_round_trip": parquet, "error_messages": messages,
    } | {name: found(c) for name, c in CONDITIONS.items()}


def oracle_sql() -> dict[str, str]:
    upto = T2 // 1000
    listed = "SELECT d.full_path AS path, d.width FROM decl d ORDER BY d.full_path"
    count = lambda name, shown_, total, truncated, exact: f"SELECT '{name}' AS name, {shown_} AS shown, {truncated} AS truncated, {total} AS total, {exact} AS exact"
    decl, dumped = "(SELECT count(*) FROM decl)", "(SELECT count(*) FROM ch WHERE path LIKE 'top.u3.%')"
    error = "(SELECT count(*) FROM decl WHERE key IN (SELECT key FROM decl WHERE full_path LIKE '%error%'))"
    # spans of a one-bit signal being 1
    spans = f"(SELECT count(*) FROM (SELECT raw, lag(raw) OVER (ORDER BY tick, seq) AS p FROM ch WHERE path = '{ERR}') WHERE raw = '1' AND p IS DISTINCT FROM '1')"
    differ = f"(SELECT count(*) FROM (SELECT path, max_by(raw, row(tick, seq)) FILTER (tick <= {T1}) AS a, max_by(raw, row(tick, seq)) AS b FROM ch WHERE tick <= {T2} GROUP BY path) WHERE a IS DISTINCT FROM b)"
    pages = " UNION ALL ".join([
        count("list_short", 5, decl, "true", "true"), count("list_all", error, error, "false", "true"), count("list_verbose", decl, decl, "false", "true"), count("dump_short", 7, 8, "true", "false"), count("dump_default", 200, 201, "true", "false"), count("dump_all", dumped, dumped, "false", "true"),
        count("search_short", 3, 4, "true", "false"), count("search_all", spans, spans, "false", "true"), count("compare_short", 4, differ, "true", "true"), count("snapshot_short", 6, "NULL", "true", "NULL"),
    ])
    second = "tick * 1e-6"
    known = "(SELECT count(DISTINCT path) FROM ch WHERE tick <= 7200000000)"
    out = {
        "mixed_fmt": f"WITH {_source()} SELECT path, tick, seq, {_mixed_fmt()} AS value FROM mx",
        "mixed_snapshot": f"WITH {_source()}, v AS (SELECT path, max_by(raw, row(tick, seq)) AS raw FROM mx WHERE tick <= {upto} GROUP BY path) SELECT ms.path, {_mixed_fmt()} AS value, raw IS NULL AS undefined, width FROM ms LEFT JOIN v USING (path)",
        "mixed_summary": f"""WITH {_source()}, w AS (SELECT *, lag(raw) OVER (PARTITION BY path ORDER BY tick, seq) AS prev FROM mx), st AS (SELECT path, count(*) AS changes, count(*) FILTER (prev = '0' AND raw = '1') AS r, count(*) FILTER (prev = '1' AND raw = '0') AS f, max_by(raw, row(tick, seq)) AS raw, min(tick) AS first_at, max(tick) AS last_at, count(DISTINCT raw) AS uq FROM w WHERE tick > 0 GROUP BY path)
 SELECT path, 'active' AS kind, changes, CASE WHEN width = 1 THEN r END AS rise_count, CASE WHEN width = 1 THEN f END AS fall_count, {_mixed_fmt()} AS last, first_at, last_at, uq AS "unique" FROM ms JOIN st USING (path)""",
        "mixed_event_changed": f"""WITH {_source()}, tk AS (SELECT tick, max_by(raw, seq) FILTER (path = 'mix.m0.error') AS v, bool_or(path = 'mix.m0.view') AS c FROM mx WHERE path IN ('mix.m0.error', 'mix.m0.view') GROUP BY tick), fl AS (SELECT tick, c, last_value(v IGNORE NULLS) OVER (ORDER BY tick) AS v FROM tk)
 SELECT tick AS time_ticks FROM fl WHERE c AND tick > 0 AND v IS NOT NULL AND regexp_matches(v, '^[01]+$') AND ltrim(v, '0') <> ''""",
        "page_totals": f"WITH {_ch()} {pages}",
        "list_json": f"""WITH {_ch()} SELECT concat('{{"shown":5,"truncated":true,"signals":[', string_agg(concat('{{"path":"', path, '","width":', width, ',"type":"', CASE WHEN path LIKE 'zalias%' THEN 'reg' ELSE 'wire' END, '"}}'), ',' ORDER BY path), '],"total":', any_value(n), ',"total_is_exact":true}}') AS doc FROM (SELECT *, (SELECT count(*) FROM decl) AS n FROM ({listed} LIMIT 5))""",
        "list_text": f"""WITH {_ch()}, l AS ({listed} LIMIT 4), n AS (SELECT count(*) AS n FROM decl) SELECT 0 AS line, concat('Matched: ', n, '/', (SELECT count(*) FROM sig)) AS text FROM n UNION ALL SELECT row_number() OVER (ORDER BY path), printf('  %-60s %5d wire', path, width) FROM l UNION ALL SELECT 5, concat('... truncated: 4/', n, ' signals shown. (use --limit 0 to see all)') FROM n""",
        "times_text": f"""WITH {_ch()}, f AS (SELECT ch.tick FROM ch JOIN sig USING (path) ORDER BY tick, decl_order, seq LIMIT 200) SELECT DISTINCT tick AS time_ticks, CASE WHEN tick = 0 THEN '0s' WHEN tick < 1000 THEN printf('%gus', tick::DOUBLE) WHEN {second} / 1e-3 < 1000 THEN printf('%gms', {second} / 1e-3) ELSE printf('%gs', {second}) END AS time_h FROM f""",
        "search_labels": f"SELECT '{ERR}=1,zalias.error.u3==1,{CLICK}!=x' AS condition, '{ERR}=1,{ERR}==1,{CLICK}!=x' AS resolved UNION ALL SELECT 'u3.error=1,u3.error=0x1', '{ERR}=1,{ERR}=0x1'",
        "snapshot_counts": f"WITH {_ch()}, s AS (SELECT count(*) AS n FROM sig) SELECT n AS selected, {known} AS known, n - {known} AS undefined, least(200, {known}) AS shown FROM s",
        "vcd_records": f"WITH {_ch()} SELECT path, tick, raw FROM ch",
        "vcd_head": f"WITH {_ch()} SELECT '1us' AS timescale, min(tick) AS t_min, max(tick) AS t_max, (SELECT count(*) FROM decl) AS reference_count, (SELECT count(*) FROM sig) AS signal_count, (SELECT count(DISTINCT scope_path) FROM decl) AS scopes FROM ch",
        "parquet_round_trip": f"WITH {_ch()}, v AS (SELECT path, max_by(raw, row(tick, seq)) AS raw FROM ch WHERE tick <= {T2} GROUP BY path) SELECT sig.path, {_fmt('raw', 'width')} AS value, raw IS NULL AS undefined, width, 'wire' AS type FROM sig LEFT JOIN v USING (path)",
        "error_messages": """SELECT * FROM (VALUES ('missing', 'cannot open waveform file: /nonexistent/a.vcd'), ('folder', 'not a file: /usr/bin/'), ('foreign', 'no backend for .fsdb files. Set EDGEFRAME_PLUGIN_FSDB to module:class, or register a reader'),
 ('long', 'filter pattern too long; max length is 256'), ('wildcards', 'too many wildcard characters in filter pattern; max is 16'), ('broken', 'failed to read waveform: unexpected ''no'' in the header')) v(name, message)""",
    }
    return out | {name: _condition_sql(*c) for name, c in CONDITIONS.items()}
