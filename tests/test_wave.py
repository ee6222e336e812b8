import json
import random

import pytest
from pyspark.sql import functions as F

from edgeframe import queries
from edgeframe.cli import main
from edgeframe.errors import WaveError
from edgeframe.functions.values import shown
from edgeframe.operators import points, tables
from edgeframe.operators.search import search
from edgeframe.render import COMMANDS
from edgeframe.sources.registry import open_wave, register, unregister
from edgeframe.sources.vcd import vcd_wave
from edgeframe.wave import CHANGES, DECLS, META, Wave

VCD = """$timescale 1ns $end
$scope module chip $end
$var wire 1 ! en $end
$var wire 1 " err $end
$var wire 12 # addr [11:0] $end
$scope module core $end
$var reg 1 ! en_q $end
$var real 64 % volt $end
$var event 1 & tick $end
$var reg 70 ' wide $end
$upscope $end
$upscope $end
$enddefinitions $end
$comment not a tick
#5 $end
$dumpvars
1!
z"
b101 #
r2.250 %
$end
#3
0!
#8
0"
b11111111 #
#14
1!
1&
#21
b0 #
1"
#33
bx01 '
#47
0!
#60
1!
"""


@pytest.fixture(scope="module")
def wave(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vcd") / "t.vcd"
    path.write_text(VCD)
    return vcd_wave(spark, str(path))


def spans(found):
    return [(r.begin_ticks, r.end_ticks) for r in found.rows.collect()]


def test_vcd_splits_agree(spark, wave):
    whole = wave.changes.orderBy("seq").collect()
    path = wave.meta.first().path
    for split in (7, 50, 1000):
        assert vcd_wave(spark, path, split).changes.orderBy("seq").collect() == whole
    assert len(whole) == 14
    assert wave.changes.where("backend_sid = '#'").count() == 3


def test_info_and_list(wave):
    r = tables.info(wave).first()
    assert (r.signal_count, r.reference_count, r.t_min, r.t_max, r.scopes) == (6, 7, 0, 60, ["chip", "chip.core"])
    assert [x.path for x in tables.list_signals(wave, "EN_Q").collect()] == ["chip.core.en_q", "chip.en"]


def test_values(wave):
    got = {r.path: r.value for r in points.snapshot(wave, 40).collect()}
    assert got == {"chip.core.en_q": "1", "chip.err": "1", "chip.addr[11:0]": "0 (0x000)", "chip.core.volt": "2.25", "chip.core.tick": "triggered", "chip.core.wide": "b" + "x" * 68 + "01"}
    assert [(r.path, r.at_t1, r.at_t2) for r in points.compare(wave, 10, 30).collect()] == [("chip.addr[11:0]", "255 (0x0ff)", "0 (0x000)"), ("chip.core.en_q", "0", "1"), ("chip.core.tick", "(undef)", "triggered"), ("chip.err", "0", "1")]


@pytest.mark.parametrize("raw,width,text", [("0", 1, "0"), ("z", 1, "z"), ("00010001", 8, "17 (0x11)"), ("1", 3, "1 (0x1)"), ("10", 8, "2 (0x02)"), ("01x0", 4, "b01x0"), ("x0", 4, "bxxx0"), ("hl", 2, "2 (0x2)"), ("u", 1, "x"), ("1" * 64, 64, "18446744073709551615 (0xffffffffffffffff)"), ("111", 2, "bxx")])
def test_shown(spark, raw, width, text):
    df = spark.createDataFrame([(raw, width)], "raw string, width int")
    assert df.select(shown(F.col("raw"), F.lit("bits"), F.col("width"))).first()[0] == text


def test_search(wave):
    assert spans(search(wave, "chip.en=1")) == [(0, 3), (14, 47), (60, 60)]
    assert spans(search(wave, "en_q=1,err=1")) == [(21, 47), (60, 60)]
    assert spans(search(wave, "err!=0")) == [(21, 60)]
    assert spans(search(wave, "err=z")) == [(0, 8)]
    assert spans(search(wave, "addr=0xff")) == [(8, 21)]
    assert spans(search(wave, "addr=b000011111111")) == [(8, 21)]
    assert spans(search(wave, "en_q=1", begin=10, end=40)) == [(14, 40)]
    assert spans(search(wave, "en_q=1", begin=15, end=15)) == []
    seg = search(wave, "en_q=1", show="addr").rows.collect()
    assert [(r.begin_ticks, r.end_ticks, r["values"][0].value) for r in seg] == [(0, 3, "5 (0x005)"), (14, 21, "255 (0x0ff)"), (21, 47, "0 (0x000)"), (60, 60, "0 (0x000)")]
    assert [r.time_ticks for r in search(wave, "en_q=1", changed="addr").rows.collect()] == [21]
    assert [r.time_ticks for r in search(wave, "en_q=1", changed="core.tick").rows.collect()] == [14]
    for bad in ({"condition": "chip=1"}, {"condition": "nope=1"}, {"condition": "en_q=1", "show": "zz"}, {"condition": "en_q=1", "begin": 5, "end": 1}):
        with pytest.raises(WaveError):
            search(wave, **bad)


def test_summary(wave):
    rows = {r.path: r for r in points.summary(wave).collect()}
    r = rows["chip.core.en_q"]
    assert (r.kind, r.changes, r.rise_count, r.fall_count, r.init, r["last"], r.first_at, r.last_at, r.unique) == ("active", 4, 2, 2, "1", "1", 3, 60, 2)
    assert (rows["chip.core.volt"].kind, rows["chip.core.volt"].value, rows["chip.addr[11:0]"].rise_count) == ("static", "2.25", None)


@pytest.mark.parametrize("pattern", [None, "top.u1?.*", "zalias.error.u3"])
def test_buckets_change_nothing(spark, pattern):
    """Summary and as-of values in buckets of a few records equal those in one."""
    w = queries.events(spark, "/root/testdata/sf0.001")
    for args in ({}, {"t0": queries.T1, "t1": queries.T2}):
        assert points.summary(w, pattern=pattern, bucket=60, **args).collect() == points.summary(w, pattern=pattern, bucket=10**9, **args).collect()
    if pattern is None:
        at = w.changes.select("backend_sid", (F.col("tick") + F.col("seq") % 3 - 1).alias("tick"), "seq")
        assert sorted(points.asof(w, at.withColumnRenamed("seq", "n"), 60).collect()) == sorted(points.asof(w, at.withColumnRenamed("seq", "n"), 10**9).collect())


def test_selection_reaches_the_source(spark, tmp_path):
    """A filter on names is one on the scanned signals, below every aggregate and window."""
    vcd_like(spark).save(str(tmp_path / "w.parquet"))
    w = open_wave(spark, str(tmp_path / "w.parquet"))
    for df in (points.summary(w, pattern="t.a"), points.snapshot(w, 9, "t.a"), points.compare(w, 1, 9, "t.a"), tables.dump(w, 0, 9, "t.a"), search(w, "t.a=1").rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.split("\n") if "FileScan" in line and "raw" in line)
        assert "EqualTo(backend_sid,a)" in scan or "In(backend_sid, [a])" in scan, scan


def vcd_like(spark):
    changes = spark.range(20).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("a_raw_sid"), F.col("id").alias("tick"), F.col("id").alias("seq"), (F.col("id") % 3 % 2).cast("string").alias("raw")).withColumnRenamed("a_raw_sid", "backend_sid")
    decls = spark.createDataFrame([(i, f"t.{s}", "t", 1, "wire", "bits", s) for i, s in enumerate("ab")], DECLS)
    return Wave(spark.createDataFrame([("p", 1, "", 1.0, "", "", 0, 19)], META), decls, changes, 1.0)


def test_documents(wave):
    doc = json.loads(COMMANDS["search"](wave, 1, False, condition="en_q=1").run(True))
    assert (doc["mode"], doc["shown"], doc["truncated"], doc["total"], doc["total_is_exact"]) == ("interval", 1, True, 2, False)
    assert json.loads(COMMANDS["snapshot"](wave, None, False, at="5ns").run(True))["undefined"] == 2
    for name, args in (("info", {}), ("list", {}), ("dump", {"filter": "en"}), ("summary", {}), ("compare", {"at": "10,30"}), ("snapshot", {"at": "1"})):
        assert COMMANDS[name](wave, None, True, **args).run(False) and json.loads(COMMANDS[name](wave, 2, False, **args).run(True))


def test_documents_in_parts(wave):
    """All rows in pieces give the document that holds them at once."""
    for name, args in (("dump", {}), ("list", {}), ("summary", {}), ("snapshot", {"at": "9"}), ("compare", {"at": "1,30"}), ("search", {"condition": "en_q=1", "show": "addr"})):
        some, every = (json.loads(COMMANDS[name](wave, limit, False, **args).run(True)) for limit in (1000, 0))
        assert some == every and sum(1 for _ in COMMANDS[name](wave, 0, False, **args).parts(True)) > 10
        assert COMMANDS[name](wave, 1000, False, **args).run(False) == COMMANDS[name](wave, 0, False, **args).run(False)
    assert COMMANDS["dump"](wave, 0, False, begin="61").run(False) == "(no changes in range)"


def test_window_without_records(spark, tmp_path):
    """A signal that is set once and for all holds over any later window, but for one without width."""
    path = tmp_path / "once.vcd"
    path.write_text("$timescale 1ns $end\n$scope module z $end\n$var wire 1 ! on $end\n$upscope $end\n$enddefinitions $end\n#0\n1!\n")
    w = vcd_wave(spark, str(path))
    assert COMMANDS["search"](w, None, False, condition="on=1", begin="70ns", end="90ns").run(False) == "Found: 1 interval(s)\n  70ns        ..90ns         z.on=1"
    assert COMMANDS["search"](w, None, False, condition="on=1", begin="4", end="4").run(False).startswith("No interval in 4ns..4ns")


def test_hold(wave):
    held = wave.hold("chip.err")
    assert held.changes.is_cached and points.snapshot(held, 40, "chip.err").first().value == "1" and held.changes.count() == 3
    held.release()
    assert not held.changes.is_cached


def test_scans_do_not_change_each_other(wave):
    """A scan of some signals leaves later ones of all as they are."""
    assert wave.changes_in(["#"]).count() == 3 and wave.changes.count() == 14 and wave.changes.where("backend_sid = '!'").count() == 5
    both = wave.changes_in(["#"]).union(wave.changes_in(["!", '"'])).groupBy("backend_sid").count().collect()
    assert {r.backend_sid: r["count"] for r in both} == {"#": 3, "!": 5, '"': 3} and wave.changes.count() == 14


def test_open(spark, tmp_path, wave):
    assert main(["info", str(tmp_path / "no.vcd")], spark) == 1
    assert main(["info", str(tmp_path / "a.fst")], spark) == 1
    register("foo", lambda s, p: wave)
    assert open_wave(spark, "x.FOO") is wave
    unregister("foo")
    wave.save(str(tmp_path / "w.parquet"))
    assert spans(search(open_wave(spark, str(tmp_path / "w.parquet")), "en_q=1")) == [(0, 3), (14, 47), (60, 60)]


def naive(rows, cond, trigger, t0, t1):
    """Events and intervals of a one-tick-at-a-time replay. rows: (sid, tick, raw) in order; cond: {sid: value}."""
    ticks: dict[int, list] = {}
    for sid, tick, raw in rows:
        ticks.setdefault(tick, []).append((sid, raw))
    state, out, events, begun = {}, [], [], None
    holds = lambda: all(state.get(s) == v for s, v in cond.items())
    for tick in sorted(set(ticks) | {t0}):
        if tick > t1:
            break
        old = dict(state)
        for sid, raw in ticks.get(tick, ()):
            state[sid] = raw
        fired = any(s == trigger and s in old and raw != old[s] for s, raw in ticks.get(tick, ()))
        if tick >= t0 and fired and holds():
            events.append(tick)
        if tick >= t0:
            if holds() and begun is None:
                begun = tick
            elif not holds() and begun is not None:
                out.append((begun, tick))
                begun = None
    if begun is not None:
        out.append((begun, t1))
    return (out if t0 < t1 else []), events


@pytest.mark.parametrize("seed", range(4))
def test_search_against_replay(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(0, 40), i, rng.choice("ab"), rng.choice("01x")) for i in range(60))
    changes = spark.createDataFrame([(s, t, i, r) for t, i, s, r in rows], CHANGES)
    decls = spark.createDataFrame([(i, f"t.{s}", "t", 1, "wire", "bits", s) for i, s in enumerate("ab")], DECLS)
    w = Wave(spark.createDataFrame([("p", 0, "", 1.0, "", "", 0, 40)], META), decls, changes, 1.0)
    flat = [(s, t, r) for t, _, s, r in rows]
    for t0, t1 in ((0, 40), (7, 23), (9, 9)):
        want, fired = naive(flat, {"a": "1"}, "b", t0, t1)
        assert spans(search(w, "t.a=1", begin=t0, end=t1, bucket=5)) == want
        assert [r.time_ticks for r in search(w, "t.a=1", changed="t.b", begin=t0, end=t1, bucket=7).rows.collect()] == fired
