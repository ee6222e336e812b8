import pytest

from edgeframe import cli
from edgeframe.errors import UsageError, WaveError
from edgeframe.functions.conditions import parse_conditions, parse_target
from edgeframe.functions.names import check_pattern, glob_regex, split_patterns
from edgeframe.functions.times import fmt_time, parse_time, real_text


@pytest.mark.parametrize("text,ticks", [("0", 0), ("100", 100), ("1_000", 1000), ("100ns", 100), ("1us", 1000), ("17.5us", 17500), (".5ns", 0), ("1.5ns", 2), ("2.5ns", 2), ("-0", 0), ("9223372036854775807", 2**63 - 1)])
def test_parse_time(text, ticks):
    assert parse_time(text, 1e-9) == ticks


@pytest.mark.parametrize("text,part", [("10.5", "bare numeric"), ("5 ns", "invalid time"), ("-5", "non-negative"), ("1__0", "invalid"), ("_1", "invalid"), ("1_000ns", "invalid"), ("abc", "invalid"), ("9223372036854775808", "too large"), ("9223372036854775808.0ns", "too large"), ("1" * 101, "too long")])
def test_parse_time_errors(text, part):
    with pytest.raises(WaveError, match=part):
        parse_time(text, 1e-9)


def test_unit_needs_timescale():
    with pytest.raises(WaveError, match="timescale is 0"):
        parse_time("1ns", 0.0)


@pytest.mark.parametrize("ticks,text", [(0, "0s"), (5, "5ns"), (1000, "1us"), (17534700, "17.5347ms"), (100, "100ns")])
def test_fmt_time(ticks, text):
    assert fmt_time(ticks, 1e-9) == text


@pytest.mark.parametrize("value,text", [(24.0, "24"), (25.5, "25.5"), (1e21, "1000000000000000000000"), (1e-7, "0.0000001"), (-0.0, "-0")])
def test_real_text(value, text):
    assert real_text(value) == text


@pytest.mark.parametrize("text,number", [("5", 5), ("0xFF", 255), ("b1010", 10), ("0b11", 3), ("1x0", None), ("x", None), ("b1x0z", None)])
def test_targets(text, number):
    assert parse_target(text).number == number


@pytest.mark.parametrize("text,part", [("", "empty"), ("-1", "negative"), ("+1", "signed"), ("0x", "at least one digit"), ("0xg", "invalid hex"), ("b", "at least one bit"), ("b2", "invalid binary"), ("1" * 101, "too long"), ("foo", "invalid target")])
def test_target_errors(text, part):
    with pytest.raises(WaveError, match=part):
        parse_target(text)


def test_conditions():
    terms = parse_conditions("a=1, b==0x2 ,c!=x,,")
    assert [(t.pattern, t.op, t.value) for t in terms] == [("a", "=", "1"), ("b", "==", "0x2"), ("c", "!=", "x")]
    for bad in ("", " , ", "a", "=1", "a="):
        with pytest.raises(WaveError):
            parse_conditions(bad)


def test_patterns():
    import re

    assert split_patterns(" Clk , ,a**b") == ["clk", "a*b"]
    rx = glob_regex("top.*[3]?").replace(r"\z", r"\Z")
    assert re.match(rx, "top.x[3]y") and not re.match(rx, "topax[3]y") and not re.match(rx, "top.x[3]")
    for bad in ("x" * 257, "?" * 17):
        with pytest.raises(WaveError):
            check_pattern(bad)


def test_cli():
    r = cli.parse(["--json", "dump", "f.vcd", "--limit", "5", "--begin", "1ns", "--verbose"])
    assert (r.command, r.file, r.json, r.verbose, r.limit, r.options) == ("dump", "f.vcd", True, True, 5, {"begin": "1ns"})
    assert isinstance(cli.parse([]), str) and isinstance(cli.parse(["dump", "--help"]), str)
    for bad in (["nope"], ["info"], ["info", "a", "b"], ["snapshot", "a"], ["search", "a"], ["info", "a", "--limit", "-1"], ["info", "a", "--limit", "x"], ["info", "a", "--filter"], ["info", "a", "--what"]):
        with pytest.raises(UsageError):
            cli.parse(bad)
    assert cli.main(["nope"]) == 2
