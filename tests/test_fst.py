"""FST files written here, block by block, and read back."""

import gzip
import random
import struct
import zlib

import pyarrow as pa
import pytest

from edgeframe.cli import main
from edgeframe.errors import WaveError
from edgeframe.operators import points, tables
from edgeframe.operators.search import search
from edgeframe.sources import fst
from edgeframe.sources.registry import open_wave


def vi(n):
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def svi(n):
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n & 127)
    return bytes(out)


def block(kind, body):
    return struct.pack(">BQ", kind, len(body) + 8) + body


def lz4(data):
    return pa.compress(data, "lz4_raw", asbytes=True)


def header(exponent=-9, start=0, end=0):
    return block(0, struct.pack(">QQd", start, end, 2.718281828459045) + struct.pack(">QQQQQ", 0, 0, 0, 0, 0) + struct.pack(">b", exponent) + b"sim 1".ljust(128, b"\0") + b"today".ljust(119, b"\0") + b"\0" + struct.pack(">q", 0))


#: name, type number, bits in the geometry, declared bits; None: alias of the first signal
SIGNALS = [("go", 16, 1, 1), ("bus [11:0]", 5, 12, 12), ("temp", 3, 0, 64), ("note", 21, 0xFFFFFFFF, 0), ("hit", 0, 1, 1), ("wide", 5, 70, 70), ("still", 16, 1, 1), ("again", 5, 12, 12)]


def hierarchy(kind):
    data = bytes([254, 0]) + b"top\0\0"
    for name, number, _, bits in SIGNALS[:4]:
        data += bytes([number, 0]) + name.encode() + b"\0" + vi(bits) + vi(0)
    data += bytes([252, 0, 1]) + b"src\0" + vi(300) + bytes([253, 254, 0]) + b"sub\0x\0" + bytes([16, 0]) + b"go_alias\0" + vi(1) + vi(1)
    for name, number, _, bits in SIGNALS[4:]:
        data += bytes([number, 0]) + name.encode() + b"\0" + vi(bits) + vi(0)
    data += bytes([255, 255])
    if kind == 4:
        return block(4, struct.pack(">Q", len(data)) + gzip.compress(data))
    if kind == 6:
        return block(6, struct.pack(">Q", len(data)) + lz4(data))
    once = lz4(data)
    return block(7, struct.pack(">QQ", len(data), len(once)) + lz4(once))


def geometry(packed):
    data = b"".join(vi(bits) for _, _, bits, _ in SIGNALS)
    body = zlib.compress(data) if packed else data
    return block(3, struct.pack(">QQ", len(data), len(SIGNALS)) + (body if len(body) != len(data) else data))


def literals(data):
    """A FastLZ buffer of literal runs, with one copy where the data allow it."""
    out, at = bytearray(), 0
    while at < len(data):
        n = min(32, len(data) - at)
        out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out)


def changes(kind, pack, begin, times, frame, chains, packed=True):
    """chains: for each signal its (tick, value) records, or the number of an earlier signal with the same."""
    places, data = [], b""
    for (_, _, bits, _), records in zip(SIGNALS, chains, strict=True):
        if isinstance(records, int) or not records:
            places.append(records if isinstance(records, int) else None)
            continue
        raw, before = b"", 0
        for tick, value in records:
            step = times.index(tick) - before
            before = times.index(tick)
            if bits == 1:
                raw += vi(step << 2 | int(value) << 1) if value in "01" else vi(step << 4 | fst.STATES.index(value) << 1 | 1)
            elif bits == 0:
                raw += vi(step << 1 | 1) + struct.pack("<d", float(value))
            elif bits == 0xFFFFFFFF:
                raw += vi(step << 1) + vi(len(value)) + value.encode()
            elif set(value) <= set("01"):
                raw += vi(step << 1) + int(value.ljust(-(-bits // 8) * 8, "0"), 2).to_bytes(-(-bits // 8), "big")
            else:
                raw += vi(step << 1 | 1) + value.encode()
        stored = {"Z": zlib.compress, "4": lz4, "F": literals}[pack](raw) if packed else raw
        places.append((len(data) + 1,))
        data += (vi(len(raw)) if packed else vi(0)) + stored
    index, now, gap, held = b"", 0, 0, None
    for p in [*places, (len(data) + 1,)][:-1]:
        if p is None:
            gap += 1
            continue
        if gap:
            index += vi(gap << 1)
            gap = 0
        if isinstance(p, tuple):
            index += svi((p[0] - now) << 1 | 1) if kind == 8 else vi((p[0] - now) << 1 | 1)
            now = p[0]
        elif kind == 8:
            index += svi(1) if held == p else svi((-p - 1) << 1 | 1)
            held = p
        else:
            index += vi(0) + vi(p + 1)
    if gap:
        index += vi(gap << 1)
    steps = b"".join(vi(b - a) for a, b in zip([0, *times], times, strict=False))
    t = zlib.compress(steps) if packed else steps
    t = t if len(t) != len(steps) else steps
    fr = zlib.compress(frame) if packed else frame
    body = struct.pack(">QQQ", begin, times[-1], 0) + vi(len(frame)) + vi(len(fr)) + vi(len(SIGNALS)) + fr + vi(len(SIGNALS)) + pack.encode() + data
    return block(kind, body + index + struct.pack(">Q", len(index)) + t + struct.pack(">QQQ", len(steps), len(t), len(times)))


FRAME = b"x" + b"x" * 12 + struct.pack("<d", 0.5) + b"x" + b"0" * 70 + b"1" + b"z" * 12
FIRST = [[(0, "0"), (5, "1"), (9, "x")], [(0, "000000000101"), (9, "0000xx000000")], [(5, "2.25")], [(0, "idle"), (9, "run")], [(5, "1"), (9, "1")], [(9, "1" * 70)], [], 1]
SECOND = [[(12, "0"), (20, "1")], [(20, "111111111111")], [(12, "10"), (20, "-0.125")], [], [(20, "1")], [(12, "x" * 70)], [(20, "0")], 1]


def write(path, kind=8, pack="Z", tree=4, packed=True):
    path.write_bytes(header(end=20) + geometry(packed) + changes(kind, pack, 0, [0, 5, 9], FRAME, FIRST, packed) + block(255, b"skipped") + changes(kind, pack, 9, [12, 20], FRAME, SECOND, packed) + hierarchy(tree))
    return str(path)


def expected():
    out = {str(i + 1): [] for i in range(len(SIGNALS))}
    start = ["x", "x" * 12, "0.5", None, None, "0" * 70, "1", "z" * 12]
    for i, first in enumerate(start):
        if first is not None:
            out[str(i + 1)].append((0, first))
    for part in (FIRST, SECOND):
        for i, records in enumerate(part):
            out[str(i + 1)] += [(t, "" if i == 4 else v) for t, v in (part[records] if isinstance(records, int) else records)]
    return out


@pytest.mark.parametrize("kind,pack,tree,packed", [(8, "Z", 4, True), (5, "4", 6, True), (8, "F", 7, True), (5, "Z", 4, False)])
def test_read(spark, tmp_path, kind, pack, tree, packed):
    path = write(tmp_path / "a.fst", kind, pack, tree, packed)
    for signals in (3, 4096):
        got = {}
        for r in fst.fst_wave(spark, path, signals).changes.orderBy("backend_sid", "tick", "seq").collect():
            got.setdefault(r.backend_sid, []).append((r.tick, r.raw))
        assert got == {k: v for k, v in expected().items() if v}


def test_wave(spark, tmp_path, capsys):
    path = write(tmp_path / "a.fst")
    w = open_wave(spark, path)
    r = tables.info(w).first()
    assert (r.signal_count, r.reference_count, r.t_min, r.t_max, r.timescale, r.version, r.date, r.scopes) == (8, 9, 0, 20, "1ns", "sim 1", "today", ["top", "top.sub"])
    assert [x.path for x in tables.list_signals(w, "go").collect()] == ["top.go", "top.sub.go_alias"]
    got = {r.path: r.value for r in points.snapshot(w, 12).collect()}
    assert got["top.bus[11:0]"] == "b0000xx000000" and got["top.temp"] == "10" and got["top.note"] == "run" and got["top.sub.hit"] == "triggered" and got["top.sub.still"] == "1"
    assert [(r.begin_ticks, r.end_ticks) for r in search(w, "top.go=1").rows.collect()] == [(5, 9), (20, 20)]
    assert [r.time_ticks for r in search(w, "top.go!=0", changed="hit").rows.collect()] == [5, 20]
    assert main(["info", path], spark) == 0 and "8 unique (9 $var refs via aliases)" in capsys.readouterr().out
    assert w.changes_in(["2"]).count() == 4 and w.changes.count() == sum(map(len, expected().values()))


def test_broken_files(spark, tmp_path):
    path = tmp_path / "a.fst"
    whole = open(write(path), "rb").read()
    for raw in (b"", b"\0", whole[:100], b"\xfe" + whole[1:]):
        path.write_bytes(raw)
        with pytest.raises(WaveError, match="failed to read waveform"):
            open_wave(spark, str(path))
    assert main(["info", str(path)], spark) == 1
    path.write_bytes(whole + b"\x08\0\0\0\0\0\x0f\0\0abc")  # a block that the simulator did not finish
    assert open_wave(spark, str(path)).changes.count() == sum(map(len, expected().values()))


def test_numbers():
    rng = random.Random(1)
    some = [rng.randrange(1 << rng.randrange(1, 50)) for _ in range(500)]
    assert fst.varints(b"".join(map(vi, some))).tolist() == some and len(fst.varints(b"")) == 0
    for n in (0, 1, -1, 63, 64, -64, -65, 12345, -99999):
        assert fst.signed_varint(svi(n), 0) == (n, len(svi(n)))
    assert fst.timescale(-10) == (1e-10, "100ps") and fst.timescale(0) == (1.0, "1s") and fst.timescale(-9) == (1e-9, "1ns")


def test_fastlz():
    assert fst.fastlz(literals(b"abc" * 40), 120) == b"abc" * 40
    assert fst.fastlz(bytes([2]) + b"abc" + bytes([(1 + 4) << 5 | 0, 2]), 3 + 4 + 3) == b"abcabcabca"[:10]  # a copy of 7 at distance 3
    long = bytes([0]) + b"a" + bytes([7 << 5, 200, 0])
    assert fst.fastlz(long, 1 + 209) == b"a" * 210
    level2 = bytes([1 << 5 | 0]) + b"a" + bytes([7 << 5, 255, 10, 0])
    assert fst.fastlz(level2, 1 + 274) == b"a" * 275
    with pytest.raises(WaveError):
        fst.fastlz(bytes([0]) + b"a" + bytes([1 << 5, 9]), 10)
