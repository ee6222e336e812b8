"""Tables that are no waveform files, seen as waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wave import Wave

EPOCH = 1704067200000000


def events_wave(events: DataFrame, coarse: int = 1) -> Wave:
    """``events`` as a wave: 16 users x event types, ticks of ``coarse`` microseconds since 2024.

    error and signup are one bit wide, the others eight; every 17th record is unknown and, of the
    wide ones, every 19th undriven. Each signal has an alias under the scope ``alias``.
    """
    user, kind, i = F.col("user_id") % 16, F.col("event_type"), F.col("event_id")
    path = F.concat(F.lit("top.u"), user.cast("string"), F.lit("."), kind)
    bit = kind.isin("error", "signup")
    number = F.floor("value").cast("long") % 256
    raw = F.when(bit, F.when(i % 17 == 0, "x").otherwise(F.when(F.col("value") > 20, "1").otherwise("0"))).otherwise(F.when(i % 17 == 0, "x" * 8).when(i % 19 == 0, "z" * 8).otherwise(F.lpad(F.bin(number), 8, "0")))
    tick = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / coarse)
    changes = events.select(path.alias("backend_sid"), tick.alias("tick"), i.alias("seq"), raw.alias("raw"))
    keys = events.select(path.alias("backend_sid"), kind.alias("name"), user.alias("user"), F.when(bit, 1).otherwise(8).alias("width")).distinct()
    place = (F.ascii("name") * 1000 + F.length("name") * 100 + F.col("user")).cast("long")
    common = [F.lit("wire").alias("type"), F.lit("bits").alias("kind"), "backend_sid"]
    decls = keys.select(place.alias("decl_idx"), F.col("backend_sid").alias("full_path"), F.concat(F.lit("top.u"), F.col("user").cast("string")).alias("scope_path"), "width", *common)
    alias = keys.select((place + 1_000_000).alias("decl_idx"), F.concat(F.lit("zalias."), F.col("name"), F.lit(".u"), F.col("user").cast("string")).alias("full_path"), F.concat(F.lit("zalias."), F.col("name")).alias("scope_path"), "width", F.lit("reg").alias("type"), F.lit("bits").alias("kind"), "backend_sid")
    meta = changes.agg(F.min("tick").alias("t_min"), F.max("tick").alias("t_max")).select(F.lit("events").alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.lit("1us").alias("timescale"), F.lit(1e-6 * coarse).alias("ts_sec"), F.lit("").alias("date"), F.lit("").alias("version"), "t_min", "t_max")
    return Wave(meta, decls.unionByName(alias), changes, 1e-6 * coarse)


def orders_wave(orders: DataFrame) -> Wave:
    """``orders`` as a wave of text signals: one of 32 customer groups, a tick a day, the order's status."""
    path = F.concat(F.lit("shop.c"), (F.col("o_custkey") % 32).cast("string"))
    changes = orders.select(path.alias("backend_sid"), F.floor((F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86_400_000_000).alias("tick"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("raw"))
    keys = orders.select(path.alias("backend_sid"), (F.col("o_custkey") % 32).cast("long").alias("decl_idx")).distinct()
    decls = keys.select("decl_idx", F.col("backend_sid").alias("full_path"), F.lit("shop").alias("scope_path"), F.lit(1).alias("width"), F.lit("string").alias("type"), F.lit("str").alias("kind"), "backend_sid")
    meta = changes.agg(F.min("tick").alias("t_min"), F.max("tick").alias("t_max")).select(F.lit("orders").alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.lit("86400s").alias("timescale"), F.lit(86400.0).alias("ts_sec"), F.lit("").alias("date"), F.lit("").alias("version"), "t_min", "t_max")
    return Wave(meta, decls, changes, 86400.0)


#: States of a two-bit signal of the mixed wave, by event.
NINE = "01hluwxz-"


def mixed_wave(events: DataFrame) -> Wave:
    """``events`` as signals of all kinds: two of each event type, ticks of milliseconds since 2024.

    click is a real (every third record a whole number), view of even users an event, of odd ones a
    text; error has four bits that are written short, signup two bits in nine states and now and then
    three characters, purchase 72 bits.
    """
    kind, i, v = F.col("event_type"), F.col("event_id"), F.col("value")
    user = F.col("user_id") % 2
    path = F.concat(F.lit("mix.m"), user.cast("string"), F.lit("."), kind)
    whole = F.floor(v).cast("long")
    real = F.when(i % 3 == 0, whole.cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", ""))
    state = lambda n: F.substring(F.lit(NINE), (n % 9 + 1).cast("int"), F.lit(1))
    nine = F.concat(state(i), state(F.floor(i / 9)), F.when(i % 23 == 0, "1").otherwise(""))
    short = F.when(i % 13 == 0, "x").when(i % 11 == 0, "z").when(i % 7 == 0, "1x").otherwise(F.bin(whole % 16))
    wide = F.when(i % 29 == 0, "x1").otherwise(F.concat(F.lit("1"), F.lpad(F.bin(whole), 71, "0")))
    raw = F.when(kind == "click", real).when((kind == "view") & (user == 0), "").when(kind == "view", F.translate("props", " ", "")).when(kind == "error", short).when(kind == "signup", nine).otherwise(wide)
    tick = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / 1000)
    changes = events.select(path.alias("backend_sid"), tick.alias("tick"), i.alias("seq"), raw.alias("raw"))
    keys = events.select(path.alias("backend_sid"), kind.alias("name"), user.alias("user")).distinct()
    name = F.col("name")
    shape = F.when(name == "click", F.lit("real")).when(name == "view", F.when(F.col("user") == 0, "event").otherwise("str")).otherwise("bits")
    type_ = F.when(name == "view", F.when(F.col("user") == 0, "event").otherwise("string")).when(name == "click", "real").otherwise("reg")
    width = F.when(name == "error", 4).when(name == "signup", 2).when(name == "purchase", 72).otherwise(1)
    decls = keys.select((F.ascii("name") * 1000 + F.length("name") * 10 + F.col("user")).cast("long").alias("decl_idx"), F.col("backend_sid").alias("full_path"), F.concat(F.lit("mix.m"), F.col("user").cast("string")).alias("scope_path"), width.alias("width"), type_.alias("type"), shape.alias("kind"), "backend_sid")
    meta = changes.agg(F.min("tick").alias("t_min"), F.max("tick").alias("t_max")).select(F.lit("mixed").alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.lit("1ms").alias("timescale"), F.lit(1e-3).alias("ts_sec"), F.lit("").alias("date"), F.lit("").alias("version"), "t_min", "t_max")
    return Wave(meta, decls, changes, 1e-3)
