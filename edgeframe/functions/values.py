"""Value expressions: four-state text in, display text and predicates out; all in the JVM up to 64 bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNDEF = "(undef)"
WIDEST_NATIVE = 64


def four_state(raw: Column) -> Column:
    """0, 1, x and z for the nine states: h is 1, l is 0, the rest unknown."""
    return F.regexp_replace(F.translate(F.lower(raw), "hluw-", "10xxx"), "[^01xz]", "x")


def widened(bits: Column, width: Column) -> Column:
    """Bits extended to the left: x and z repeat, other values get zeros."""
    head = F.substring(bits, 1, 1)
    return F.when(F.length(bits) >= width, bits).otherwise(F.lpad(bits, width, F.when(head.isin("x", "z"), head).otherwise(F.lit("0"))))


@F.pandas_udf(StringType())
def _wide_number(bits: pd.Series) -> pd.Series:
    """Decimal and hexadecimal of bit strings of any length."""
    return bits.map(lambda b: None if b is None else f"{int(b, 2)} (0x{int(b, 2):0{-(-len(b) // 4)}x})")


def extended(raw: Column, width: Column) -> Column:
    """The four states of a value at its full width; all unknown where the text is longer.

    Built from the raw text in one place, so that the states are worked out once wherever this is used.
    """
    head = F.lower(F.substring(raw, 1, 1))
    pad = F.when(head == "z", F.lit("z")).when(head.isin("0", "1", "h", "l", ""), F.lit("0")).otherwise(F.lit("x"))
    return F.when(F.length(raw) > width, F.repeat(F.lit("x"), width)).otherwise(F.concat(F.repeat(pad, width - F.length(raw)), four_state(raw)))


def shown(raw: Column, kind: Column, width: Column, wide: bool = False) -> Column:
    """Display text. wide: signals of more than 64 bits occur; only then is Python in the plan."""
    full = extended(raw, width)
    unknown = (F.length(raw) > width) | raw.rlike("[^01hlHL]")
    small = full if not wide else F.when(width <= WIDEST_NATIVE, full)
    number = F.concat(F.conv(small, 2, 10), F.lit(" (0x"), F.lpad(F.lower(F.conv(small, 2, 16)), F.ceil(width / 4).cast("int"), F.lit("0")), F.lit(")"))
    if wide:
        number = F.when(width <= WIDEST_NATIVE, number).otherwise(_wide_number(F.when((kind == "bits") & (width > WIDEST_NATIVE) & ~unknown, full)))
    logic = F.when(width == 1, F.when(F.length(raw) > 1, F.lit("x")).otherwise(four_state(raw))).when(unknown, F.concat(F.lit("b"), full)).otherwise(number)
    return F.when(raw.isNull(), F.lit(None)).when(kind == "event", F.lit("triggered")).when(kind == "bits", logic).otherwise(raw)


def canonical(raw: Column, kind: str, width: int) -> Column:
    """One text for all values of a signal that are shown alike; it is shown like any of them."""
    if kind == "event":
        return F.when(raw.isNotNull(), F.lit(""))
    if kind != "bits":
        return raw
    return extended(raw, F.lit(width))


def shown_canonical(text: Column, kind: str, width: int) -> Column:
    """Display text of a :func:`canonical` value."""
    if kind == "event":
        return F.when(text.isNotNull(), F.lit("triggered"))
    if kind != "bits" or width == 1:
        return text
    unknown = text.rlike("[xz]")
    if width > WIDEST_NATIVE:
        number = _wide_number(F.when(~unknown, text))
    else:
        number = F.concat(F.conv(text, 2, 10), F.lit(" (0x"), F.lpad(F.lower(F.conv(text, 2, 16)), -(-width // 4), "0"), F.lit(")"))
    return F.when(unknown, F.concat(F.lit("b"), text)).otherwise(number)


def is_logic(raw: Column) -> Column:
    """Is the text logic? Decided by the text alone: the real 10 counts as the bits 10."""
    return raw.rlike("(?i)^[01xzhluw-]+$")


def is_known(raw: Column) -> Column:
    return raw.rlike("(?i)^[01hl]+$")


def equals_number(raw: Column, number: int) -> Column:
    digits = f"{number:b}" if number else ""
    return F.coalesce(is_known(raw) & (F.regexp_replace(four_state(raw), "^0+", "") == digits), F.lit(False))


def equals_pattern(raw: Column, pattern: str, width: Column) -> Column:
    as_bits = (F.lit(len(pattern)) <= width) & (widened(four_state(raw), width) == widened(F.lit(pattern), width))
    return F.coalesce(F.when(is_logic(raw), as_bits).otherwise(raw == pattern), F.lit(False))
