"""Search conditions: an AND-list of ``SIGNAL op VALUE``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WaveError
from .values import equals_number, equals_pattern, is_known, is_logic

#: Most bits, hexadecimal and decimal digits of a target.
MAX_WIDTH, MAX_HEX, MAX_DIGITS = 65536, 16384, 100


@dataclass(frozen=True)
class Target:
    """A number, or four-state text."""

    text: str
    number: int | None = None


@dataclass(frozen=True)
class Form:
    """One way to write a target: what it starts with, its digits, how many there may be, and the messages."""

    start: str
    digits: str
    most: int
    base: int | None
    none: str
    many: str
    other: str


#: The messages. The first form that a text starts like is the one that it must follow.
FORMS = (
    Form("0x", "0-9a-f", MAX_HEX, 16, "hex target must contain at least one digit", "hex target too wide; max hex digits is {most}", "invalid hex target {text!r}; x/z literals must use binary form like b1x0z"),
    Form("0?b", "01xz", MAX_WIDTH, 2, "binary target must contain at least one bit", "binary target too wide; max bits is {most}", "invalid binary target {text!r}; expected only 0/1/x/z"),
    Form("(?=[0-9]+$)", "0-9", MAX_DIGITS, 10, "", "decimal target too long; max digits is {most}", ""),
    Form("", "01xz", MAX_WIDTH, None, "", "literal target too wide; max characters is {most}", "invalid target {text!r}; expected decimal, 0x.., b.., or 0/1/x/z literal"),
)
#: What no target may start with.
REFUSED = {"-": "negative target values are not supported for waveform matching", "+": "signed target values are not supported; write unsigned values"}


def parse_target(text: str) -> Target:
    """Decimal, 0x hexadecimal, b or 0b binary, or bare four-state text."""
    low = text.strip().lower()
    if not low:
        raise WaveError("target value must not be empty")
    if len(low.encode()) > MAX_WIDTH + 2:
        raise WaveError(f"target value too long; max length is {MAX_WIDTH + 2}")
    if low[0] in REFUSED:
        raise WaveError(REFUSED[low[0]])
    form, body = next((f, low[m.end() :]) for f in FORMS if (m := re.match(f.start, low)))
    for wrong, message in ((not body, form.none), (len(body.encode()) > form.most, form.many), (not re.fullmatch(f"[{form.digits}]*", body), form.other)):
        if wrong:
            raise WaveError(message.format(most=form.most, text=text))
    number = int(body, form.base) if form.base and not set(body) & set("xz") else None
    return Target(body if form.base == 2 else low, number)


@dataclass(frozen=True)
class Term:
    pattern: str
    op: str
    target: Target
    typed: str
    value: str

    def holds(self, raw: Column, width: int) -> Column:
        """Never null: an undefined value satisfies nothing, an unknown one no inequality."""
        w = F.lit(width)
        same = equals_number(raw, self.target.number) if self.target.number is not None else equals_pattern(raw, self.target.text, w)
        if self.op != "!=":
            return same
        return F.coalesce(~same & ~(is_logic(raw) & ~is_known(raw)), F.lit(False))


def parse_conditions(text: str | None) -> list[Term]:
    if not (text or "").strip():
        raise WaveError("search requires --condition")
    terms = []
    for item in filter(None, map(str.strip, text.split(","))):
        op = next((o for o in ("!=", "==", "=") if o in item), None)
        if op is None:
            raise WaveError(f"invalid condition {item!r}; expected SIG=VAL, SIG==VAL, or SIG!=VAL")
        signal, value = (x.strip() for x in item.split(op, 1))
        if not (signal and value):
            raise WaveError(f"invalid empty signal/value in condition {item!r}")
        terms.append(Term(signal, op, parse_target(value), item, value))
    if not terms:
        raise WaveError("search requires at least one condition")
    return terms
