"""Signal name patterns as column predicates."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WaveError

MAX_BYTES, MAX_WILDCARDS = 256, 16
_PART = {"*": ".*", "?": "."}


def split_patterns(text: str | None) -> list[str]:
    """Comma-separated patterns, trimmed and checked; blanks are left out."""
    out = []
    for part in (text or "").split(","):
        if pattern := part.strip():
            out.append(check_pattern(pattern))
    return out


def check_pattern(pattern: str) -> str:
    """The pattern in lower case with runs of * made one."""
    if len(pattern.encode()) > MAX_BYTES:
        raise WaveError(f"filter pattern too long; max length is {MAX_BYTES}")
    pattern = re.sub(r"\*+", "*", pattern)
    if sum(pattern.count(w) for w in _PART) > MAX_WILDCARDS:
        raise WaveError(f"too many wildcard characters in filter pattern; max is {MAX_WILDCARDS}")
    return pattern.lower()


def is_glob(pattern: str) -> bool:
    return any(w in pattern for w in _PART)


def glob_regex(pattern: str) -> str:
    """Whole-string regex of a glob: * any run, ? one character, everything else itself."""
    return "(?s)^" + "".join(_PART.get(c) or re.sub(r"[^\w]", lambda m: "\\" + m[0], c) for c in pattern) + r"\z"


def matches(name: Column, patterns: list[str]) -> Column:
    """Does any pattern match the name, case aside?"""
    low = F.lower(name)
    return reduce(or_, (low.rlike(glob_regex(p)) if is_glob(p) else low.contains(p) for p in patterns))


def any_alias(aliases: Column, patterns: list[str]) -> Column:
    """Does any pattern match any alias? True for no patterns."""
    return F.exists(aliases, lambda a: matches(a, patterns)) if patterns else F.lit(True)
