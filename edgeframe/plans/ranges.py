"""Deterministic ranges of an integer column with about equally many rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COARSE = 256


@dataclass
class Ranges:
    """``column`` grows with the value it was made from; at most ``n`` different values."""

    column: Column
    n: int


def ranges(df: DataFrame, name: str, rows: int) -> Ranges:
    """Ranges of column ``name`` with about ``rows`` rows each; null comes first.

    Up to 256 quantiles cut the column; beyond that each quantile is cut into steps of equal width.
    One aggregation; the result depends on the data alone, so it is the same in every job and after a
    lost task.
    """
    column = F.col(name).cast("long")
    spots = [i / COARSE for i in range(COARSE + 1)]
    total, every = df.agg(F.count("*"), F.percentile_approx(column, spots, 20_000)).first()
    coarse = 1
    while coarse < min(COARSE, -(-total // rows)):
        coarse *= 2
    fine = max(1, -(-total // (rows * coarse)))
    if coarse == 1 or not every:
        return Ranges(F.lit(0).cast("long"), 1)
    cuts = every[:: COARSE // coarse]
    edges = [cuts[0], *sorted(set(cuts[1:-1])), cuts[-1] + 1]

    def pick(a: int, b: int) -> Column:
        """The range of a value between edges[a] and edges[b]."""
        if b - a == 1:
            width = max(1, -(-(edges[b] - edges[a]) // fine))
            step = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((column - edges[a]) / width))) if fine > 1 else F.lit(0)
            return (F.lit(a * fine) + step).cast("long")
        m = (a + b) // 2
        return F.when(column < edges[m], pick(a, m)).otherwise(pick(m, b))

    return Ranges(F.when(column.isNull(), F.lit(0).cast("long")).otherwise(pick(0, len(edges) - 1)), (len(edges) - 1) * fine)
