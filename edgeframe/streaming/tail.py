"""Value changes that keep arriving: edges and last values with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "backend_sid string, tick long, old string, new string"


def _edges(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["tick", "seq"])
    old = rows.raw.shift(1)
    if len(old):
        old.iloc[0] = last
    moved = rows[old.notna() & (old != rows.raw)]
    if len(rows):
        state.update((rows.raw.iloc[-1],))
    yield pd.DataFrame({"backend_sid": key[0], "tick": moved.tick, "old": old[moved.index], "new": moved.raw})


def value_edges(changes: DataFrame) -> DataFrame:
    """backend_sid, tick, old, new of each change to another value, per signal.

    changes: a stream of (backend_sid, tick, seq, raw) in order of tick per signal over batches. The
    state is one text per signal.
    """
    return changes.groupBy("backend_sid").applyInPandasWithState(_edges, EDGES, "raw string", "append", GroupStateTimeout.NoTimeout)
