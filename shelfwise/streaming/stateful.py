"""Structured Streaming forms: saving as you go, open price periods, dead-night counters, limits, refusals.

Each stateful function is plain Python over a key's rows in time order, so the batch form is the same function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed(df: DataFrame, key: str, order: str, output: str, state: str, step: Callable[[tuple | None, Any], tuple[tuple, tuple | None]], done: Callable[[tuple], Iterable[tuple]] | None = None) -> DataFrame:
    """A state machine per key: step(state, row) gives the new state and a row to emit, or None.

    Rows of a micro-batch are taken in time order within their key; state lives in Spark's state store.
    """
    names = [c.strip().split(" ")[0] for c in output.split(",")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples(index=False):
            now, emitted = step(now, row)
            if emitted is not None:
                out.append(emitted)
        held.update(now)
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def close_period(state: tuple | None, row: Any) -> tuple[tuple, tuple | None]:
    """Open price period (cents, first, last); emits the closed one when the cents change, null equal to null."""
    cents = None if pd.isna(row.cents) else int(row.cents)
    held = None if state is None else (None if state[0] is None or state[0] < 0 else state[0])
    if state is None:
        return (-1 if cents is None else cents, row.day, row.day), None
    if cents == held:
        return (state[0], state[1], max(state[2], row.day)), None
    return (-1 if cents is None else cents, row.day, row.day), (row.key, held, state[1], state[2])


def count_dead(limit: int = 3) -> Callable:
    """Consecutive dead sightings; emits the key when they reach the limit, a live sighting resets."""

    def step(state: tuple | None, row: Any) -> tuple[tuple, tuple | None]:
        n = (state[0] if state else 0) + 1 if row.dead else 0
        return (n,), ((row.key, n, row.at) if row.dead and n == limit else None)

    return step


def refusals(pauses: tuple[int, ...] = (20, 40, 60), stop: int = 80) -> Callable:
    """Refused requests in a row: pause at some counts, stop at the last; any answer resets."""

    def step(state: tuple | None, row: Any) -> tuple[tuple, tuple | None]:
        n = (state[0] if state else 0) + 1 if row.refused else 0
        act = "stop" if n >= stop else "pause" if n in pauses else None
        return (n,), ((row.key, n, act) if act else None)

    return step


def sliding_limit(most: int = 5, seconds: int = 3600) -> Callable:
    """Admits an event if fewer than `most` were admitted in the seconds before; state is the admitted times as text."""

    def step(state: tuple | None, row: Any) -> tuple[tuple, tuple | None]:
        recent = [t for t in map(int, filter(None, (state[0] if state else "").split(","))) if t > row.second - seconds]
        ok = len(recent) < most
        return (",".join(map(str, recent + [row.second] * ok)),), (row.key, row.second, ok)

    return step


def save_batches(df: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Save each micro-batch with its id, which makes a repeated batch recognisable."""
    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """Events of a key in each hour, late ones up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), key).count()


def replay(rows: Iterable[Any], step: Callable) -> tuple[tuple | None, list[tuple]]:
    """The batch form: one key's rows, in order, through a step function."""
    state, out = None, []
    for row in rows:
        state, emitted = step(state, row)
        if emitted is not None:
            out.append(emitted)
    return state, out
