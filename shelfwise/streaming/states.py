"""State machines on streams: price periods under late rows, limits with a daily reset, refusals in a row.

Each processor keeps its state in Spark's state store (a provider with column families, such as RocksDB's, is needed)
and hands a key's rows, in time order, to a plain function, so that the rule can be read and tested without a stream.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as __) that a query takes with it when it starts; put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def extend_periods(period: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple | None]:
    """Sightings (day, cents, available) in order, added to the open period; (periods that ended, the open one).

    A period is (number, cents, available, first day, last day, sightings). Null cents equal null cents.
    """
    ended = []
    for day, cents, available in rows:
        if period is not None and (period[1], period[2]) == (cents, available):
            period = (*period[:4], day, period[5] + 1)
        else:
            if period is not None:
                ended.append(period)
            period = (1 if period is None else period[0] + 1, cents, available, day, day, 1)
    return ended, period


SIGHTINGS = pa.schema([("store", pa.string()), ("product", pa.int64()), ("at", pa.int64()), ("ord", pa.string()), ("cents", pa.int64()), ("available", pa.bool_())])
OPEN = pa.schema([("store", pa.string()), ("product", pa.int64()), ("period", pa.int64()), ("cents", pa.int64()), ("available", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])
#: Rows of a value in the state store.
BLOCK = 10_000


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    """A table as state rows of one binary value: Arrow blocks."""
    out = []
    for block in table.to_batches(max_chunksize=BLOCK):
        with pa.ipc.new_stream(buffer := pa.BufferOutputStream(), table.schema) as writer:
            writer.write_batch(block)
        out.append((buffer.getvalue().to_pybytes(),))
    return out


def _unpacked(values: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(v).read_all() for (v,) in values)])


def _differs(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns, null equal to null; the first one does."""
    out = np.ones(table.num_rows, bool)
    out[1:] = False
    for name in names:
        c = table[name].combine_chunks()
        now, before = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        unequal = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
        out[1:] |= unequal.to_numpy(zero_copy_only=False)
    return out


def extend_all_periods(held: pa.Table, ready: pa.Table) -> tuple[pa.Table, pa.Table]:
    """extend_periods() for all listings of a shard at once: (periods that ended or changed, with is_open; all open periods).

    held: the open periods (OPEN), one a listing; ready: sightings (SIGHTINGS) later than those. A held period stands
    before its listing's sightings as a row of its own.
    """
    n, m = held.num_rows, ready.num_rows
    both = pa.table({
        "store": pa.chunked_array([*held["store"].chunks, *ready["store"].chunks], pa.string()), "product": pa.chunked_array([*held["product"].chunks, *ready["product"].chunks], pa.int64()),
        "new": np.repeat([0, 1], [n, m]), "at": pa.chunked_array([*held["last"].chunks, *ready["at"].chunks], pa.int64()), "ord": pa.chunked_array([pa.nulls(n, pa.string()), *ready["ord"].chunks], pa.string()),
        "cents": pa.chunked_array([*held["cents"].chunks, *ready["cents"].chunks], pa.int64()), "available": pa.chunked_array([*held["available"].chunks, *ready["available"].chunks], pa.bool_()),
        "period": pa.chunked_array([*held["period"].chunks, pa.array(np.ones(m, np.int64))], pa.int64()), "first": pa.chunked_array([*held["first"].chunks, *ready["at"].chunks], pa.int64()), "n": pa.chunked_array([*held["n"].chunks, pa.array(np.ones(m, np.int64))], pa.int64()),
    })
    both = both.sort_by([(c, "ascending") for c in ("store", "product", "new", "at", "ord")])
    listing = _differs(both, ["store", "product"])
    starts = np.flatnonzero(listing | _differs(both, ["cents", "available"]))
    if not len(starts):
        return OPEN.append(pa.field("is_open", pa.bool_())).empty_table(), held
    ends = np.append(starts[1:], both.num_rows) - 1
    opens = listing[starts]
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(starts)), 0))
    made = both.take(pa.array(starts))
    number = made["period"].to_numpy()[begin] + np.arange(len(starts)) - begin
    last, count = both["at"].to_numpy()[ends], np.add.reduceat(both["n"].to_numpy(), starts)
    is_open = np.append(opens[1:], True)
    periods = pa.table([made["store"], made["product"], pa.array(number), made["cents"], made["available"], made["first"], pa.array(last), pa.array(count), pa.array(is_open)], schema=OPEN.append(pa.field("is_open", pa.bool_())))
    # a listing without new sightings has its held period alone, which stays as it was saved
    alone = is_open & opens & (both["new"].to_numpy()[ends] == 0)
    return periods.filter(pa.array(~alone)), periods.filter(periods["is_open"]).drop_columns("is_open")


class Periods(StatefulProcessor):
    """Price periods of the listings of a shard. Rows wait in a list until the watermark has passed their day, so that late
    rows come in order; a timer at the earliest waiting day wakes the shard. The open periods of its listings are a second list.

    Both lists hold Arrow blocks and a shard is worked out by columns, as a row of Python for every sighting would cost most
    of the run. Emits every period that ended, and the open one as it stands; a later row of the same number replaces an
    earlier one. A batch emits a period once: the first timer takes all rows that the watermark has passed.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getListState("open", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pa.concat_tables([pa.Table.from_pandas(f.rename(columns={"product_id": "product"})[SIGHTINGS.names], SIGHTINGS, preserve_index=False) for f in rows])
        self.waiting.appendList(_packed(new))
        self.handle.registerTimer(pc.min(new["at"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = _unpacked(self.waiting.get(), SIGHTINGS)
        passed = pc.less_equal(rows["at"], timerValues.getCurrentWatermarkInMs())
        ready, later = rows.filter(passed), rows.filter(pc.invert(passed))
        if not ready.num_rows:
            return
        if later.num_rows:
            self.waiting.put(_packed(later))
            self.handle.registerTimer(pc.min(later["at"]).as_py())
        else:
            self.waiting.clear()
        made, held = extend_all_periods(_unpacked(self.open.get(), OPEN), ready)
        self.open.put(_packed(held))
        for block in made.to_batches(max_chunksize=BLOCK):
            frame = block.to_pandas().astype({"is_open": "bool"})
            for name in ("product", "cents", "available"):
                frame[name] = block[name].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)
            yield frame


def streamed_periods(rows: DataFrame, delay: str, shards: int = 256) -> DataFrame:
    """Price periods of a stream of (store, product_id, day timestamp, ord, cents, available); ord breaks ties of a day.

    Rows up to delay behind the newest day come in order; later ones are dropped by the watermark. Listings are dealt to
    shards by hash, so that a task talks to the state store once a shard and not once a listing; a shard's listings and
    waiting rows are in memory together, so shards should grow with the number of rows.
    """
    schema = "store string, product bigint, period bigint, cents bigint, available boolean, first bigint, last bigint, n bigint, is_open boolean"
    timed = rows.withWatermark("day", delay).selectExpr(f"pmod(xxhash64(store, product_id), {shards}) as shard", "store", "product_id", "day", "unix_millis(day) as at", "ord", "cents", "available")
    made = timed.groupBy("shard").transformWithStateInPandas(Periods(), schema, "Append", "EventTime")
    day = lambda c: F.timestamp_millis(F.col(c)).cast("date")
    return made.select("store", F.col("product").alias("product_id"), "period", F.col("cents").alias("price_cents"), "available", day("first").alias("first_seen"), day("last").alias("last_seen"), F.col("n").alias("n_seen"), "is_open")


def admit(times: list[int], day: int | None, rows: list[int], most: int, window_ms: int) -> tuple[list[bool], list[int], int | None]:
    """Whether each request (ms, in order) is admitted: at most `most` admitted ones in the window before it, of its own day."""
    out = []
    for at in rows:
        if at // DAY_MS != day:
            day, times = at // DAY_MS, []
        times = [t for t in times if t > at - window_ms]
        out.append(len(times) < most)
        if out[-1]:
            times.append(at)
    return out, times, day


class Limiter(StatefulProcessor):
    """Requests of a visitor: a list of admitted times, old ones evicted; a timer at midnight clears it for silent visitors."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        held = [t for (t,) in self.times.get()]
        ok, times, day = admit(held, max(held) // DAY_MS if held else None, [int(t) for t in frame["at"]], self.most, self.window_ms)
        self.times.put([(t,) for t in times]) if times else self.times.clear()
        self.handle.registerTimer((day + 1) * DAY_MS)
        yield pd.DataFrame({"visitor": key[0], "request": frame["request"], "at": frame["at"], "admitted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if all(t < expiredTimerInfo.getExpiryTimeInMs() for (t,) in self.times.get()):
            self.times.clear()
        return iter(())


def streamed_limits(rows: DataFrame, most: int, window_ms: int, delay: str = "1 hour") -> DataFrame:
    """(visitor, request, at, admitted) of a stream of (visitor, request, ts): the sliding limit of each visitor and day."""
    timed = rows.withWatermark("ts", delay).selectExpr("visitor", "request", "ts", "unix_millis(ts) as at")
    return timed.groupBy("visitor").transformWithStateInPandas(Limiter(most, window_ms), "visitor bigint, request bigint, at bigint, admitted boolean", "Append", "EventTime")


def after_refusal(in_a_row: int, every: int, pauses: int) -> str:
    """Every so many refusals in a row ask for a pause; once the pauses are used up, for a stop."""
    if in_a_row == 0 or in_a_row % every:
        return "carry on"
    return "stop" if in_a_row // every > pauses else "pause"


class Refusals(StatefulProcessor):
    """Refusals of a host in a row; any answer resets them, and a host that was stopped is not asked again."""

    def __init__(self, every: int, pauses: int):
        self.every, self.pauses = every, pauses

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", "n bigint, stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        n, stopped = self.row.get() if self.row.exists() else (0, False)
        out = []
        for request, refused in zip(frame["request"], frame["refused"], strict=True):
            if stopped:
                break
            n = n + 1 if refused else 0
            act = after_refusal(n, self.every, self.pauses)
            stopped = act == "stop"
            if act != "carry on":
                out.append((key[0], int(request), n, act))
        self.row.update((int(n), bool(stopped)))
        yield pd.DataFrame(out, columns=["host", "request", "in_a_row", "act"])


def streamed_refusals(rows: DataFrame, every: int = 20, pauses: int = 3) -> DataFrame:
    """(host, request, in_a_row, act) where a stream of (host, request, ts, refused) asks for a pause or a stop."""
    timed = rows.selectExpr("host", "request", "unix_millis(ts) as at", "refused")
    return timed.groupBy("host").transformWithStateInPandas(Refusals(every, pauses), "host bigint, request bigint, in_a_row bigint, act string", "Append", "None")
