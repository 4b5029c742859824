"""The upsert target, slices, and the state machines, as functions and as streams that arrive out of order."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from shelfwise.streaming import sink, states


def arriving(spark, tmp_path, schema, files):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def table(spark, tmp_path, schema="k long, v string", key=("k",), buckets=4):
    return sink.VersionedTable(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", schema, list(key), buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_repeated_batch_changes_nothing_and_untouched_buckets_stay(spark, tmp_path):
    t = table(spark, tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert rows(t.read()) == [] and t.last() == (0, -1)
    assert t.merge(frame([(k, "a") for k in range(20)]), 0)
    paths = dict(t._paths())
    assert t.merge(frame([(3, "b"), (99, None)]), 1)
    assert not t.merge(frame([(3, "c"), (4, "c")]), 1) and not t.merge(frame([(3, "c")]), 0)
    assert rows(t.read()) == sorted([(k, "b" if k == 3 else "a") for k in range(20)] + [(99, None)], key=repr)
    assert sum(dict(t._paths())[b] == p for b, p in paths.items()) >= len(paths) - 2
    assert t.merge(frame([]), 2) and len(rows(t.read())) == 21


def test_a_merge_that_dies_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    t.merge(frame([(1, "a")]), 0)
    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: (_ for _ in ()).throw(RuntimeError("died")) if schema and "batch bigint" in str(schema) else made(data, schema, **k))
    with pytest.raises(RuntimeError):
        t.merge(made([(1, "b")], "k long, v string"), 1)
    monkeypatch.undo()
    assert rows(t.read()) == [(1, "a")] and t.last() == (1, 0)
    assert t.merge(frame([(1, "b")]), 1) and rows(t.read()) == [(1, "b")]


def test_two_interrupted_runs_equal_a_whole_one(spark, tmp_path):
    stream = arriving(spark, tmp_path, "k long, v string", [[(i, "a"), (i + 1, "b")] for i in range(5)])
    t, offsets = table(spark, tmp_path), f"file://{tmp_path}/offsets"
    sink.in_slices(stream.writeStream, t.merge, offsets, slices=2)
    assert t.last()[1] == 1
    sink.in_slices(stream.writeStream, t.merge, offsets, seconds=0)
    assert t.last()[1] == 1

    def dies(rows, batch):
        t.merge(rows, batch)
        raise ValueError("after saving")

    with pytest.raises(Exception, match="after saving"):
        sink.in_slices(stream.writeStream, dies, offsets)
    sink.in_slices(stream.writeStream, t.merge, offsets)
    whole = table(spark, tmp_path)
    sink.in_slices(stream.writeStream, whole.merge, f"file://{tmp_path}/other")
    assert rows(t.read()) == rows(whole.read()) and t.last()[1] == 4


def test_rules_of_the_state_machines():
    assert states.extend_periods(None, [(1, 5, True), (3, 5, True), (4, None, True), (6, None, True), (9, None, False)]) == ([(1, 5, True, 1, 3, 2), (2, None, True, 4, 6, 2)], (3, None, False, 9, 9, 1))
    assert states.extend_periods((3, 1, True, 1, 2, 2), []) == ([], (3, 1, True, 1, 2, 2))
    hour = 3_600_000
    ok, times, day = states.admit([], None, [0, 1, 2, hour, hour + 1, states.DAY_MS - 1, states.DAY_MS], 2, hour)
    assert ok == [True, True, False, True, True, True, True] and times == [states.DAY_MS] and day == 1
    assert [states.after_refusal(n, 20, 3) for n in (0, 1, 20, 30, 40, 60, 61, 80, 100)] == ["carry on", "carry on", "pause", "carry on", "pause", "pause", "carry on", "stop", "stop"]


def plain_periods(rows):
    out = []
    for listing in sorted({r[:2] for r in rows}):
        ended, period = states.extend_periods(None, [(r[2], r[4], r[5]) for r in sorted(x for x in rows if x[:2] == listing)])
        out += [(*listing, *p[:3], p[5], p is period) for p in [*ended, period]]
    return sorted(out, key=repr)


def test_late_rows_come_in_order(spark, tmp_path):
    rng = random.Random(2)
    sightings = [(f"s{p % 2}", p, d, f"{i}", rng.choice((100, 200)), rng.random() < 0.8) for p in range(8) for i, d in enumerate(sorted(rng.choices(range(40), k=12)))]
    late = sorted(sightings, key=lambda r: (r[2] + rng.randrange(6), r[3]))
    import datetime

    made = [(s, p, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), o, c, a) for s, p, d, o, c, a in late]
    files = [made[:40], made[40:70], made[70:], [(None, None, datetime.datetime(2100, 1, 1), "", None, None)]]
    stream = arriving(spark, tmp_path, "store string, product_id long, day timestamp, ord string, cents long, available boolean", files)
    t = table(spark, tmp_path, "store string, product_id bigint, period bigint, price_cents bigint, available boolean, first_seen date, last_seen date, n_seen bigint, is_open boolean", ("store", "product_id", "period"))
    save = lambda rows, batch: t.merge(sink.newest(rows, t.key, ["n_seen", "last_seen"]), batch)
    with states.settings(spark, spark__sql__streaming__stateStore__providerClass=states.ROCKS, spark__sql__shuffle__partitions="2"):
        sink.in_slices(states.streamed_periods(stream, "7 days", 3).writeStream.outputMode("append"), save, f"file://{tmp_path}/o1")
    got = t.read().filter("product_id is not null").select("store", "product_id", "period", "price_cents", "available", "n_seen", "is_open")
    want = plain_periods([(s, p, d, o, c, a) for s, p, d, o, c, a in sightings])
    assert rows(got) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_limits_and_refusals_as_streams(spark, tmp_path):
    rng = random.Random(4)
    start = 1_700_000_000
    events = [(v, i, start + i * 700, rng.random() < 0.7) for i, v in enumerate(rng.choices(range(4), k=240))]
    made = spark.createDataFrame(events, "visitor long, request long, s long, refused boolean").withColumn("ts", F.timestamp_seconds("s"))
    made = [tuple(r) for r in made.select("visitor", "request", "ts", "refused").collect()]
    stream = lambda: arriving(spark, tmp_path, "visitor long, request long, ts timestamp, refused boolean", [made[:100], made[100:160], made[160:]])
    limits, refusals = table(spark, tmp_path, "visitor bigint, request bigint, at bigint, admitted boolean", ("request",)), table(spark, tmp_path, "host bigint, request bigint, in_a_row bigint, act string", ("request",))
    with states.settings(spark, spark__sql__streaming__stateStore__providerClass=states.ROCKS, spark__sql__shuffle__partitions="2"):
        sink.in_slices(states.streamed_limits(stream().select("visitor", "request", "ts"), 2, 3_600_000 * 3).writeStream.outputMode("append"), limits.merge, f"file://{tmp_path}/o2")
        sink.in_slices(states.streamed_refusals(stream().withColumnRenamed("visitor", "host"), 3, 2).writeStream.outputMode("append"), refusals.merge, f"file://{tmp_path}/o3")
    want, acts = {}, set()
    for v in range(4):
        own = [(i, s * 1000) for w, i, s, _ in events if w == v]
        want |= dict(zip((i for i, _ in own), states.admit([], None, [t for _, t in own], 2, 3_600_000 * 3)[0], strict=True))
        n = 0
        for w, i, _, refused in events:
            if w == v:
                n = n + 1 if refused else 0
                act = states.after_refusal(n, 3, 2)
                if act != "carry on":
                    acts.add((v, i, n, act))
                if act == "stop":
                    break
    assert {r.request: r.admitted for r in limits.read().collect()} == want and set(want.values()) == {True, False}
    assert {tuple(r) for r in refusals.read().collect()} == acts and any(a[3] == "stop" for a in acts)


def test_deadline_is_a_time(spark, tmp_path):
    stream = arriving(spark, tmp_path, "k long, v string", [[(i, "a")] for i in range(3)])
    t = table(spark, tmp_path)

    def slow(rows, batch):
        t.merge(rows, batch)
        time.sleep(3)

    sink.in_slices(stream.writeStream, slow, f"file://{tmp_path}/offsets", seconds=3)
    assert t.last()[1] == 0


def test_a_shard_is_worked_out_by_columns_like_row_by_row():
    import pyarrow as pa

    rng = random.Random(7)
    sightings = [(rng.choice(("a", "b", None)), rng.choice((1, 2, None)), d, f"{i:03}", rng.choice((5, 6, None)), rng.choice((True, False, None))) for i, d in enumerate(rng.choices(range(30), k=400))]
    held, got = states.OPEN.empty_table(), {}
    for low, high in ((0, 9), (9, 10), (10, 12), (12, 30)):
        part = [r for r in sightings if low <= r[2] < high and not (low == 10 and r[0] == "a")]
        made, held = states.extend_all_periods(held, pa.table(list(zip(*part)), schema=states.SIGHTINGS) if part else states.SIGHTINGS.empty_table())
        keys = [(r["store"], r["product"], r["period"]) for r in made.to_pylist()]
        assert len(keys) == len(set(keys))
        got |= {(r["store"], r["product"], r["period"]): tuple(r.values()) for r in made.to_pylist()}
    want = []
    rows_ = [r for r in sightings if not (10 <= r[2] < 12 and r[0] == "a")]
    for listing in {r[:2] for r in rows_}:
        ended, period = states.extend_periods(None, [(r[2], r[4], r[5]) for r in sorted((x for x in rows_ if x[:2] == listing), key=lambda r: (r[2], r[3]))])
        want += [(*listing, *p, p is period) for p in [*ended, period]]
    assert sorted(got.values(), key=repr) == sorted(want, key=repr)
    assert states._unpacked(iter(states._packed(held)), states.OPEN).equals(held.combine_chunks())


def test_waiting_rows_are_kept_in_blocks():
    import types

    import pandas as pd

    kept = types.SimpleNamespace(waiting=[], timers=[])
    handle = types.SimpleNamespace(getListState=lambda name, schema: types.SimpleNamespace(appendList=kept.waiting.extend), registerTimer=kept.timers.append)
    p = states.Periods()
    p.init(handle)
    frame = pd.DataFrame({"store": "s", "product_id": range(10_000), "day": 0, "at": range(5, 10_005), "ord": "", "cents": [None] * 10_000, "available": [None, True] * 5_000})
    list(p.handleInputRows((0,), iter([frame] * 3), None))
    assert len(kept.waiting) == 3 and kept.timers == [5]
    assert states._unpacked(iter(kept.waiting), states.SIGHTINGS).num_rows == 30_000
