"""The least value of the intervals that hold a point, against every pair."""

import datetime
import random

from pyspark.sql import functions as F

from shelfwise.operators import periods

DAY = datetime.date(1995, 1, 1)


def test_least_of_holding_intervals(spark):
    rng = random.Random(9)
    at = lambda n: DAY + datetime.timedelta(days=n)
    spans = []
    for i in range(300):
        a = rng.choice((0, rng.randrange(4000)))
        spans.append((rng.choice("xy"), rng.choice("st"), at(a), at(a + rng.choice((0, 1, 2, rng.randrange(3000)))), rng.random() < 0.4, rng.randrange(1000), i))
    points = sorted({(k, at(n)) for k in "xyz" for n in [*range(0, 64), *rng.sample(range(7000), 60)]})
    made = periods.interval_least(spark.createDataFrame(points, "k string, day date"), spark.createDataFrame(spans, "k string, store string, a date, z date, shut boolean, v int, i int"), ["k"], ["store"], "day", "a", "z", "shut", F.struct("v", "i"))
    want = {}
    for k, day in points:
        for k2, store, a, z, shut, v, i in spans:
            if k == k2 and a <= day and (day < z or (shut and day == z)):
                want[k, day, store] = min(want.get((k, day, store), (v, i)), (v, i))
    assert {(r.k, r.day, r.store): tuple(r.least) for r in made.collect()} == want and len(want) > 200


def test_least_of_nothing(spark):
    none = spark.createDataFrame([], "k string, store string, a date, z date, shut boolean, v int")
    assert periods.interval_least(spark.createDataFrame([("x", DAY)], "k string, day date"), none, ["k"], ["store"], "day", "a", "z", "shut", F.col("v")).collect() == []
