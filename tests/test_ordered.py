"""Places and running sums over ranges, and collations."""

from pyspark.sql import functions as F

from shelfwise.functions import locale
from shelfwise.operators import ordered


def test_places_equal_a_sort(spark):
    rows = [(i, (i * 37) % 11 if i % 4 else None) for i in range(500)]
    made = ordered.places(spark.createDataFrame(rows, "id int, v int"), "place", [F.col("v").isNull(), -F.col("v"), F.col("id")], "id", "running").collect()
    want, running = {}, 0
    for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        running += i
        want[i] = (k, running)
    assert {r.id: (r.place, r.running) for r in made} == want and len(made) == 500


def test_places_of_none_and_of_equal_rows(spark):
    assert ordered.places(spark.createDataFrame([], "v int"), "place", [F.col("v")]).collect() == []
    made = ordered.places(spark.createDataFrame([(None,)] * 5 + [(1,)] * 5, "v int"), "place", [F.col("v")]).collect()
    assert sorted(r.place for r in made) == list(range(1, 11)) and {r.place for r in made if r.v is None} == {1, 2, 3, 4, 5}


def test_collations(spark):
    rows = spark.createDataFrame([("maçã",), ("Maca",), ("macb",), ("MAÇÃ",), ("zê",), ("Ábaco",), (None,)], "w string")
    assert [r.w for r in rows.filter("w is not null").orderBy(locale.in_order(F.col("w")), "w").collect()] == ["Ábaco", "Maca", "maçã", "MAÇÃ", "macb", "zê"]
    assert sorted(r["count"] for r in rows.groupBy(locale.blind(F.col("w")).alias("k")).count().collect()) == [1, 1, 1, 1, 3]
    assert [r.x for r in rows.select(locale.contains_blind(F.col("w"), F.lit("ÇA")).alias("x")).collect()] == [True, True, False, True, False, False, None]
