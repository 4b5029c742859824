"""Gates one by one, absences, corroboration, merged results."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import gates

HEALTHY = dict(complete=True, attempted=1000, dead=100, non_food=50, compared=1000, swapped=20, lost=100, changed=300, turnover=0, unchanged=700, availability_changed=0, live=1000, missing=100, tiles=1000, kept=1000, malformed=50, uncategorised=50, unavailable=200, failed=0, published=1000, delivered=990)
CASES = [
    ({}, []), (dict(dead=101), ["dead-pages"]), (dict(dead=400, attempted=499, non_food=0), []), (dict(non_food=3, attempted=50, dead=0), ["non-food"]), (dict(non_food=1, attempted=0, dead=0), []), (dict(swapped=21), ["barcode-swaps"]), (dict(lost=101), ["barcode-losses"]),
    (dict(changed=301), ["price-churn"]), (dict(changed=900, turnover=700), []), (dict(changed=100, unchanged=200, availability_changed=100), []), (dict(changed=310, availability_changed=100), []), (dict(failed=1), ["failed-department"]), (dict(delivered=989), ["truncated"]), (dict(published=100, delivered=94), ["truncated"]), (dict(published=100, delivered=95), []), (dict(published=0, delivered=0), []),
    (dict(missing=101), ["under-collected"]), (dict(malformed=51), ["tile-yield"]), (dict(uncategorised=51), ["empty-categories"]), (dict(unavailable=9), ["unavailable-share"]), (dict(unavailable=401), ["unavailable-share"]), (dict(kept=0, uncategorised=0, unavailable=0), []),
    (dict(complete=False, dead=900, swapped=900, unavailable=0, failed=3, non_food=60), ["non-food"]), (dict(dead=None, turnover=None, availability_changed=None, complete=True), []),
]


def test_every_gate(spark):
    schema = "i int, " + ", ".join(f"{k} {'boolean' if k == 'complete' else 'long'}" for k in HEALTHY)
    rows = [(i, *(HEALTHY | change).values()) for i, (change, _) in enumerate(CASES)]
    got = {r.i: (r.reasons, r.may_confirm) for r in gates.gates(spark.createDataFrame(rows, schema)).collect()}
    for i, (change, reasons) in enumerate(CASES):
        free = change.get("complete", True) and not [x for x in reasons if x != "unavailable-share"]
        assert got[i] == (reasons, free), change
    strict = gates.gates(spark.createDataFrame(rows[:1], schema), {"dead": 0.05}).first()
    assert strict.reasons == ["dead-pages"] and not strict.may_confirm


def test_absences(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert sorted(r.id for r in gates.unheld(ids(1, 2, 2, 3, None), [ids(1, None), ids(3, 9)], "id").collect()) == [2]
    held = ids(*range(100))
    assert [(r.id, r.believed) for r in gates.unpublished(held, ids(*range(5, 100)), "id").orderBy("id").collect()] == [(i, True) for i in range(5)]
    assert {r.believed for r in gates.unpublished(held, ids(*range(6, 100)), "id").collect()} == {False}


@pytest.mark.parametrize(
    ("here", "there", "problem"),
    [
        (("c", 1.0, 1.0, "kg", False), ("c", 1.5, 1.009, "kg", False), None), ((None, 1.0, 1.0, "kg", False), ("c", 1.0, 1.0, "kg", False), "code unknown here"), (("c", 1.0, 1.0, "kg", False), None, "no longer on sale"), (("c", 1.0, 1.0, "kg", False), ("c", 1.0, 1.0, "kg", True), "no longer on sale"),
        (("c", 1.0, 1.0, "kg", False), (None, 1.0, 1.0, "kg", False), "another code"), (("c", 1.0, 1.0, "kg", False), ("c", 1.0, 1.02, "kg", False), "another size"), (("c", 1.0, 1.0, "kg", False), ("c", 1.0, 1.0, "l", False), "another size"), (("c", 1.0, 1.0, "kg", False), ("c", 1.51, 1.0, "kg", False), "another price"), (("c", None, 1.0, "kg", False), ("c", 9.0, 1.0, "kg", False), None),
    ],
)
def test_corroboration(spark, here, there, problem):
    side = "struct<code: string, price: double, size: double, unit: string, delisted: boolean>"
    row = spark.createDataFrame([(1, here, there)], f"i int, here {side}, there {side}")
    assert row.select(gates.corroboration(F.lit(1.0), F.lit("kg"), F.col("here"), F.col("there")).alias("p")).first().p == problem


def test_results_by_label(spark):
    rows = spark.createDataFrame([("a", 2, "y", None, None), ("a", 1, "x", 3, None), ("b", 1, None, None, None), ("a", 3, "x", 4, None)], "label string, at int, item string, expected long, duplicates long")
    got = {r.label: (r["items"], r.expected, r.duplicates) for r in gates.merged_by_label(rows, "label", "at", "item", ["expected", "duplicates"]).collect()}
    assert got == {"a": (["x", "y", "x"], 7, None), "b": ([], None, None)}
