import pytest
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.operators import compare, periods, quality, rules


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_backfill_opens_a_period_only_for_priced_products_without_one(spark):
    products = spark.createDataFrame([(1, 10, 5), (2, None, 5), (3, 30, 5)], "id long, cents long, day long")
    known = spark.createDataFrame([(1, True), (3, False)], "id long, is_open boolean")
    assert rows(periods.backfill_open(products, known, "id", "cents", "day")) == [(3, 30, 5, 5, True)]


def test_carried_history_is_closed(spark):
    p = spark.createDataFrame([(1, 10, True), (2, 20, True)], "id long, cents long, is_open boolean")
    moves = spark.createDataFrame([(1, 9)], "old long, new long")
    assert rows(periods.carry_history(p, moves, "id").select("id", "cents", "is_open")) == [(2, 20, True), (9, 10, False)]


def test_new_dates_differ_from_the_latest(spark):
    seen = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, d long")
    known = spark.createDataFrame([(1, 4), (1, 5), (2, 5), (2, 6)], "id long, d long")
    assert rows(periods.new_dates(seen, known, "id", "d")) == [(2, 5)]


@pytest.mark.parametrize(("delisted", "checked", "due"), [("2026-01-01", None, True), ("2026-01-01", "2026-01-03", True), ("2026-01-06", "2026-01-07", False), ("2025-12-01", "2025-12-10", True), ("2025-11-01", "2025-12-20", False)])
def test_rechecks(spark, delisted, checked, due):
    d = lambda x: F.lit(x).cast("date")
    assert spark.range(1).select(periods.recheck_due(d(delisted), d(checked), d("2026-01-09"))).head()[0] is due


def test_promotions(spark):
    today, d = F.lit("2026-05-02").cast("date"), lambda x: F.lit(x).cast("date")
    shown = spark.range(1).select(measures.promotion_shown(F.lit(2.0), F.lit(3.0), d("2026-05-01"), today).alias("gone"), measures.promotion_shown(F.lit(2.0), F.lit(1.5), d(None), today).alias("open")).head()
    assert shown.gone is None and tuple(shown.open) == (None, None)


def test_flags_and_upsert(spark):
    flags = spark.range(1).select(compare.comparison_flags(F.lit("rice"), F.lit("rice grated"), F.lit(1.0), F.lit(2.5), F.lit(1.0), F.lit(None).cast("double"), ["grated"])).head()[0]
    assert flags == ["form-word", "price-gap", "size-unread"]
    old = spark.createDataFrame([(1, 5, 2, True), (2, 6, 1, False)], "id long, v long, dead_count int, delisted boolean")
    new = spark.createDataFrame([(1, None, True), (3, 7, True)], "id long, v long, set_v boolean")
    assert rows(quality.merge_upsert(old, new, ["id"], ["v"]).fillna(-1)) == [(1, -1, 0, False), (2, 6, 1, False), (3, 7, 0, False)]


def test_guarded_mark_refuses_all_or_none(spark):
    all_rows, few, many = spark.range(10), spark.range(1), spark.range(6)
    assert quality.guarded_mark(all_rows, few, "id", "gone", 0.2).filter("gone").count() == 1
    assert quality.guarded_mark(all_rows, many, "id", "gone", 0.2).filter("gone").count() == 0


def test_head_table_join_equals_inline_rules(spark):
    items = spark.createDataFrame([(1, ["green", "tea"], "green tea"), (2, ["tea", "iced"], "tea iced"), (3, ["milk"], "milk")], "id long, tokens array<string>, name string")
    table = spark.createDataFrame([(1, "tea", ["tea"], None, "iced"), (2, "drink", ["tea", "juice"], None, None)], "order int, id string, heads array<string>, require string, exclude string")
    assert rows(rules.match_heads(items, table, "id", "tokens", "name")) == [(1, "tea"), (2, "drink")]


def test_classifier_steps(spark):
    table = [rules.Rule("tea", ("tea",)), rules.Rule("rice", ("rice",))]
    names = [("tea green", "x", "x", ("tea", "head")), ("basmati rice with tea", "x", "x", ("rice", "words")), ("zzz", "rice shelf", "x", ("rice", "shelf")), ("zzz", "x", "tea", ("tea", "parent")), ("zzz", "x", "x", (None, "none"))]
    for name, leaf, parent, want in names:
        assert tuple(spark.range(1).select(rules.classify(F.lit(name), F.lit(leaf), F.lit(parent), table, ["with"])).head()[0]) == want


def test_run_diff_and_tree(spark):
    before, now = (spark.createDataFrame(x, "id long, p double, n string") for x in ([(1, 1.0, "a"), (2, 1.0, "b"), (3, 1.0, "c"), (4, 1.0, "d"), (5, 1.0, "e")], [(1, 6.0, "a"), (2, 1.6, "b"), (3, 1.0, "z"), (4, 1.0, "d"), (6, 1.0, "f")]))
    assert {r.id: r.state for r in quality.run_diff(now, before, "id", "p", "n").collect()} == {1: "absurd", 2: "mover", 3: "renamed", 4: "same", 5: "disappeared", 6: "new"}
    cats, kinds = spark.createDataFrame([("a",), ("b",)], "category string"), spark.createDataFrame([("k", "a"), ("k", "a"), ("m", "q")], "kind string, category string")
    assert rows(rules.tree_problems(cats, kinds)) == [("duplicate-kind", "k"), ("empty-category", "b"), ("unknown-category", "m")]


def test_round_robin_and_examples(spark):
    data = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, i long")
    assert [(r.g, r.i) for r in quality.round_robin(data, "g", ["i"], 3).collect()] == [("a", 0), ("b", 9), ("a", 1)]
    assert rows(quality.tally(data, "g", "i", 2)) == [("a", 5, [0, 1]), ("b", 1, [9])]
