"""Steps whose rows grow no faster than their input, and results at the edges that larger tables reach."""


from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import classifier, quality, resolve, watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_moved_dates_are_not_dealt_to_every_night(spark):
    from datetime import date, timedelta

    first = date(1969, 11, 20)
    changes = [(k, first + timedelta(d), d) for k in (1, 2) for d in range(90)] + [(3, None, 0), (None, first, 1)]
    moved = [(1, first + timedelta(d)) for d in (3, 4, 40, 77)] + [(2, None), (2, first + timedelta(89)), (None, first)]
    changed, dates = spark.createDataFrame(changes, "k long, day date, id long"), spark.createDataFrame(moved, "k long, moved date")
    for nights in (0, 1, 30):
        got = watch.moved_with(changed, dates, "k", "day", "moved", nights)
        want = [(k, i, any(k is not None and k == m and day and at and day <= at <= day + timedelta(nights) for m, at in moved)) for k, day, i in changes]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("k", "id", "signalled").collect())
        assert "sequence(" not in plan(got)


def test_limits_count_times_to_the_nearest_second(spark):
    at = ["00:00:00.6", "00:00:10.4", "00:00:20.5", "00:00:21.5"]
    events = spark.createDataFrame([(1, i, f"2024-01-01 {x}") for i, x in enumerate(at)], "k long, id long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    # seconds 1, 10, 20 and 22: ten seconds back from 10 hold the first, from 20 not the second
    assert rows(quality.limiter(events, "k", "t", "id", 1, 10, 9).select("id", "recent", "allowed")) == [(0, 1, True), (1, 2, False), (2, 1, True), (3, 2, False)]


def test_words_end_where_letters_without_a_base_letter_begin(spark):
    items = spark.createDataFrame([(1, "k", "c", "undßtz", ""), (2, "k", "c", "rund", ""), (3, "k", "c", "x", "ß und"), (4, "k", "c", "a\rb", "")], "id long, kind string, category string, name string, path string")
    none = (None, None, None)
    table = spark.createDataFrame([(1, "u", r"\bund\b", None, r"\bund\b", *none), (2, "dot", "a.b", None, None, *none)], "order int, label string, match string, unless string, shelf string, kinds array<string>, not_kinds array<string>, categories array<string>")
    assert rows(classifier.label_sets(items, table)) == [(1, ["u"]), (2, []), (3, ["u"]), (4, ["dot"])]
    assert spark.range(1).select(text.normalize_name(F.lit("ß5 kgß vinho"))).head()[0] == "vinho"


def test_copies_are_met_once_a_class(spark):
    # 3,000 copies in one brand: item by item 3,000,000 pairs met; here a class with five ids a store
    frame = spark.range(3000).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("store"), F.lit("b").alias("brand"), F.array(F.lit("a"), F.lit("c")).alias("tokens"))
    pairs = resolve.candidate_pairs(frame)
    got = pairs.selectExpr("count(*)", "min(score)", "count_if(a >= 15)", "count(distinct b)").head()
    assert tuple(got) == (29925, 1.0, 0, 2999)
    met = _join_rows(pairs)
    assert met and max(met) <= 30000


def _join_rows(df):
    """Rows out of every join of the executed plan."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    out, todo = [], [execution.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                out.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_batch_arrives_in_many_files(spark):
    from shelfwise.plans import streams

    got = []
    stream = streams._arriving(spark.range(400).withColumnRenamed("id", "at"), ["at"], 2, spark.range(1).selectExpr("1000L as at"))
    query = stream.withColumn("f", F.input_file_name()).writeStream.foreachBatch(lambda b, _: got.append((b.select("f").distinct().count(), b.selectExpr("min(at)").head()[0], b.count()))).option("checkpointLocation", streams._new_folder(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [n for _, _, n in got] == [200, 200, 1] and [m for _, m, _ in got] == [0, 200, 1000]
    assert got[0][0] > 1


def test_rounds_of_components_send_no_labels_through_the_driver(spark, monkeypatch):
    plans, write = [], resolve.checkpoint
    monkeypatch.setattr(resolve, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    found = resolve.components(spark.range(50).selectExpr("id as a", "id + 1 as b"))
    assert {r.component for r in found.collect()} == {0} and found.count() == 51
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_periods_sort_once_and_keep_undated_rows(spark):
    import random

    from shelfwise.operators import periods

    rng = random.Random(3)
    made = [(rng.randrange(6), rng.choice((None, *range(8))), i, rng.choice((1, 2, None))) for i in range(200)]
    got = periods.price_periods(spark.createDataFrame(made, "k long, day int, i long, cents long"), ["k"], ["day", "i"], "day", ["cents"], "following")
    want = []
    for k in {r[0] for r in made}:
        own, n = [], 0
        for _, day, _, cents in sorted((r for r in made if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if not own or own[-1][2] != cents:
                own.append([k, len(own) + 1, cents, [], 0])
            own[-1][3].append(day)
            own[-1][4] += 1
        for n, (key, number, cents, days, seen) in enumerate(own):
            dated = [d for d in days if d is not None]
            want.append((key, number, cents, min(dated, default=None), max(dated, default=None), seen, n == len(own) - 1))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.drop("following").collect())
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Sort [") == 1 and "Aggregate" not in physical


def test_the_cheapest_is_found_by_hashing(spark):
    from shelfwise.plans import queries

    physical = queries.price_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in physical and "SortAggregate" not in physical


def test_a_basket_line_is_moved_once_and_not_once_a_store(spark):
    from shelfwise.operators import compare

    stores = spark.createDataFrame([(f"s{i}",) for i in range(5)], "store string")
    lines = spark.range(1000).selectExpr("id div 4 as basket", "id % 10 as item", "1L as quantity").union(spark.sql("select null, 1L, 1L"))
    prices = spark.range(45).selectExpr("id % 9 as item", "concat('s', id div 9) as store", "id as price_cents").filter("item <> 2 or store <> 's1'")
    out = compare.basket(lines, prices, stores)
    assert max(_join_rows(out)) <= 1001
    got = {(r.basket, r.store): tuple(r)[2:] for r in out.collect()}
    # basket 0 holds items 0 to 3, of which s1 does not price 2; a line without a basket is priced nowhere
    assert got[0, "s1"] == (9 + 10 + 12, 31, 3, 3, 1) and got[0, "s2"] == (18 + 19 + 21, 78, 3, 4, 0) and got[None, "s0"] == (None, None, 0, 0, 1)
