import gzip

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.operators import pages
from shelfwise.operators.rules import Rule
from shelfwise.sources import ingest
from shelfwise.streaming import stateful


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pages_are_routed(spark):
    df = spark.createDataFrame([(1, 200, "a", "food", None), (2, 200, "a", None, "food"), (3, 200, "a", None, None), (4, 404, None, None, "food"), (5, 503, None, None, "food"), (6, None, None, None, "food"), (7, 200, None, "food", None), (8, 200, "a", "toys", "food")], "id int, status int, name string, shelf string, target string")
    r = pages.route_page(F.col("status"), F.col("name"), F.col("shelf"), F.col("target"), lambda s, n: s == "food")
    assert [x.route for x in df.orderBy("id").select(r["route"].alias("route")).collect()] == ["kept", "kept", "unreachable", "dead", "unreachable", "unreachable", "dead", "other"]


def test_a_walk_ends_at_an_empty_a_wrapped_a_last_or_a_short_page(spark):
    tiles = spark.createDataFrame([(w, p, i) for w in "abcd" for p, i in [(0, 1), (0, 2), (1, 3), (1, 4)]] + [("a", 3, 9), ("b", 2, 1), ("b", 2, 3), ("b", 3, 9), ("c", 2, 7), ("c", 2, 8), ("d", 2, 7), ("d", 3, 9)], "walk string, page int, item int")
    known = spark.createDataFrame([(w, p, n) for w, n in zip("abcd", (99, 99, 4, None), strict=True) for p in range(4)], "walk string, page int, published int")
    got = {(r.walk, r.page): (r.collected, r.stop) for r in pages.walk_stops(known, tiles, "walk", "page", "item", "published", 2).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {("a", 2): (4, "empty"), ("b", 2): (4, "wrapped"), ("c", 1): (4, "complete"), ("d", 2): (5, "short")}
    assert len(got) == 3 + 3 + 2 + 3


@pytest.mark.parametrize(("name", "size", "unit", "source", "page", "count", "want"), [
    ("ovos", None, None, None, False, 12, (12.0, "un", "count")),
    ("arroz 500 g", None, None, None, False, None, (0.5, "kg", "name")),
    ("peixe kg", None, None, None, False, None, (1.0, "kg", "loose")),
    ("peixe kg", None, None, "listing", False, None, (None, None, "kept")),
    ("arroz 500 g", 2.0, "kg", None, True, None, (2.0, "kg", "kept")),
    ("arroz 500 g", 2.0, "kg", None, False, None, (0.5, "kg", "name")),
    ("arroz", 2.0, "kg", None, False, None, (None, None, "cleared")),
    ("arroz 500 g", 0.52, "kg", "listing", False, None, (0.5, "kg", "listing")),
    ("arroz 500 g", 399.0, "kg", "listing", False, None, (0.5, "kg", "name")),
    (None, None, None, None, None, None, (None, None, "kept")),
])
def test_sizes_are_settled_by_provenance(spark, name, size, unit, source, page, count, want):
    df = spark.createDataFrame([(name, size, unit, source, page, count)], "name string, size double, unit string, source string, page boolean, count int")
    no = F.lit(False)
    df = df.withColumns({"parsed": measures.parse_size(F.col("name")), "loose": measures.sold_loose(F.col("name"))})
    got = df.select(pages.backfilled_size(F.col("parsed"), F.col("loose"), F.col("size"), F.col("unit"), F.col("source"), F.col("page"), F.col("name") == "ovos", F.col("count"), no, no, no).alias("s")).head().s
    assert (got.size, got.unit, got.via) == want


def test_donors_rank_by_key_and_never_share_the_store(spark):
    items = spark.createDataFrame([(1, "a", 7, "x", None), (2, "a", 7, "x", 5.0), (3, "b", None, "x", 6.0), (4, "c", 7, None, 7.0), (5, "b", None, "y", None), (6, "c", None, None, None)], "id int, store string, code int, same string, weight double").withColumn("unit", F.lit("kg"))
    assert rows(pages.donor_values(items, "id", "store", ["code", "same"], ["unit"], "weight")) == [(1, 7.0, 4, "code")]
    assert rows(pages.donor_values(items, "id", "store", ["same"], ["unit"], "weight")) == [(1, 6.0, 3, "same")]


def test_grouped_writes_and_guesses(spark):
    changes = spark.createDataFrame([("a", None)] * 5 + [("a", "x"), (None, None)], "kind string, labels string")
    assert rows(pages.grouped_writes(changes, ["kind", "labels"], 2)) == [("a", "x", 1, 1), ("a", None, 5, 3), (None, None, 1, 1)]
    names = spark.createDataFrame([("leite gordo",), ("bolo com leite",), ("puro leite",), (None,)], "n string")
    assert [r[0] for r in names.select(pages.name_guess(F.col("n"), [Rule("milk", ("leite",))], ["com"])).collect()] == ["milk", None, "milk", None]


def test_lookup_and_hand_columns(spark):
    dim = spark.createDataFrame([(1, "one"), (2, None)], "k int, label string")
    assert rows(pages.looked_up(spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int"), dim, "k", "label", F.lit("?"))) == [(1, "one"), (2, "?"), (3, "?"), (None, "?")]
    days = spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int")
    assert rows(pages.with_hand_columns(days, spark.createDataFrame([("a", "x"), ("c", "y")], "day string, note string"), "day")) == [("a", 1, "x"), ("b", 2, None)]


def test_saved_pages_and_sections(spark, tmp_path):
    (tmp_path / "12.html").write_text("<p>\nplain")
    (tmp_path / "13.html.gz").write_bytes(gzip.compress("<p>é\npacked".encode()))
    assert rows(pages.saved_pages(spark, str(tmp_path))) == [("12", "<p>\nplain"), ("13", "<p>é\npacked")]
    batch = spark.createDataFrame([(1, "a > b"), (2, "c")], "id int, shelf string")
    pages.save_by_section(batch, str(tmp_path / "kept"), F.split("shelf", " > ")[0])
    assert rows(spark.read.parquet(str(tmp_path / "kept")).select("id", "section")) == [(1, "a"), (2, "c")]


def test_reports(spark, tmp_path):
    root = str(tmp_path)
    pages.write_report(spark.createDataFrame([("s", "OK", 0)], "store string, verdict string, problems int"), root, "1")
    pages.write_report(pages.failure_report(spark, "s", ValueError("broke")), root, "2")
    latest = spark.read.json(f"{root}/latest").head()
    assert (latest.verdict, latest.error) == ("FAIL", "ValueError: broke")
    assert rows(spark.read.json(f"{root}/history").select("stamp", "verdict")) == [("1", "OK"), ("2", "FAIL")]


def test_snapshot_rebuild_and_search(spark, tmp_path):
    items = spark.createDataFrame([(1, ["leite", "gordo"], 2.0), (2, ["leite"], None), (3, ["leite"], 1.0), (4, ["pao"], 1.0)], "id int, tokens array<string>, unit_price double")
    path = ingest.snapshot(items, str(tmp_path), "2026-01-01")
    assert spark.read.parquet(path).count() == 4 and spark.read.parquet(str(tmp_path)).select("day").distinct().count() == 1
    ingest.rebuild(items, f"{tmp_path}/t")
    ingest.rebuild(items.filter("id = 1"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert [r.id for r in ingest.search(items, "tokens", F.lit("Leites"), "unit_price").collect()] == [3, 1, 2]


def test_page_readings(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(ingest.result_count(F.lit("<b>1.234 produtos</b>"))) == 1234 and one(ingest.result_count(F.lit("none"))) is None
    assert one(ingest.is_blocked(F.lit(474), F.lit(""))) and one(ingest.is_blocked(F.lit(403), F.lit("Access denied"))) and not one(ingest.is_blocked(F.lit(403), F.lit("hello")))
    assert one(ingest.label_from_slug(F.lit("pao-de-forma"))) == "Pao de Forma"


def test_batches_are_saved_once_and_hours_counted(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", "2026-01-01 10:05:00"), ("a", "2026-01-01 10:50:00"), ("b", "2026-01-01 11:00:00")], "key string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema("key string, at timestamp").parquet(source)
    seen = []
    for _ in range(2):  # the second start finds nothing new
        stateful.save_batches(stream, lambda df, n: seen.append((n, df.count())), f"{tmp_path}/c").awaitTermination()
    assert seen == [(0, 3)]
    hourly = stateful.hourly_counts(spark.read.parquet(source), "at", "key").select(F.date_format("window.start", "HH").alias("h"), "key", "count")
    assert rows(hourly) == [("10", "a", 2), ("11", "b", 1)]
