import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import compare, periods, quality, resolve, rules
from shelfwise.sources import ingest
from shelfwise.streaming import stateful


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture
def three_stores(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",)], "store string")


def test_cells_tell_three_states_apart(spark, three_stores):
    data = [("k", "a", 1, 100, 1.0), ("k", "a", 2, 90, 1.0), ("k", "b", 3, None, 1.0), ("k", "c", 4, 50, None)]
    out = compare.cells(spark.createDataFrame(data, "kind string, store string, product_id long, price_cents long, size double"), three_stores, ["kind"])
    assert rows(out.select("store", "state", "unit_cents", "item", "example")) == [("a", "price", 90, 2, None), ("b", "not-stocked", None, None, None), ("c", "no-size", None, None, 4)]


def test_winners_tie_by_cent_and_need_two(spark):
    grid = spark.createDataFrame([("x", "a", 155), ("x", "b", 155), ("x", "c", 160), ("y", "a", 10), ("y", "b", None)], "kind string, store string, unit_cents long")
    out = {(r.kind, r.store): r.is_winner for r in compare.with_winners(grid, ["kind"]).collect()}
    assert out == {("x", "a"): True, ("x", "b"): True, ("x", "c"): False, ("y", "a"): False, ("y", "b"): False}


def test_basket(spark, three_stores):
    lines = spark.createDataFrame([(1, "m", 2), (1, "n", 1), (1, "o", 0)], "basket long, item string, quantity long")
    prices = spark.createDataFrame([("m", s, p) for s, p in zip("abc", (10, 20, 30), strict=True)] + [("n", "a", 5), ("o", "a", 7)], "item string, store string, price_cents long")
    out = compare.basket(lines, prices, three_stores)
    assert rows(out.select("store", "comparable_cents", "full_cents", "n_missing")) == [("a", 20, 25, 0), ("b", 40, 40, 1), ("c", 60, 60, 1)]


def test_tin_basis_prefers_drained_on_ties(spark):
    out = compare.tin_basis(spark.createDataFrame([("g", 1, 0.1, None), ("g", 2, None, 0.2)], "g string, id long, drained double, full double"), ["g"], "drained", "full")
    assert rows(out.select("id", "basis", "weight")) == [(1, "drained", 0.1), (2, "drained", None)]


def test_selection_codec(spark):
    got = spark.range(1).select(compare.parse_selection(F.lit("a:2,b:500,a:9,:1,c:x")).alias("m")).head().m
    assert got == {"a": 2, "b": 99}


@pytest.mark.parametrize(("values", "n"), [([100, 100, 120, 120, 100], 3), ([None, None], 1), ([100, None, 100], 3)])
def test_periods_equal_replay(spark, values, n):
    from types import SimpleNamespace

    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, day long, cents long")
    got = rows(periods.price_periods(df, ["k"], ["day"], "day", ["cents"]).select("first_seen", "last_seen", "cents"), "first_seen")
    state, closed = stateful.replay([SimpleNamespace(key="k", day=i, cents=v) for i, v in enumerate(values)], stateful.close_period)
    assert len(got) == n == len(closed) + 1
    assert [(a, b, c) for a, b, c in got[:-1]] == [(a, b, c) for _, c, a, b in closed]


def test_streaks_reach_three_after_reset(spark):
    df = spark.createDataFrame([("p", i, d) for i, d in enumerate([True, True, False, True, True, True])], "k string, i long, dead boolean")
    out = rows(periods.streaks(df, ["k"], ["i"], F.col("dead"), 3).select("i", "streak", "reached"))
    assert [x[1] for x in out] == [1, 2, 0, 1, 2, 3]
    assert [x[0] for x in out if x[2]] == [5]


def test_interval_join_half_open_but_for_the_last(spark):
    points = spark.createDataFrame([("k", d) for d in ("2026-01-01", "2026-01-05", "2026-01-10", "2026-01-11")], "k string, day string").withColumn("day", F.to_date("day"))
    spans = spark.createDataFrame([("k", 1, "2026-01-01", "2026-01-05", False), ("k", 2, "2026-01-05", "2026-01-10", True)], "k string, id long, s string, e string, last boolean").withColumn("s", F.to_date("s")).withColumn("e", F.to_date("e"))
    out = periods.interval_join(points, spans, ["k"], "day", "s", "e", "last", 3)
    assert sorted((str(r.day), r.id) for r in out.collect()) == [("2026-01-01", 1), ("2026-01-05", 2), ("2026-01-10", 2)]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (9, 2)], "a long, b long")
    members = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    assert rows(resolve.components(links, members)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in resolve.components(links).collect()} == {0}


def test_reconcile_equals_greedy(spark):
    rng = random.Random(3)
    old = [(rng.randrange(6), m) for m in range(60)]
    new = [(rng.randrange(100, 107), m) for m in range(60)]
    n = {}
    for (g, _), (c, _) in zip(old, new, strict=True):
        n[g, c] = n.get((g, c), 0) + 1
    taken, used_g, used_c = {}, set(), set()
    for (g, c), _ in sorted(n.items(), key=lambda x: (-x[1], x[0])):
        if g not in used_g and c not in used_c:
            taken[c] = g
            used_g.add(g)
            used_c.add(c)
    out = resolve.reconcile_ids(spark.createDataFrame(old, "group long, member long"), spark.createDataFrame(new, "cluster long, member long")).collect()
    assert {r.cluster: r.group for r in out if r.status == "kept"} == taken
    assert {r.group for r in out if r.status == "retired"} == {g for g, _ in old} - set(taken.values())


def test_guards_and_core(spark):
    members = spark.createDataFrame([(1, 1, "a", 1.0, "kg", "x"), (2, 1, "b", 1.04, "kg", "x"), (3, 1, "c", 1.09, "kg", "y")], "id long, component long, store string, size double, unit string, gtin string")
    links = spark.createDataFrame([(1, 2, "ean"), (2, 3, "fuzzy")], "a long, b long, rung string")
    refused = spark.createDataFrame([(1, 3)], "a long, b long")
    assert resolve.guards(members, links, refused).head().flags == ["barcode-unconfirmed", "weak-links-only", "size-spread", "refused-pair"]
    assert rows(resolve.barcode_core(members).select("id")) == [(1,), (2,)]


def test_blocking_keeps_a_single_common_token(spark):
    there = [(i, "t", None, ["milk"]) for i in range(5)] + [(8, "t", "y", ["rare", "milk"])]
    asking = [(20, "s", None, ["milk"]), (21, "s", "x", ["milk", "rare"]), (22, "s", "y", ["rare"]), (23, "s", "", ["none"])]
    items = spark.createDataFrame(there + asking, "id long, store string, brand string, tokens array<string>")
    got = rows(resolve.blocking_keys(items, most=3).filter("target = 't'").select("id", "token", "place"))
    assert got == [(20, "milk", 1), (21, "rare", 1)]


def plain_pairs(items, most=400, rarest=2, least=0.45, top=5):
    """The lookup rule item by item: (a, b, score, block)."""
    stores, out = sorted({s for _, s, *_ in items}), {}
    for i, store, brand, tokens, _ in items:
        for target in stores:
            if target == store:
                continue
            there = [x for x in items if x[1] == target]
            found = [x for x in there if brand and x[2] == brand]
            block = "brand" if found else "token"
            if not found:
                df = sorted((sum(t in x[3] for x in there), t) for t in set(tokens))
                ranked = [(n, t) for n, t in df if n]
                keys = [t for n, t in ranked if n <= most][:rarest] or [t for _, t in ranked[:1]]
                found = [x for x in there if set(keys) & set(x[3])]
            scored = [(-len(set(tokens) & set(x[3])) / len(set(tokens) | set(x[3])), x[0]) for x in found if set(tokens) | set(x[3])]
            for score, j in sorted(s for s in scored if -s[0] >= least)[:top]:
                key = (min(i, j), max(i, j))
                if key not in out or block == "brand":
                    out[key] = (-score, block)
    for x in items:
        for y in items:
            if x[0] < y[0] and x[1] != y[1] and x[4] is not None and x[4] == y[4]:
                both = set(x[3]) | set(y[3])
                out.setdefault((x[0], y[0]), (len(set(x[3]) & set(y[3])) / len(both) if both else 0.0, "gtin"))
    return {(*k, round(s, 9), b) for k, (s, b) in out.items()}


def test_candidates_equal_lookups_item_by_item(spark):
    import random

    rng = random.Random(6)
    words = [f"w{i}" for i in range(14)]
    items = [(i, rng.choice("stu"), rng.choice((None, "", "b1", "b2", "b3" if i < 40 else "b1")), rng.choices(words[: rng.choice((4, 14))], k=rng.randrange(5)), rng.choice((None, None, i % 17))) for i in range(160)]
    frame = spark.createDataFrame(items, "id long, store string, brand string, tokens array<string>, gtin long")
    got = {(r.a, r.b, round(r.score, 9), r.block) for r in resolve.candidate_pairs(frame, gtin="gtin").collect()}
    assert got == plain_pairs(items) and {x[3] for x in got} == {"brand", "token", "gtin"}
    assert resolve.candidate_pairs(frame.limit(0), gtin="gtin").collect() == []


def test_human_decisions_stay(spark):
    schema = "a long, b long, verdict string, source string"
    out = resolve.merge_decisions(spark.createDataFrame([(1, 2, "NO", "HUMAN"), (3, 4, "NO", "AUTO")], schema), spark.createDataFrame([(1, 2, "YES", "AUTO"), (3, 4, "YES", "AUTO")], schema))
    assert rows(out) == [(1, 2, "NO", "HUMAN"), (3, 4, "YES", "AUTO")]


def test_rules(spark):
    table = [rules.Rule("tea", ("tea",), exclude="iced"), rules.Rule("drink", ("tea", "juice")), rules.Rule("shelf", ("x",), name_only=True)]
    got = [r[0] for r in spark.createDataFrame([(0, "tea green"), (1, "tea iced"), (2, "x")], "i long, n string").orderBy("i").select(rules.first_match(table, F.col("n"))).collect()]
    assert got == ["tea", "drink", "shelf"]
    assert spark.range(1).select(rules.first_match(table, F.lit("x"), from_shelf=True)).head()[0] is None
    kept = spark.range(1).select(rules.keep_decision(rules.section_verdict(F.array(F.lit("toys")), {"food": "food"}, []), F.lit("k")).alias("d")).head().d
    assert tuple(kept) == (False, "unknown-section")


def test_null_override_beats_rule(spark):
    items = spark.createDataFrame([(1, "g", "r"), (2, "g", "r"), (3, "h", "r")], "id long, grp string, kind string")
    out = rules.with_overrides(items, spark.createDataFrame([(1, None)], "id long, kind string"), spark.createDataFrame([("g", "G")], "grp string, kind string"), "id", "grp", "kind")
    assert rows(out.select("id", "final", "source")) == [(1, None, "item"), (2, "G", "group"), (3, "r", "rule")]


def test_quality(spark):
    runs = spark.createDataFrame([("s", i, v) for i, v in enumerate([1000, 500, 500, 500])], "f string, r long, n long")
    assert [r.trust for r in quality.sitemap_verdict(runs, "f", "r", "n").orderBy("r").collect()] == ["first", "doubted", "doubted", "accepted"]
    before, now = (spark.createDataFrame(x, "k string, n long") for x in ([("a", 49), ("b", 50), ("c", 5)], [("a", 20), ("b", 20), ("d", 1)]))
    assert {r.k: r.state for r in quality.drop_warnings(now, before, "k", "n").collect()} == {"a": "ok", "b": "dropped", "c": "missing", "d": "new"}
    assert spark.range(1).select(quality.escalate(F.array(F.lit("OK"), F.lit("FAIL"), F.lit("WARN")))).head()[0] == "FAIL"
    assert quality.binomial_upper(0, 59) == pytest.approx(0.0495, abs=1e-3)


def test_ingest(spark):
    xml = "<urlset><url><loc>https://x.pt/p/milk-1234.html</loc><lastmod>2026-01-02</lastmod></url><url><loc>https://x.pt/about</loc><lastmod>bad</lastmod></url></urlset>"
    entries = ingest.sitemap_entries(spark.createDataFrame([("f", xml)], "file string, xml string"), "file", "xml")
    assert [(r.loc, str(r.lastmod)) for r in entries.orderBy("loc").collect()] == [("https://x.pt/about", "None"), ("https://x.pt/p/milk-1234.html", "2026-01-02")]
    assert tuple(ingest.sitemap_summary(entries, ingest.product_id(F.col("loc"))).head())[:4] == ("f", 2, 1, 1)
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Product","name":"A &amp; B","brand":{"name":"Z"},"offers":{"price":"1.50","availability":"InStock"}}</script>'
    page = spark.createDataFrame([(html, 200)], "h string, s int")
    got = page.select(ingest.product_page(F.col("h")).alias("p"), ingest.page_status(F.col("s"), F.col("h")).alias("status")).head()
    assert (got.p.name, got.p.brand, got.p.price, got.status) == ("A & B", "Z", 1.5, "alive")
    tiles = spark.createDataFrame([("p", "<div data-product='{&quot;id&quot;:&quot;1&quot;,&quot;name&quot;:&quot;x&quot;}'><div data-product='{oops'><div data-product='{\"id\":\"1\"}'>")], "k string, h string")
    found = ingest.tiles(tiles, "k", "h")
    assert rows(ingest.tile_accounts(found, "k")) == [("p", 2, 1, 1, 1, 0)]


def test_stateful_steps_and_stream(spark, tmp_path):
    from types import SimpleNamespace as N

    _, out = stateful.replay([N(key="k", refused=True)] * 25, stateful.refusals())
    assert out == [("k", 20, "pause")]
    _, out = stateful.replay([N(key="k", second=s) for s in (0, 1, 2, 3600)], stateful.sliding_limit(2, 3600))
    assert [x[2] for x in out] == [True, True, False, True]
    path = str(tmp_path / "in")
    spark.createDataFrame([("k", i, True) for i in range(4)], "key string, at long, dead boolean").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key string, at long, dead boolean").parquet(path)
    q = stateful.keyed(stream, "key", "at", "key string, n long, at long", "n long", stateful.count_dead(3)).writeStream.format("memory").queryName("dead").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("dead").collect()] == [("k", 3, 2)]
