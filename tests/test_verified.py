"""Certainty, gold, review batches, sections over runs, shown groups, successors and page sizes, held against plain rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.operators import resolve, sections, verified

ITEM = "id string, store string, code long, kind string, step string, reviewed boolean"


def test_certainty_rule_by_rule(spark):
    rows = [
        ("reviewed", "A", 1, "k", "shelf", True), ("reviewed none", "A", 1, None, None, True), ("conflict", "A", 2, "k", "head", False), ("other", "B", 2, "m", "cut", None), ("alone head", "A", None, "k", "head", False), ("alone cut", "A", 9, "k", "cut", False), ("own store", "A", 9, "z", "shelf", False),
        ("missing", "A", 3, None, None, False), ("there", "B", 3, "k", "shelf", False), ("nothing", "A", 4, None, None, False), ("confirmed", "A", 5, "k", "shelf", False), ("firm", "B", 5, "k", "head", False), ("weak", "A", 6, "k", "cut", False), ("weak too", "B", 6, "k", "shelf", False), ("weak too", "B", 6, "k", "shelf", False),
    ]
    df = spark.createDataFrame(rows, ITEM).withColumn("_code_", F.lit(1))
    out = verified.certainty_levels(df, "id", "store", "code")
    got = {r.id: (r.level, r.why) for r in out.collect()}
    assert out.count() == len(rows) and out.columns == [*df.columns, "level", "why"]
    assert got["reviewed"] == ("high", "decided in review") and got["reviewed none"] == ("none", "decided in review")
    assert got["conflict"] == ("review", "the same code is m at another store") and got["alone head"] == ("high", "decided by the head word")
    assert got["alone cut"] == ("review", "decided by a cut word, unconfirmed") and got["missing"] == ("review", "no kind here, but the same code is k elsewhere") and got["nothing"] == ("none", "no kind")
    assert got["confirmed"] == ("high", "decided by the shelf, confirmed by code") and got["firm"][0] == "high" and got["weak"][0] == got["weak too"][0] == "review"
    assert verified.certainty_levels(df.limit(0), "id", "store", "code").count() == 0


def test_gold_and_batches(spark):
    now = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "id int, kind string")
    gold, hand = (spark.createDataFrame(x, "id int, kind string") for x in ([(1, "a"), (2, "b"), (9, "x")], [(3, None), (4, None), (2, "b")]))
    assert sorted((r.id, r.verified, r.now) for r in verified.gold_broken(now, [gold, hand], ["id"]).collect()) == [(2, "b", None), (3, None, "c")]
    levels = spark.createDataFrame([("review", "k", "cut", "A")] * 3 + [("review", None, None, "A")] * 2 + [("review", "k", "cut", "B")] * 3 + [("high", "k", "cut", "A"), ("review", "gone", "cut", "A"), ("review", "m", "cut", None)], "level string, kind string, step string, store string")
    got = verified.review_batches(levels, ["store", "kind", "step"], 3, spark.createDataFrame([("gone",)], "kind string")).collect()
    assert [tuple(r) for r in got] == [(1, 3, "A", "k", "cut"), (2, 3, "B", "k", "cut"), (3, 2, "A", "-", "barcode")]
    assert verified.review_batches(levels.limit(0), ["store", "kind", "step"], 3).count() == 0


def test_rereads_wait_for_everyones_turn(spark):
    day = datetime.date(2026, 11, 10)
    ago = lambda n: day - datetime.timedelta(n)
    draw = lambda rows, k=4: [(r.id, r.round, r.new_round) for r in verified.rereads(spark.createDataFrame(rows, "id int, read_on date, reread_round int"), "id", F.lit(day), 2, k, "s").collect()]
    turn, done = [(i, ago(3), 1) for i in range(3)], [(i, ago(5), 2) for i in range(10, 16)]
    assert sorted(i for i, *_ in draw(turn + done + [(99, ago(1), 1)])) == [0, 1, 2]  # 99 still waits, so no new round
    got = draw(turn + done + [(98, ago(1), 2), (97, None, 0)])
    assert len(got) == 4 and {i for i, _, new in got if not new} == {0, 1, 2} and [(r, new) for i, r, new in got if i >= 10] == [(3, True)]
    assert got == draw(list(reversed(turn + done + [(98, ago(1), 2), (97, None, 0)]))) and draw([(97, None, 0)]) == []


def test_section_changes_equal_a_walk_over_the_runs(spark):
    rng = random.Random(5)
    runs = [(s, f"r{i:02}", rng.random() < 0.6) for s in "AB" for i in range(12)] + [("C", "r00", True)]
    seen = [(s, r, f"{top}/{rng.randrange(5)}") for s, r, _ in runs if (s, r) != ("B", "r04") for top in ("Pão", "casa", "x") for _ in range(3)]
    kinds = [(s, "pao ", "food") for s in "ABC"] + [("A", "Casa", "other")]
    want = set()
    for store in "ABC":
        known, last = {}, None  # path -> last seen, and the last run that recorded anything
        for s, run, complete in sorted(runs):
            if s != store:
                continue
            now = {p for a, b, p in seen if (a, b) == (store, run)}
            if known:
                want |= {(store, run, p, "added") for p in now - known.keys()} | ({(store, run, p, "vanished") for p, at in known.items() if at == last and p not in now} if complete else set())
            known |= dict.fromkeys(now, run)
            last = run if now else last
    got = sections.section_changes(spark.createDataFrame(seen + seen[:5], "store string, run string, path string"), spark.createDataFrame(runs, "store string, run string, complete boolean"), spark.createDataFrame(kinds, "store string, section string, kind string")).collect()
    assert sorted((r.store, r.run, r.path, r.change) for r in got) == sorted(want) and {c for *_, c in want} == {"added", "vanished"}
    assert {(r.store, r.path.split("/")[0], r.kind, r.is_food) for r in got if r.store == "A"} == {("A", "Pão", "food", True), ("A", "casa", "other", False), ("A", "x", "undecided", False)}


def test_section_warnings(spark):
    loads = [("A", "1", "Laticínios", 100), ("A", "1", "Peixe", 49), ("A", "1", "Pão", 60), ("A", "1", "Café", 50), ("A", "2", " LATICINIOS", 79), ("A", "2", "cafe", 41), ("A", "2", "Café ", 1), ("A", "3", "Laticínios", 200), ("B", "1", "x", 10)]
    got = {(r.store, r.run, r.section, r.was, r.now, r.warning) for r in sections.section_warnings(spark.createDataFrame(loads, "store string, run string, label string, collected long")).collect()}
    assert got == {("A", "2", None, 259, 121, "fell"), ("A", "2", "laticinios", 100, 79, "fell"), ("A", "2", "pao", 60, None, "missing")}


def test_audit_coverage_and_shown_groups(spark):
    urls = spark.createDataFrame([("https://a.pt/frescos/peixe/?q=1",), ("https://a.pt/frescos#x",), ("https://a.pt/",), ("bad",), (None,), ("https://b.pt/casa//luz",)], "url string")
    got = {(r.path, r.depth, r.n_pages, r.known) for r in sections.audited_paths(urls, "url", spark.createDataFrame([("frescos",)] * 2, "slug string")).collect()}
    assert got == {("frescos", 1, 2, True), ("frescos/peixe", 2, 1, True), ("casa", 1, 1, False), ("casa/luz", 2, 1, False)}
    rows = sections.coverage(spark.createDataFrame([("a", 3), ("b", None), ("c", 1)], "k string, published int"), spark.createDataFrame([("a",), ("c",), ("c",), ("z",)], "k string"), "k").collect()
    assert sorted(map(tuple, rows), key=str) == [("a", 3, 1, 2), ("b", None, 0, None), ("c", 1, 2, -1)]
    flags = {None: True, "": True, "[]": True, '["weak"]': True, '["hide"]': False, '["weak","hide"]': False, "no json": False, '{"hide":1}': False, "null": False}
    groups = spark.createDataFrame([(f, 3, 3, None) for f in flags] + [(None, 2, 3, False), (None, 3, 3, True), ("x", 3, 3, False)], "flags string, stores_compared int, own_brand_priced int, others boolean")
    out = sections.groups_shown(groups, 3, ["hide"]).collect()
    assert [r.shown for r in out] == [*flags.values(), False, False, False] and all(r.own_brand_shown == r.shown for r in out)


def test_successors(spark):
    items = spark.createDataFrame([(1, 2, True), (2, None, False), (3, 4, True), (4, None, True), (5, 6, False), (6, 7, None), (7, None, False), (8, 99, False)], "id int, superseded_by int, delisted boolean")
    stored = [(10, 1, 9), (11, 2, 9), (12, 3, 9), (13, 5, 9), (14, 1, 5), (15, 8, 9), (16, 1, 3), (17, 2, 3)]
    got = {r.id: (r.a, r.b, r.state) for r in resolve.follow_successors(spark.createDataFrame(stored, "id int, a int, b int"), items).collect()}
    assert got == {10: (1, 9, "retired"), 11: (2, 9, "kept"), 12: (3, 9, "kept"), 13: (6, 9, "repointed"), 14: (2, 6, "repointed"), 15: (8, 9, "kept"), 16: (1, 3, "retired"), 17: (2, 3, "kept")}


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: [measures.sold_loose(F.lit(x)) for x in ("LINGUIÇA KG", "ROBALO 800G A 1KG", "POLVO (4 A 5 KG)", "a granel", "ao  quilo", "arroz 1kg", "arroz 1 kg", "kg de arroz")], [True, True, True, True, True, False, True, False]),
        (lambda: [measures.parse_shown_unit_price(F.lit(x)) for x in ("6,65€/lt", "0.1 Kg | 13,9 €/Kg", "8.6 €/Kg", "1.234,50 € / un", "0,00€/kg", "6,65/kg", "")], [(6.65, "l"), (13.9, "kg"), (8.6, "kg"), (1234.5, "un"), None, None, None]),
        (lambda: [measures.priced_per_unit(F.lit(t), F.lit(p)) for t, p in (("2,49€/kg 7,35€/un", 2.49), ("1,99€ 4,98€/kg", 1.99), ("10,99 €/Kg", 10.99), ("3,00 €/L", 2.0), ("€/kg", 2.0))], ["kg", None, "kg", None, None]),
        (lambda: [measures.size_from_unit_price(F.lit(p), F.lit(f), F.lit(u)) for p, f, u in ((4.99, 6.65, "l"), (3.29, 4.39, "l"), (45.99, 61.32, "un"), (100.0, 1.0, "kg"), (0.0, 1.0, "kg"))], [0.75, 0.75, None, None, None]),
        (lambda: [measures.corrected_size(F.lit(n), F.lit(t), F.lit(u), F.lit(w).cast("string")) for n, t, u, w in (("frango", 2.95, "kg", "kg"), ("10 Cápsulas", 10.0, "l", None), ("10 cápsulas", 0.08, "kg", None), ("água", 1.5, "l", None))], [(1.0, "kg"), None, (0.08, "kg"), (1.5, "l")]),
        (lambda: [measures.struck_promotion(F.lit(s).cast("string"), F.lit(p)) for s, p in (("Preço 4,59 €/Kg", 3.0), ("4,59", 4.59), (None, 1.0), ("sem", 1.0), ("4.5", 4.0))], [(True, 4.59), (False, None), (False, None), (False, None), (True, 4.5)]),
        (lambda: [measures.parse_price(F.lit(x)) for x in ("0,86 €", "1.234,56 €", "16,6 €", "12 €", "")], [0.86, 1234.56, 16.6, None, None]),
    ],
    ids=["loose", "shown", "per unit", "derived", "corrected", "struck", "price"],
)
def test_what_page_texts_mean(spark, made, want):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(made())]).first()
    assert [tuple(x) if isinstance(x, tuple) else x for x in row] == want
