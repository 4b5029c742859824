"""Lines of documents are moved once a reading and never written, and what is found about them equals what it was."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import classifier, resolve, rules
from shelfwise.plans import classify


def _shuffles(df):
    """The different shuffles that a query asks for by itself."""
    out, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "RepartitionByExpression":
            out.add(node.canonicalized().toString())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("name", ["sub_kinds_found", "assignments_changed", "labels_found", "kinds_explained", "head_matches"])
def test_names_are_not_written_and_move_once(spark, monkeypatch, name):
    written, shuffles, write = [], [], resolve.checkpoint
    monkeypatch.setattr(resolve, "checkpoint", lambda df: (written.extend(df.columns), shuffles.append(_shuffles(df)), write(df))[-1])
    for module in (classifier, rules):
        monkeypatch.setattr(module, "checkpoint", resolve.checkpoint, raising=False)
    out = getattr(classify, name)(spark, "/root/testdata/sf0.001")
    assert written and not set(written) & {"name", "plain", "words", "_plain", "_words", "path", "_shelf"}
    # one reading for the words of the rules, one for the result
    assert max(map(len, [*shuffles, _shuffles(out)])) == 1


def test_levels_of_a_path_keep_their_last_digit(spark):
    # the place of a level was taken for a letter to trim: "a1" as the second level became "a"
    kinds = spark.createDataFrame([(1, "k", ["caju1"], None, None, False, False)], "order int, kind string, heads array<string>, require string, exclude string, name_only boolean, prepared boolean")
    words = spark.createDataFrame([], "word string, role string")
    items = spark.createDataFrame([(1, "x", "y/caju1"), (2, "x", "caju1 /0/ "), (3, "x", "/ >")], "id int, name string, path string")
    got = {r.id: (r.kind, r.step, r.why) for r in classifier.explain_kinds(items, kinds, words).collect()}
    assert got == {1: ("k", "shelf", None), 2: ("k", "shelf", None), 3: (None, None, "nothing recognised")}


def test_edges_that_look_for_letters_first_find_the_same(spark):
    patterns = [text.SIZE_TOKEN, text.PACK_TOKEN, r"\bder\b", r"\bs?x", r"\b(?:un|uni)?x", r"\b(ab|cd?)\b", r"\b(a|bc)", r"x\b\d*", r"\be[\s-]+f", r"\\b", r"(?:^|\be)x"]
    texts = ["der", "und der_", "wunder der.", "ßder", "5 kg 12,5x3 ml", "a5 kg", "un. uni pack6", "emb", "ax x sx", "abc ab cd c_", "x5", "e f", "eé f", "\\b", "", "ex e-f", "a\nder"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for p in patterns:
        plain = "(?d)" + re.sub(r"\\(.)", lambda m: text.EDGE if m[1] == "b" else m[0], p)
        assert [r[0] for r in rows.select(F.regexp_replace("t", text.ascii_pattern(p), "|")).collect()] == [r[0] for r in rows.select(F.regexp_replace("t", plain, "|")).collect()], p
    assert all(text.EDGE not in text.ascii_pattern(p).removesuffix(text.EDGE) for p in patterns[:1] + patterns[2:3])


def test_pairs_known_without_the_items(spark):
    items = spark.createDataFrame([(1, "k", "c", "a"), (2, None, None, "a")], "id int, kind string, category string, name string").withColumn("path", F.lit(""))
    table = spark.createDataFrame([(1, "l", "a", None, None, ["k"], None, None), (2, "m", "a", None, None, None, ["k"], None)], "order int, label string, match string, unless string, shelf string, kinds array<string>, not_kinds array<string>, categories array<string>")
    pairs = spark.createDataFrame([("k", "c"), ("k", "c"), (None, None), ("z", "y")], "kind string, category string")
    assert {r.id: r.labels for r in classifier.label_sets(items, table, pairs=pairs).collect()} == {1: ["l"], 2: ["m"]}


def test_the_first_rule_by_order_then_id(spark):
    items = spark.createDataFrame([(1, ["a", "b", "a"], "a b"), (2, ["a"], "x"), (3, [], ""), (4, None, None), (None, ["b"], "b")], "id int, tokens array<string>, name string")
    table = spark.createDataFrame([(2, "late", ["a"], None, None), (1, "z", ["b"], None, None), (1, "y", ["b", "a"], "b", None), (3, None, ["a"], None, None)], "order int, id string, heads array<string>, require string, exclude string")
    assert {(r.id, r.rule) for r in rules.match_heads(items, table, "id", "tokens", "name").collect()} == {(1, "y"), (2, "late"), (None, "y")}
    subs = spark.createDataFrame([("k", 1, "s", "a")], "kind string, order int, sub_kind string, match string")
    kinds = items.withColumn("kind", F.lit("k"))
    assert {tuple(r) for r in classifier.sub_kinds(kinds.filter("id < 4"), subs, also=("kind",)).collect()} == {(1, "k", "s"), (2, "k", None), (3, "k", None)}
