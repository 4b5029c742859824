"""The classifier on names and shelves whose kinds are known."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import classifier

KINDS = [
    # order, kind, heads, require, exclude, name_only, prepared
    (1, "queijo", ["queijo"], None, None, False, False),
    (2, "sumo", ["batata"], "sumo", None, False, False),
    (3, "batata", ["batata"], None, r"\bpure\b", False, False),
    (4, "frango", ["frango"], None, None, False, False),
    (5, "fiambre", ["fiambre"], None, None, False, True),
    (6, "oleo", ["oleo"], None, None, False, False),
    (7, "acucar", ["acucar"], None, None, False, False),
    (8, "tomate", ["tomate"], None, None, False, False),
    (9, "caju", ["caju"], None, None, False, False),
    (10, "avela", ["avela"], None, None, False, False),
    (11, "pao", ["pao", "broa"], None, None, False, False),
    (12, "pao-ralado", ["pao"], "ralado", None, False, False),
    (13, "cafe", ["cafe"], None, None, False, False),
    (14, "ovo", ["ovo"], None, None, True, False),
    (15, "porco", ["porco"], None, None, False, False),
]
WORDS = [("peito", "cut"), ("filete", "cut"), ("mix", "cut"), ("mix", "mix"), ("fruta", "generic-mix"), ("azeite", "scan-stop"), ("molho", "sauce"), ("cubo", "cut"), ("entrecosto", "cut")]
CASES = {
    # name, path -> kind, step, why
    ("Queijo Fresco de Vaca", ""): ("queijo", "head", None),
    ("Sumo de Batata", "x/Batata"): ("sumo", "shelf", None),
    ("Batata para Sumo", ""): ("sumo", "head", None),
    ("Puré Batata", ""): (None, None, "nothing recognised"),
    ("Peito de Frango", ""): ("frango", "cut", None),
    ("Peito de Frango Fatias", "Charcutaria/Aves"): (None, None, "nothing recognised"),
    ("Peito de Frango Fatias", "Charcutaria/Frango"): (None, None, "prepared or cooked"),
    ("Cubos de Fiambre", "Charcutaria/Fiambres"): ("fiambre", "cut", None),
    ("Filetes em Azeite com Tomate", ""): (None, None, "nothing recognised"),
    ("Filetes com Molho Tomate", ""): (None, None, "nothing recognised"),
    ("Peito sem Açúcar e Tomate", ""): ("tomate", "cut", None),
    ("Mix Tomate Cherry", ""): ("tomate", "cut", None),
    ("Mix de Cajus, Avelãs", ""): (None, None, "a mix of several foods"),
    ("Mix de Cajus, Cajus", ""): ("caju", "cut", None),
    ("Mix Fruta Caju", ""): (None, None, "a mix of several foods"),
    ("Cápsulas Gusto", "Bebidas/Café em Cápsulas"): ("cafe", "shelf", None),
    ("Carcaça", "Padaria/Pão do Dia e Broa"): ("pao", "shelf", None),
    ("Bananas", "Fruta/Caju e Avelã"): (None, None, "shelf names several foods"),
    ("Hummus", "Queijos/Outros"): (None, None, "open shelf"),
    ("Fatias", "Queijo/Tábuas"): ("queijo", "shelf", None),
    ("Fatias", "Queijo/Tábuas/Meia Cura"): (None, None, "nothing recognised"),
    ("Codorniz", "Ovo"): (None, None, "nothing recognised"),
    ("Entrecosto de Porco Slow Cooked", "Talho/Porco"): (None, None, "prepared or cooked"),
    ("", ""): (None, None, "nothing recognised"),
    (None, None): (None, None, "nothing recognised"),
}


def tables(spark):
    kinds = spark.createDataFrame(KINDS, "order int, kind string, heads array<string>, require string, exclude string, name_only boolean, prepared boolean")
    return kinds, spark.createDataFrame(WORDS, "word string, role string")


@pytest.fixture(scope="module")
def explained(spark):
    items = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(CASES)], "id int, name string, path string")
    return {r.id: (r.kind, r.step, r.why) for r in classifier.explain_kinds(items, *tables(spark)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_kind_step_and_reason(explained, i):
    assert explained[i] == list(CASES.values())[i], list(CASES)[i]


def test_food_sections_labels_and_empty_tables(spark):
    kinds, words = tables(spark)
    items = spark.createDataFrame([(1, "Queijo", "x", False, []), (2, "Marca Boa Queijo", "x", True, ["marca boa"]), (3, "Queijo", "x", None, None)], "id int, name string, path string, food boolean, own array<string>")
    got = {r.id: (r.kind, r.why) for r in classifier.explain_kinds(items, kinds, words, labels="own", food="food").collect()}
    assert got == {1: (None, "not a food section"), 2: ("queijo", None), 3: (None, "not a food section")}
    assert classifier.explain_kinds(items.limit(0), kinds, words).collect() == []
    assert {r.why for r in classifier.explain_kinds(items, kinds.limit(0), words.limit(0)).collect()} == {"nothing recognised"}


def test_sub_kinds_labels_and_changes(spark):
    items = spark.createDataFrame([(1, "k", "c", "Fumado Magro", "Frio"), (2, "k", "d", "Magro", None), (3, None, None, "Fumado", ""), (4, "z", "c", None, "frio")], "id int, kind string, category string, name string, path string")
    subs = spark.createDataFrame([("k", 2, "magro", "magro"), ("k", 1, "fumado", "fumado")], "kind string, order int, sub_kind string, match string")
    assert {r.id: r.sub_kind for r in classifier.sub_kinds(items, subs).collect()} == {1: "fumado", 2: "magro", 3: None, 4: None}
    labels = spark.createDataFrame(
        [(1, "frio", "gelado", None, "frio", None, None, None), (2, "magro", "magro", "fumado", None, None, None, ["c", "d"]), (3, "fumado", "fumado", None, None, ["k"], None, None), (4, "outro", ".", None, None, None, ["k"], None), (5, "frio", ".", None, None, None, None, ["c"])],
        "order int, label string, match string, unless string, shelf string, kinds array<string>, not_kinds array<string>, categories array<string>",
    )
    assert {r.id: r.labels for r in classifier.label_sets(items, labels).collect()} == {1: ["frio", "fumado"], 2: ["magro"], 3: ["outro"], 4: ["frio"]}
    stored = spark.createDataFrame([(1, "k", "fumado"), (2, "k", None), (9, "k", None)], "id int, kind string, sub_kind string")
    now = spark.createDataFrame([(1, None, "fumado"), (2, "k", None), (3, "k", None), (4, None, None)], "id int, kind string, sub_kind string")
    assert {(r.id, r.kind, *r.changed) for r in classifier.assignment_changes(stored, now, columns=("kind", "sub_kind")).collect()} == {(1, None, "kind"), (3, "k", "kind")}


def test_normalized_names_keep_containers(spark):
    names = ["Atum em Lata 2 x 120 g", "Garrafa 1,5 L Água", "Emb. Pack 6 un Frasco", "saco 5kg"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in rows] == ["atum em lata", "garrafa agua", "6 frasco", "saco"]
