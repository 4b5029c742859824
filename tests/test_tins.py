"""Tins: weights in names and on labels, placing, and rows on one weight, held against plain rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import measures, tins
from shelfwise.operators import tins as rows_of_tins

NAMES = {
    "PÊSSEGO EM CALDA 840 (480)G": (0.84, 0.48), "ATUM (85)120G": (0.12, 0.085), "Atum 115G (72G)": (0.115, 0.072), "Atum 3X75(65)G": (0.225, 0.195), "Grão 2,5 (1.5) kg": (2.5, 1.5),
    "TOMATE FRITO HEINZ 350(210)G": None, "4X 36.5G (146G)": None, "Atum 120 g": None, "Atum 100 (100)g": None, "": None, None: None, "Atum (5)120g": None, "Sardinha 1kg (800g)": None, "Sardinha 1,2kg (0,8kg)": (1.2, 0.8),
}
LABELS = {"emb. 820 gr (peso escorrido 520 gr)": (0.82, 0.52), "emb. 3 x 150 gr (peso escorrido 3 x 140 gr)": (0.45, 0.42), "emb. 2 x 100 g Peso Escorrigo: 80 g": (0.2, 0.16), "emb. 125 gr (peso escorrido 125 gr)": (0.125, 0.125), "emb. 400 gr": None, "emb. 1 kg (peso escorrido 1,2 kg)": None, "peso escorrido 90 g": None, None: None, "": None}
BLOCKS = {("0.084 Kg", "85 g"): (None, 0.085), ("425 g", "230 g"): (0.425, 0.23), ("4 x 100 g", "70 g"): (0.4, 0.28), ("4 x 100 g", "280 g"): (0.4, 0.28), (None, "0.36 Quilograma"): (None, 0.36), ("", "250.0 Grama"): (None, 0.25), ("1 kg", "720"): (1.0, 0.72), ("1 kg", "4 g"): None, ("1 kg", ""): None, ("1 kg", None): None, ("1 kg", "muito"): None}


def pairs(rows):
    return [None if r.w is None else tuple(r.w) for r in rows]


@pytest.mark.parametrize(("told", "read"), [(NAMES, tins.name_weights), (LABELS, tins.label_weights)], ids=["names", "labels"])
def test_weights_in_one_text(spark, told, read):
    rows = spark.createDataFrame(list(enumerate(told)), "i int, text string").select("i", read(F.col("text")).alias("w")).orderBy("i").collect()
    assert dict(zip(told, pairs(rows), strict=True)) == told


def test_weights_of_a_block_and_of_a_list(spark):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(BLOCKS)], "i int, line string, block string").select("i", tins.block_weights(F.col("line"), F.col("block")).alias("w")).orderBy("i").collect()
    assert dict(zip(BLOCKS, pairs(rows), strict=True)) == BLOCKS
    listed = [("Manga 425G", "230 g", (0.425, 0.23)), ("Manga 235 g", "230 g", (None, 0.23)), ("Manga", "230 g", (None, 0.23)), ("Sumo 1 l", "230 g", (None, 0.23)), ("Manga 425g", "", None), (None, None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(listed)], "i int, name string, text string").select("i", tins.listed_weights(measures.parse_size(F.col("name")), F.col("text")).alias("w")).orderBy("i").collect()
    assert pairs(rows) == [w for *_, w in listed]


def same(a, b):
    return abs(a - b) <= max(0.002, 0.02 * max(a, b))


def place(full, drained, size, f, d):
    """The rule, read from its description."""
    if full is not None and drained is not None:
        return None
    if drained is not None:
        return (f, drained) if same(drained, d) else None
    if full is not None:
        return (full, d) if same(full, f) else None
    if size is None:
        return None
    hits = {k for k, v in (("f", f), ("d", d)) if same(size, v)}
    if same(f, d):
        return (size, size) if "f" in hits else None
    return {frozenset("f"): (size, d), frozenset("d"): (f, size)}.get(frozenset(hits))


def test_placed_equals_the_rule_for_every_item(spark):
    rng = random.Random(3)
    weights = (None, None, 0.1, 0.101, 0.14, 0.2)
    items = [(f"{i:03}", "ABC"[i % 3], rng.choice(weights), rng.choice(weights), rng.choice(weights), rng.choice((None, 1, 2)), rng.choice((None, "x", "y"))) for i in range(120)] + [("119", "C", None, None, 0.1, 1, "x")] * 2
    df = spark.createDataFrame(items, "id string, store string, full double, drained double, size double, code int, same string").withColumn("_key", F.lit("clash"))
    want = {}
    for hop, (how, at) in enumerate((("barcode", 5), ("same-product", 6))):
        for me, other in itertools.product(items, items):
            if me[at] is not None and me[at] == other[at] and me[1] != other[1] and None not in other[2:4] and (p := place(*me[2:5], *other[2:4])):
                key = (hop, other[1], *other[2:4])
                if me[0] not in want or key < want[me[0]][0]:
                    want[me[0]] = (key, (*p, f"{how}:{other[1]}"))
    got = rows_of_tins.placed_weights(df, "id", "store", {"barcode": "code", "same-product": "same"}).collect()
    assert len(got) == len(want) > 20 and {r.id: (r.full, r.drained, r.source) for r in got} == {k: v for k, (_, v) in want.items()}
    assert rows_of_tins.placed_weights(df.limit(0), "id", "store", {"barcode": "code"}).count() == 0


def test_rows_of_tins(spark):
    columns = "row string, id int, unit string, tin boolean, size double, full double, drained double, full_source string, drained_source string"
    rows = [
        ("all drained", 1, "kg", True, 1.0, 0.9, 0.5, "page", "barcode:A"), ("all drained", 2, "kg", True, 1.0, None, 0.6, None, "page"), ("all drained", 3, "kg", True, 0.7, None, None, None, None), ("all drained", 4, "kg", False, 2.0, 1.9, None, None, None), ("all drained", 5, "un", True, 6.0, 1.9, None, None, None),
        ("tie", 6, "kg", True, 1.0, 0.9, None, "page", None), ("tie", 7, "kg", True, 1.0, None, 0.5, None, "reviewed"), ("more full", 8, "kg", True, 1.0, 0.9, None, "same-product:B", None), ("more full", 9, "kg", True, 1.0, 0.8, None, "name", None), ("more full", 10, "kg", True, 1.0, None, 0.3, None, "page"), ("none", 11, "l", None, 1.0, None, None, None, None),
    ]
    got = {r.id: (r.basis, r.compared, r.sits_out, r.note) for r in rows_of_tins.tin_rows(spark.createDataFrame(rows, columns), ["row"], F.col("tin"), {"A": "Loja A"}).collect()}
    assert got[1] == ("drained", 0.5, None, "Peso escorrido do rótulo do mesmo produto (mesmo código de barras) no Loja A; a loja não o indica.")
    assert [got[i] for i in (2, 3, 4, 5)] == [("drained", 0.6, None, None), ("drained", 0.7, None, None), ("drained", 2.0, None, None), ("drained", 6.0, None, None)]
    assert got[6] == ("drained", None, "full", None) and got[7] == ("drained", 0.5, None, "Peso escorrido estimado por nós e verificado; a loja não o indica.")
    assert got[8] == ("full", 0.9, None, "Peso total do rótulo do mesmo produto no B; a loja não o indica.") and got[9] == ("full", 0.8, None, None) and got[10] == ("full", None, "drained", None)
    assert got[11] == (None, 1.0, None, None)


def test_a_pattern_is_written_once_in_the_expression_of_a_size(spark):
    from shelfwise.functions import measures, tins

    name = spark.range(1).select(F.lit("Lata atum 3 x 120 g + 20 g").alias("t"))
    for made, most in ((measures.parse_size(F.col("t")), 12), (tins.listed_weights(measures.parse_size(F.col("t")), F.col("t")), 15), (tins.block_weights(F.col("t"), F.col("t")), 8), (tins.label_weights(F.col("t")), 8)):
        plan = name.select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract(") + plan.count("regexp_replace(") <= most
    assert tuple(name.select(measures.parse_size(F.col("t")).alias("x")).head().x) == (0.38, "kg", 3)


def test_names_are_read_by_all_tasks(spark, tmp_path):
    from shelfwise.plans import tins as plans

    part = spark.range(40).selectExpr("id as p_partkey", "'x' as p_name", "'b' as p_brand", "cast(id + 1 as int) as p_size")
    part.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    read = plans.tin_labels(spark, f"file://{tmp_path}")
    assert read.withColumn("t", F.spark_partition_id()).select("t").distinct().count() >= spark.sparkContext.defaultParallelism
