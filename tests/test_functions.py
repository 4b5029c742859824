import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import codes, measures, text


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {t(v)}" for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("v")).head()[0]


def t(v):
    return {bool: "boolean", int: "long", float: "double", str: "string", datetime.date: "date", list: "array<string>"}[type(v)]


@pytest.mark.parametrize(("word", "folded"), [("paes", "pao"), ("limoes", "limao"), ("animais", "animal"), ("ovos", "ovo"), ("gas", "gas"), ("mel", "mel")])
def test_fold_plural(spark, word, folded):
    assert value(spark, text.fold_plural(F.col("w")), w=word) == folded


def test_names(spark):
    assert value(spark, text.normalize_name(F.col("n")), n="Maçã  Golden, Pack 6x200 g!") == "maca golden"
    assert value(spark, text.normalize_brand(F.col("n")), n="Pão & Cª") == "paoc"
    assert value(spark, text.name_tokens(F.col("n")), n="a bom bom leite") == ["bom", "leite"]
    assert value(spark, text.section_key(F.col("n")), n=" Frutas & Legumes ") == "frutas-legumes"
    assert value(spark, text.clean_comment(F.col("n")), n="\x01 \t") is None
    assert value(spark, text.is_house_brand(F.col("n"), ["casa"]), n="Casa Boa") is True


def test_jaccard_and_terms(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert value(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert value(spark, text.jaccard(a, F.array().cast("array<string>"))) == 0
    assert value(spark, text.matches_term(F.array(F.lit("ovo"), F.lit("classe")), F.lit("Ovos"))) is True
    assert value(spark, text.qualifier_mismatch(F.lit("leite magro"), F.lit("leite"), [("skim", "magro"), ("bio", "bio")])) == "skim"


@pytest.mark.parametrize(("raw", "good"), [("5601234567893", None), ("4006381333931", "04006381333931"), ("2012345678900", None), ("", None), ("123456789012345", None)])
def test_gtin(spark, raw, good):
    assert value(spark, codes.matchable_gtin(F.col("g")), g=raw) == good


SIZES = [
    ("Leite 1 L", (1.0, "l", 1)), ("Iogurte 6 x 125 g", (0.75, "kg", 6)), ("Arroz 1.000 g", (1.0, "kg", 1)), ("Vinho 75 cl", (0.75, "l", 1)), ("Queijo 200 a 300 g", None), ("Bolacha 200 g + 50 g", (0.25, "kg", 1)),
    ("Barril 50 l", None), ("Ovos 12 un", (12.0, "un", 1)), ("Sem tamanho", None), ("Atum 120 g (escorrido 80 g)", (0.12, "kg", 1)),
]


@pytest.mark.parametrize(("name", "size"), SIZES)
def test_parse_size(spark, name, size):
    got = value(spark, measures.parse_size(F.col("n")), n=name)
    assert (tuple(got) if got else None) == size


def test_money_and_sizes(spark):
    assert value(spark, measures.cents(F.lit(1.005))) in (100, 101)
    assert value(spark, measures.sellable_price(F.lit(0.01))) is None
    assert value(spark, measures.sellable_price(F.lit(float("nan")))) is None
    assert value(spark, measures.for_sale(F.lit(2.0), F.lit(False))) is None
    assert value(spark, measures.for_sale(F.lit(2.0), F.lit(None).cast("boolean"))) == 2.0
    assert value(spark, measures.size_from_unit_price(F.lit(2.49), F.lit(4.98), F.lit("kg"))) == 0.5
    assert value(spark, measures.count_from_unit_price(F.lit(2.4), F.lit(0.2), 60, (6, 12))) == 12
    assert value(spark, measures.parse_price(F.lit("1.234,56 €"))) == 1234.56
    assert tuple(value(spark, measures.parse_shown_unit_price(F.lit("2,49 €/kg")))) == (2.49, "kg")
    assert value(spark, measures.availability(F.lit("https://schema.org/OutOfStock"))) is False
    assert value(spark, measures.reconcile_size(F.lit(0.6), F.lit(0.1), F.lit(True), F.lit(False))) == 0.6
    assert value(spark, measures.effective_size(F.lit(1.0), F.lit(2.0), F.lit(1.001))) == 2.0
    assert value(spark, measures.effective_size(F.lit(1.5), F.lit(2.0), F.lit(1.0))) == 1.5


def test_dates(spark):
    today = datetime.date(2026, 12, 30)
    assert value(spark, measures.promotion_end(F.lit(5), F.lit(1), F.col("d")), d=today) == datetime.date(2027, 1, 5)
    assert value(spark, measures.promotion_end(F.lit(29), F.lit(12), F.col("d")), d=today) == datetime.date(2026, 12, 29)
    assert value(spark, measures.promotion_end(F.lit(31), F.lit(2), F.col("d")), d=today) is None
    assert value(spark, measures.local_day(F.lit("2026-07-01 23:30:00").cast("timestamp"))) == datetime.date(2026, 7, 2)
