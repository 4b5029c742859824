"""Prices, sizes and unit prices. Money is compared in whole cents; a size is (total, unit, pack_count), null if unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import plain

#: Prices up to this stand for "no price".
PLACEHOLDER = 0.01
#: Largest pack of one thing: kg and l.
MOST_KG, MOST_L = 30.0, 10.0
NUMBER = r"(\d+(?:[.,]\d+)?)"
UNITS = r"(kg|kilos?|quilos?|grs?|g|mg|lts?|litros?|l|dl|cl|ml|unidades|unid|uni|un)"


def bound(value: Column, read) -> Column:
    """read(value) with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), read), 0)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half up, as price labels do (Spark's round() is half up on decimals only)."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def cents(price: Column) -> Column:
    """Whole cents, null for null and non-finite prices."""
    return F.when(F.isnan(price) | (F.abs(price) > 1e15), None).otherwise(F.floor(price * 100 + 0.5).cast("long"))


def sellable_price(price: Column) -> Column:
    """Finite and above the placeholder, else null."""
    return F.when(F.isnan(price) | (price <= PLACEHOLDER) | (price > 1e15), None).otherwise(price)


def for_sale(price: Column, available: Column) -> Column:
    """Price while available; not for sale means no price. Unknown availability keeps it."""
    return F.when(F.coalesce(available, F.lit(True)), sellable_price(price))


def unit_price(price: Column, size: Column) -> Column:
    """Per unit of size; the price itself where no size is known."""
    return F.when(size > 0, price / size).otherwise(price)


# How names and pages write goods sold by weight, prices and unit prices.
SOLD_PER_KG = r"(?i)(\bkg\b\s*$)|(\d\s*(?:kg|g)?\s+a\s+\d+(?:[.,]\d+)?\s*kg\s*\)?\s*$)|\bgranel\b|\bao\s+quilo\b|\bpor\s+kg\b"
SHOWN_FIGURE = r"(?i)(\d[\d.]*,\d{1,2}|\d+(?:\.\d+)?)\s*€\s*/\s*(kg|lt?|un)\b"
PRICE_TEXT = r"(?i)(\d[\d.]*,\d{1,2}|\d+(?:\.\d+)?)\s*€\s*(?:/\s*(kg|lt?)\b)?"


def price_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller; null if either is missing or not positive."""
    return F.when((F.least(a, b) > 0) & a.isNotNull() & b.isNotNull(), F.greatest(a, b) / F.least(a, b))


def sizes_match(size_a: Column, unit_a: Column, size_b: Column, unit_b: Column, tolerance: float = 0.05) -> Column:
    """Same unit, and differing by at most that share of the larger."""
    hi = F.greatest(size_a, size_b)
    return F.coalesce((unit_a == unit_b) & (hi > 0) & ((hi - F.least(size_a, size_b)) / hi <= tolerance), F.lit(False))


def same_weight(a: Column, b: Column) -> Column:
    """Equal within two grams or two per cent (weights in kg)."""
    return F.abs(a - b) <= F.greatest(F.lit(0.002), 0.02 * F.greatest(a, b))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def _in_base(value: Column, unit: Column) -> tuple[Column, Column]:
    """(value in kg, l or un; that unit)."""
    u = F.lower(unit)
    factor = F.when(u.rlike("^(kg|kilo|quilo)"), 1.0).when(u == "mg", 1e-6).when(u.rlike("^g"), 0.001).when(u == "ml", 0.001).when(u == "cl", 0.01).when(u == "dl", 0.1).otherwise(1.0)
    base = F.when(u.rlike("^(kg|kilo|quilo|mg|g)"), "kg").when(u.rlike("^un"), "un").otherwise("l")
    return value * factor, base


def parse_size(name: Column) -> Column:
    """Size in a product name: struct<total double, unit string, pack_count int>; null where it is unclear.

    In this order: a range (500 a 700 g, 1-2 kg) or an alternative (200g/300g) is unclear; the drained weight in
    brackets is left out; a dot before three digits groups thousands; [n x] quantity unit is read, first match; an
    amount added (+ 100 g) is summed; under one centilitre and over 30 kg or 10 l a thing is refused.
    """
    text = F.lower(F.regexp_replace(name, r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)\bn\s?[º°]\s?\d+", " ")
    text = F.regexp_replace(text, r"\((?:[^()]*(?:escorrid|drained|liq)[^()]*)\)", " ")
    text = F.regexp_replace(text, r"(\d)\.(\d{3})(?=\s*(?:g|ml|gr)\b)", "$1$2")
    return bound(text, _size_in)


def _size_in(text: Column) -> Column:
    """The size in a prepared name, see parse_size(). What the patterns find is bound before it is read, and so are the figures."""
    unclear = text.rlike(rf"{NUMBER}\s*(?:{UNITS})?\s*(?:a|até|-|ou)\s*{NUMBER}\s*{UNITS}\b") | text.rlike(rf"{NUMBER}\s*{UNITS}\s*/\s*{NUMBER}\s*{UNITS}\b") | text.rlike(r"\bmin\.?\s*\d|\bmax\.?\s*\d")
    pattern, plus = rf"(?:(\d+)\s*(?:x|\*)\s*)?{NUMBER}\s*{UNITS}\b", rf"\+\s*{NUMBER}\s*{UNITS}\b"
    at = lambda p, i, name: F.regexp_extract(text, p, i).alias(name)
    found = F.struct(unclear.alias("unclear"), at(pattern, 1, "packs"), at(pattern, 2, "each"), at(pattern, 3, "unit"), at(plus, 1, "added"), at(plus, 2, "added_unit"))

    def figures(f: Column) -> Column:
        each, unit = _in_base(_number(f["each"]), f["unit"])
        added, added_unit = _in_base(_number(f["added"]), f["added_unit"])
        packs = F.coalesce(f["packs"].try_cast("int"), F.lit(1))
        return F.struct((f["unclear"] | (f["unit"] == "")).alias("refused"), packs.alias("packs"), each.alias("each"), unit.alias("unit"), added.alias("added"), added_unit.alias("added_unit"))

    def size(f: Column) -> Column:
        packs, each, unit = f["packs"], f["each"], f["unit"]
        total = packs * each + F.when(f["added_unit"] == unit, F.coalesce(f["added"], F.lit(0.0))).otherwise(0.0)
        refused = f["refused"] | (each <= 0) | ((unit == "l") & (each < 0.01)) | ((unit == "kg") & (each > MOST_KG)) | ((unit == "l") & (each > MOST_L))
        return F.when(~refused & total.isNotNull(), F.struct(F.round(total, 6).alias("total"), unit.alias("unit"), packs.alias("pack_count")))

    return bound(bound(found, figures), size)


def sold_loose(name: Column) -> Column:
    """Sold by weight: a name that ends in kg or in a range of weights, or says so."""
    return F.rlike(name, F.lit(SOLD_PER_KG))


def _figure(text: Column) -> Column:
    """1.234,56 or 8.6 as a number: with a comma, dots only group."""
    return F.when(text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text).try_cast("double")


def parse_shown_unit_price(text: Column) -> Column:
    """struct<figure double, unit string> of a label such as 2,49 €/kg, 8.6 €/Kg or 6,65€/lt; null without a figure above 0."""
    figure = _figure(F.regexp_extract(text, SHOWN_FIGURE, 1))
    unit = F.lower(F.regexp_extract(text, SHOWN_FIGURE, 2))
    return F.when(figure > 0, F.struct(figure.alias("figure"), F.when(unit.isin("kg", "un"), unit).otherwise("l").alias("unit")))


def priced_per_unit(text: Column, price: Column) -> Column:
    """kg or l where the price text's first figure is the price and is stated for that much; null otherwise."""
    unit = F.lower(F.regexp_extract(text, PRICE_TEXT, 2))
    return F.when((F.abs(_figure(F.regexp_extract(text, PRICE_TEXT, 1)) - price) <= 0.005) & (unit != ""), F.when(unit == "kg", "kg").otherwise("l"))


def implausible_pods(name: Column, total: Column, unit: Column) -> Column:
    """Capsules whose page size is a count read as a quantity: any size in litres, or a kilogram and more."""
    return plain(name).rlike(r"\b(capsula|pastilha)s?\b") & ((unit == "l") | (total >= 1))


def corrected_size(name: Column, total: Column, unit: Column, per_unit: Column) -> Column:
    """struct<total double, unit string>: 1 where the price is per unit; null where the label is a count; else the label."""
    return F.when(per_unit.isNotNull(), F.struct(F.lit(1.0).alias("total"), per_unit.alias("unit"))).when(total.isNotNull() & ~F.coalesce(implausible_pods(name, total, unit), F.lit(False)), F.struct(total.cast("double").alias("total"), unit.alias("unit")))


def size_from_unit_price(price: Column, figure: Column, unit: Column) -> Column:
    """The size with the fewest significant digits (at most three) whose unit price may round to the figure shown.

    With none inside the rounding, three digits. Only per kg and l; null beyond what one container holds.
    """
    size, low = price / figure, price / (figure + 0.005)
    high = F.when(figure > 0.005, price / (figure - 0.005)).otherwise(float("inf"))
    digits = lambda n: F.floor(size * (scale := F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(size)))) + 0.5) / scale
    total = F.coalesce(*(F.when((digits(n) >= low) & (digits(n) <= high), digits(n)) for n in (1, 2, 3)), digits(3))
    known = F.when((price > 0) & (figure > 0) & unit.isin("kg", "l"), total)
    return F.get(F.transform(F.array(known), lambda t: F.when((t >= F.when(unit == "kg", 0.001).otherwise(0.01)) & (t <= F.when(unit == "kg", MOST_KG).otherwise(MOST_L)), t)), 0)


def struck_promotion(struck: Column, price: Column) -> Column:
    """struct<on_promotion boolean, regular_price double>: a crossed-out price above today's is a promotion, else none."""
    before = _number(F.regexp_extract(struck, r"(\d+(?:[.,]\d+)?)", 1))
    on = F.coalesce(before > price, F.lit(False))
    return F.struct(on.alias("on_promotion"), F.when(on, before).alias("regular_price"))


def reconcile_size(tile: Column, name: Column, multipack: Column, tin: Column) -> Column:
    """A listing's figure against the name's: within 10 % the name; 2 to 9 times with multipack words, or a tin at 0.4 to 0.9, the figure; else null."""
    ratio = tile / name
    return F.when(name.isNull(), tile).when(tile.isNull(), name).when(F.abs(ratio - 1) <= 0.1, name).when(multipack & (ratio >= 2) & (ratio <= 9.5), tile).when(tin & (ratio >= 0.4) & (ratio <= 0.9), tile)


def count_from_name(name: Column, words: str) -> Column:
    """Number of pieces named (12 ovos, 6 unidades)."""
    return F.regexp_extract(F.lower(name), rf"(\d+)\s*(?:{words})", 1).try_cast("int")


def count_from_unit_price(price: Column, figure: Column, most: int, common: tuple[int, ...]) -> Column:
    """The only count whose price per piece rounds to the figure; if several do, the only common one."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda c: F.abs(price / c - figure) <= 0.005)
    usual = F.filter(fits, lambda c: c.isin(list(common)))
    return F.when(F.size(fits) == 1, F.get(fits, 0)).when(F.size(usual) == 1, F.get(usual, 0))


def effective_size(stored: Column, override: Column, override_basis: Column, tolerance: float = 0.01) -> Column:
    """A confirmed size replaces the stored one only while what it was confirmed on still holds."""
    holds = F.abs(stored - override_basis) <= tolerance * override_basis
    return F.when(override.isNotNull() & F.coalesce(holds, stored.isNull() & override_basis.isNull()), override).otherwise(stored)


def override_status(stored: Column, basis: Column, tolerance: float = 0.005) -> Column:
    return F.when(stored.isNull(), "gone").when(F.abs(stored - basis) <= tolerance * F.abs(basis), "unchanged").otherwise("changed")


def promotion_shown(price: Column, regular: Column, ends: Column, today: Column) -> Column:
    """struct<regular double, ends date>: null once ended; the regular price only if above the price."""
    return F.when(~F.coalesce(ends < today, F.lit(False)), F.struct(F.when(regular > price, regular).alias("regular"), ends.alias("ends")))


def promotion_end(day: Column, month: Column, today: Column) -> Column:
    """The next date with that day and month, one day's grace; null for a date that does not exist."""
    at = lambda y: F.expr("try_cast(NULL as date)") if y is None else F.to_date(F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))
    valid = (month >= 1) & (month <= 12) & (day >= 1) & (day <= F.when(month == 2, 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31))
    this = F.when(valid, at(F.year(today).cast("string")))
    after = F.when(valid, at((F.year(today) + 1).cast("string")))
    return F.when(this >= F.date_sub(today, 1), this).otherwise(after)


def parse_price(text: Column) -> Column:
    """1.234,56 € as a number: the first figure with decimals after a comma; dots group."""
    return _figure(F.regexp_extract(text, r"([\d.]*\d,\d{1,2})", 1))


def availability(word: Column) -> Column:
    """Stated availability as true, false or null (not stated)."""
    w = F.lower(word)
    return F.when(w.rlike("outofstock|soldout|discontinued|indispon"), False).when(w.rlike("instock|limitedavailability|onlineonly|dispon"), True)


def local_day(ts: Column, zone: str = "Europe/Lisbon") -> Column:
    """Calendar day of a UTC time where the stores are."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def meaningful_shortfall(missing: Column, expected: Column) -> Column:
    """More than five, and more than one per cent."""
    return (missing > 5) & (missing > 0.01 * expected)
