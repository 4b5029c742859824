"""What a row shows: size labels, pack lines, gaps, facts between two views of a row, number lists, house brands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.measures import half_up
from shelfwise.functions.text import plain


def _number(x: Column, digits: int) -> Column:
    """At most so many decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(half_up(x, digits).cast(f"decimal(18,{digits})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def size_label(size: Column, unit: Column) -> Column:
    """'400 g', '1.5 kg', '250 ml', '6 un'; null for no size or another unit."""
    small = lambda u: F.concat(_number(size * 1000, 1), F.lit(f" {u}"))
    large = lambda u: F.concat(_number(size, 3), F.lit(f" {u}"))
    label = F.when(unit == "kg", F.when(size < 1, small("g")).otherwise(large("kg"))).when(unit == "l", F.when(size < 1, small("ml")).otherwise(large("L"))).when(unit == "un", F.concat(half_up(size).cast("long").cast("string"), F.lit(" un")))
    return F.when(size > 0, label)


def pack_line(price: Column, size: Column, unit: Column, compared_in: Column) -> Column:
    """Price and size of the pack; the price alone without a size; null without a price or where the pack is one unit."""
    euros, label = F.format_string("%.2f €", half_up(price, 2)), size_label(size, unit)
    one = (unit == compared_in) & unit.isin("kg", "l") & (F.abs(size - 1) < 1e-9)
    return F.when(price.isNull() | F.coalesce(one, F.lit(False)), None).when(label.isNull(), euros).otherwise(F.concat_ws(" · ", euros, label))


def site_link(url: Column, sites: list[str]) -> Column:
    """The address if it is https on one of the sites, else null."""
    names = "|".join(s.replace(".", r"\.") for s in sites)
    return F.when(url.rlike(rf"^https://(www\.)?({names})/"), url)


def gap_of(prices: Column) -> Column:
    """Dearest over cheapest of the prices above zero, to two decimals; null with fewer than two."""
    known = F.filter(prices, lambda p: p > 0)
    return F.when(F.size(known) >= 2, half_up(F.array_max(known) / F.array_min(known), 2))


def price_facts(item: Column, price: Column, size: Column, promotion: Column, item_before: Column, price_before: Column, promotion_before: Column) -> Column:
    """struct<per_unit, change_percent, promotion>: what is to be said of a store's entry, given its entry in the view before.

    Another item before tells nothing. promotion: started, ended, on, off or unknown.
    """
    same = F.coalesce(item == item_before, F.lit(False))
    per_unit = F.when((size > 0) & price.isNotNull(), half_up(price / size, 2))
    change = F.when(same & (price_before > 0) & price.isNotNull(), half_up((price - price_before) / price_before * 100, 1))
    moved = same & ~promotion.eqNullSafe(promotion_before)
    state = F.when(promotion.isNull(), "unknown").when(moved, F.when(promotion, "started").otherwise("ended")).otherwise(F.when(promotion, "on").otherwise("off"))
    return F.struct(per_unit.alias("per_unit"), change.alias("change_percent"), state.alias("promotion"))


def proposal_numbers(text: Column, widest: int = 5000) -> Column:
    """'1-3,7' as [1, 2, 3, 7]; null if any part is no number and no ascending range of at most that width."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("long")
    high = lambda p: F.when(p.contains("-"), F.regexp_extract(p, r"(\d+)$", 1).cast("long")).otherwise(low(p))
    ok = F.forall(parts, lambda p: p.rlike(r"^\d{1,12}(-\d{1,12})?$") & F.coalesce((high(p) >= low(p)) & (high(p) - low(p) <= widest), F.lit(False)))
    return F.when(ok, F.flatten(F.transform(F.when(ok, parts), lambda p: F.sequence(low(p), high(p)))))


def house_brand(brand: Column, house: str, labels: list[str], ours: str) -> Column:
    """A store's brand names: none, one of its labels, and names of the pattern `ours` are the house brand."""
    own = F.trim(F.coalesce(brand, F.lit("")))
    return F.when((own == "") | F.lower(own).isin(labels) | own.rlike(ours), F.lit(house)).otherwise(own)


def includes(name: Column, wanted: list[str], unwanted: str) -> Column:
    """Whether a name, plain, fits all of the wanted patterns and not the unwanted one (tinned fish, tinned food)."""
    flat = plain(name)
    ok = ~flat.rlike(unwanted)
    for pattern in wanted:
        ok = ok & flat.rlike(pattern)
    return F.coalesce(ok, F.lit(False))


def shown_quantity(quantity: Column) -> Column:
    """Quantity 0 is shown and priced as 1."""
    return F.when(quantity == 0, 1).otherwise(quantity)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def collation_key(label: Column) -> Column:
    """Sort key of labels by letters without accents and case; the label itself settles ties."""
    return F.struct(plain(label).alias("plain"), label.alias("label"))
