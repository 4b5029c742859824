"""The product pages of three stores: a rule table each for elements.page_values(), and one meaning of the values as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.sources.elements import Rule, page_values
from shelfwise.sources.ingest import decode_entities

_BLOCK = (Rule("name", path="name"), Rule("brand", path="brand.name"), Rule("offer", path="offers.price"), Rule("stated", path="offers.availability"))
_CODE = Rule("code", pattern=r"(?i)[?&](?:amp;)?ean=(\d+)")

# Where each store's pages hold a field.
STORES: dict[str, tuple[Rule, ...]] = {
    "continente": (
        *_BLOCK, _CODE,
        Rule("headline", selector=".ct-pdp--prices .pwc-tile--price-primary"), Rule("secondary", selector=".ct-pdp--prices .pwc-tile--price-secondary"),
        Rule("unit", selector=".ct-pdp--unit"), Rule("regular", pattern=r"(?:\"|&quot;)pre_discount_price(?:\"|&quot;)\s*:\s*([\d.]+)"),
    ),
    "pingodoce": (*_BLOCK, _CODE, Rule("headline", selector=".prices .price"), Rule("secondary", selector="h1.product-unit-measure"), Rule("unit", selector="h1.product-unit-measure"), Rule("sold_out", selector=".product-unavailable", take="exists"), Rule("drained", selector="#drained-net-weight", without=("b",))),
    "auchan": (*_BLOCK, Rule("code", path="gtin"), Rule("until", path="offers.priceValidUntil")),
}
#: What a page without a third-party brand is sold under.
OWN_BRAND = {"continente": "Continente"}
NOT_SELLABLE = "(?i)OutOfStock|SoldOut|Discontinued|Indispon"


def per_unit(headline: Column, price: Column) -> Column:
    """kg or l where the price itself is stated for that much; null otherwise and without a price."""
    unit = F.lower(F.regexp_extract(headline, r"(?i)/\s*(kg|lt?)\b", 1))
    return F.when(price.isNotNull() & (unit != ""), F.when(unit == "kg", "kg").otherwise("l"))


def parsed_pages(pages: DataFrame, store: str, key: str, html: str, today: Column) -> DataFrame:
    """One row a page: state (read, no product, no price), name, brand, price, availability, sign, code, size, unit,
    shown_unit_price, shown_unit, on_promotion, regular_price, promotion_ends, drained.

    A store's price is the offer's, but where it shows its price as text only, that text; a text that says null beside
    the sold-out box is a product that is not for sale. A price per kilo makes the size 1. Pages without a product block are not
    read; at two of the stores neither are pages without a price.
    """
    v = page_values(pages, key, html, STORES[store])
    at = lambda name: F.try_element_at("v", F.lit(name))
    offer = at("offer").try_cast("double")
    headline, secondary = F.coalesce(at("headline"), F.lit("")), F.coalesce(at("secondary"), F.lit(""))
    shown = measures.parse_price(headline) if store == "pingodoce" else offer
    null_text = F.coalesce((store == "pingodoce") & shown.isNull() & headline.rlike(r"^null\b") & at("sold_out").isNotNull(), F.lit(False))
    state = F.when(at("found").isNull(), "no product")
    if store != "auchan":
        state = state.when(shown.isNull() & ~null_text, "no price")
    rows = v.select(key, "v", state.otherwise("read").alias("state"), measures.sellable_price(shown).alias("price"), null_text.alias("null_text"))

    price, word = F.col("price"), F.element_at(F.split(F.trim(F.coalesce(at("stated"), F.lit(""))), "/"), -1)
    name = decode_entities(F.coalesce(at("name"), F.lit("")))
    # sizes and figures are columns of their own, so that what reads them does not repeat how they are made
    rows = rows.select("*", per_unit(headline, price).alias("whole"), word.alias("word"), name.alias("name"))
    label = measures.parse_size(F.coalesce(at("unit"), F.lit("")) if store != "auchan" else F.col("name"))
    rows = rows.select("*", label.alias("label"), measures.parse_shown_unit_price(F.when(F.col("whole").isNotNull(), headline).otherwise(secondary)).alias("figures"))
    none = F.lit(None).cast("double")
    rows = rows.select("*", (measures.parse_size(at("drained")) if store == "pingodoce" else F.col("label")).alias("left"), (measures.size_from_unit_price(price, F.col("figures.figure"), F.col("figures.unit")) if store == "continente" else none).alias("derived"))
    word, whole, name = F.col("word"), F.col("whole"), F.col("name")
    if store == "pingodoce":
        availability = F.when(price.isNull(), "not_for_sale").otherwise("for_sale")
        sign = F.when(F.col("null_text"), 'price shown as "null", unavailable box').when(price.isNull(), "price shown as 0,00").otherwise("price shown")
    else:
        availability = F.when(price.isNull(), "not_for_sale").when(word == "", "unknown").when(at("stated").rlike(NOT_SELLABLE), "not_for_sale").when(F.lower(word).isin("instock", "limitedavailability", "onlineonly"), "for_sale").otherwise("unknown")
        sign = F.when(price.isNull(), "no sellable price shown").when(word == "", "page data states no availability").otherwise(F.concat(F.lit("page data: "), F.left(word, F.lit(60))))
    regular = at("regular").try_cast("double")
    ends = F.left(at("until"), F.lit(10)).try_cast("date")
    promoted = F.coalesce(regular > price, F.lit(False)) if store != "auchan" else F.coalesce(ends >= F.date_sub(today, 1), F.lit(False))
    keep = F.col("state") == "read"
    figure, figure_unit = (F.col("figures.figure"), F.col("figures.unit")) if store != "auchan" else (none, F.lit(None).cast("string"))
    columns = {
        "name": name, "brand": F.coalesce(F.nullif(at("brand"), F.lit("")), F.lit(OWN_BRAND.get(store)).cast("string")), "price": price, "availability": availability, "sign": sign, "code": at("code"),
        "size": F.when(whole.isNotNull(), 1.0).otherwise(F.coalesce("label.total", "derived")), "unit": F.when(whole.isNotNull(), whole).when(F.col("label").isNotNull(), F.col("label.unit")).when(F.col("derived").isNotNull(), F.col("figures.unit")),
        "shown_unit_price": figure, "shown_unit": figure_unit, "on_promotion": promoted, "regular_price": F.when(promoted, regular), "promotion_ends": F.when(promoted, ends), "drained": F.col("left.total") if store == "pingodoce" else none,
    }
    return rows.select(key, "state", *(F.when(keep, c).alias(n) for n, c in columns.items()))
