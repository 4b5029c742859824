"""Queries of the page and tile parsers over pages made of parts around the driver's own markup, each with its SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans.catalog import table
from shelfwise.plans.queries import query
from shelfwise.sources import elements, parsers


def _around(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the markup of a page, in which their product is shown: unclosed elements, scripts and all."""
    pages = table(spark, sf, "pages").select((F.col("page_id") % 500).alias("slot"), "html").groupBy("slot").agg(F.min("html").alias("filler"))
    # parts are a few files' splits, and a page costs far more to read than its part: they are dealt to all tasks
    dealt = table(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.withColumn("slot", F.col("p_partkey") % 500).join(pages, "slot", "left").withColumn("filler", F.coalesce("filler", F.lit("")))


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


@dataclass(frozen=True)
class Shown:
    """What the made pages show of a part, as columns: cents with a dot in data and with a comma in text."""

    key: Column = field(default_factory=lambda: F.col("p_partkey"))
    dot: Column = field(default_factory=lambda: F.concat(F.floor(_cents() / 100).cast("string"), F.lit("."), F.lpad((_cents() % 100).cast("string"), 2, "0")))

    @property
    def comma(self) -> Column:
        return F.replace(self.dot, F.lit("."), F.lit(","))

    @property
    def grams(self) -> Column:
        return (self.key % 900 + 100).cast("string")

    @property
    def word(self) -> Column:
        return F.when(self.key % 7 == 0, "OutOfStock").when(self.key % 7 == 1, "PreOrder").otherwise("InStock")


def _cents() -> Column:
    return F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")


_LD = '<script type="application/ld+json">{ broken</script><script type="application/ld+json">[{"@type":"BreadcrumbList"},{"@graph":[{"@type":"Product","name":"{name}","brand":{"name":"{brand}"},"offers":{"price":{price},"availability":"https://schema.org/{word}"{more}}{gtin}}]}]</script>'
_OTHERS = '<div class="carousel"><div class="price">9,99 €</div><span class="pwc-tile--price-primary">8,88€/kg</span></div>'


def _page(p: DataFrame, inside: str, ld: str = _LD, **values: Column) -> DataFrame:
    c = Shown()
    no_product = F.when(c.key % 29 == 0, F.lit("")).otherwise(F.lit(ld))
    base = dict(name=F.concat("p_name", F.lit(" &amp; co")), brand=F.when(c.key % 4 == 0, "").otherwise(F.col("p_brand")), price=F.when(c.key % 13 == 0, F.lit("0")).otherwise(c.dot), word=c.word, grams=c.grams, comma=c.comma, key=c.key.cast("string"))
    html = F.concat(F.lit("<!DOCTYPE html><html><body>" + _OTHERS), "filler", _fill("{ld}" + inside, ld=no_product, **(base | values)), F.lit("</body></html>"))
    return p.select("p_partkey", html.alias("html"))


_BASE = """b as (select p_partkey, p_name || ' & co' as name, floor(p_retailprice * 100 + 0.5)::bigint as cents, p_brand, p_partkey % 29 = 0 as missing, case when p_partkey % 13 <> 0 then floor(p_retailprice * 100 + 0.5) / 100 end as price,
  case when p_partkey % 7 = 0 then 'OutOfStock' when p_partkey % 7 = 1 then 'PreOrder' else 'InStock' end as word, p_partkey % 900 + 100 as grams from part)"""
_STATED = """case when price is null then 'not_for_sale' when word = 'OutOfStock' then 'not_for_sale' when word = 'InStock' then 'for_sale' else 'unknown' end as availability, case when price is null then 'no sellable price shown' else 'page data: ' || word end as sign"""


@query(f"""with {_BASE}, s as (select *, {_STATED} from b)
  select p_partkey, case when missing then 'no product' else 'read' end as state, case when not missing then name end as name, case when not missing then case when p_partkey % 4 = 0 then 'Continente' else p_brand end end as brand, case when not missing then price end as price,
    case when not missing then availability end as availability, case when not missing then sign end as sign, case when not missing then '56' || p_partkey end as code, case when not missing then case when p_partkey % 3 = 0 and price is not null then 1.0 else grams / 1000.0 end end::double as size, case when not missing then 'kg' end as unit,
    case when not missing then case when p_partkey % 3 = 0 and price is not null then cents / 100 else 7.25 end end::double as shown_unit_price, case when not missing then coalesce(not (p_partkey % 13 = 0) and p_partkey % 5 = 0, false) end as on_promotion, case when not missing and price is not null and p_partkey % 5 = 0 then 99999.5::double end as regular_price from s""")
def pages_of_store_a(spark: SparkSession, sf: str) -> DataFrame:
    """Product block, price box among other prices, escaped code, size label or price per kilo, price before a discount."""
    c = Shown()
    inside = '<div class="x ct-pdp--prices"><p><span class="pwc-tile--price-primary">{comma}€{per}</span><div><b class="pwc-tile--price-secondary">7,25€/kg</b></div></div><span class="ct-pdp--unit">Emb. {grams} g</span><a href="/n?pid=1&amp;ean=56{key}">n</a><i data-x="{&quot;pre_discount_price&quot;: {was}}"></i>'
    per = F.when(c.key % 3 == 0, "/kg").otherwise("")
    was = F.when(c.key % 5 == 0, "99999.5").otherwise("0.5")
    pages = _page(_around(spark, sf), inside, more=F.lit(""), gtin=F.lit(""), per=per, was=was)
    out = parsers.parsed_pages(pages, "continente", "p_partkey", "html", F.to_date(F.lit("2024-06-01")))
    return out.select("p_partkey", "state", "name", "brand", "price", "availability", "sign", "code", "size", "unit", "shown_unit_price", "on_promotion", "regular_price")


@query(f"""with {_BASE}, s as (select *, p_partkey % 13 = 0 as zero, p_partkey % 11 = 0 as nul, p_partkey % 22 = 0 as boxed from b),
  t as (select *, case when missing then 'no product' when nul and not boxed then 'no price' else 'read' end as state, case when not nul and not zero then cents / 100 end as p from s)
  select p_partkey, state, case when state = 'read' then name end as name, case when state = 'read' then p end as price, case when state = 'read' then case when p is null then 'not_for_sale' else 'for_sale' end end as availability,
    case when state = 'read' then case when nul then 'price shown as "null", unavailable box' when p is null then 'price shown as 0,00' else 'price shown' end end as sign,
    case when state = 'read' then case when p_partkey % 3 = 0 and p is not null then 1.0 else grams / 1000.0 end end::double as size, case when state = 'read' then case when p_partkey % 3 = 0 and p is not null then p else 13.9 end end::double as shown_unit_price, case when state = 'read' then (grams - 50) / 1000.0 end::double as drained from t""")
def pages_of_store_b(spark: SparkSession, sf: str) -> DataFrame:
    """Price as text (zero, null with or without the sold-out box), size and unit price in one label, drained weight beside a bold word."""
    c = Shown()
    inside = '<div class="prices"><span class="price">\n {text}{per} </span></div>{box}<h1 class="product-unit-measure">{kg} Kg | 13,9 €/Kg</h1><div id="drained-net-weight"><b>Peso 1 kg</b> {drained} g</div>'
    nul = c.key % 11 == 0
    text = F.when(nul, "null").when(c.key % 13 == 0, "0,00 €").otherwise(F.concat(c.comma, F.lit(" €")))
    kg = F.concat(F.lit("0."), F.lpad(c.grams, 3, "0"))
    pages = _page(_around(spark, sf), inside, more=F.lit(""), gtin=F.lit(""), text=text, per=F.when(c.key % 3 == 0, "/Kg").otherwise(""), box=F.when(c.key % 22 == 0, '<p class="a product-unavailable">x').otherwise(""), kg=kg, drained=(c.key % 900 + 50).cast("string"))
    out = parsers.parsed_pages(pages, "pingodoce", "p_partkey", "html", F.to_date(F.lit("2024-06-01")))
    return out.select("p_partkey", "state", "name", "price", "availability", "sign", "size", "shown_unit_price", "drained")


@query(f"""with {_BASE}, s as (select *, {_STATED} from b), t as (select *, case when p_partkey % 6 > 3 then make_date(2024, 5 + p_partkey % 6 - 3, 15) when p_partkey % 6 = 0 then null else make_date(2024, 5, 28 + p_partkey % 6) end as until from s)
  select p_partkey, case when missing then 'no product' else 'read' end as state, case when not missing then price end as price, case when not missing then availability end as availability, case when not missing then sign end as sign, case when not missing and p_partkey % 5 > 0 then '789' || p_partkey end as code,
    case when not missing then 2 * grams / 1000.0 end::double as size, case when not missing then coalesce(until >= date '2024-05-31', false) end as on_promotion, case when not missing and until >= date '2024-05-31' then until end as promotion_ends from t""")
def pages_of_store_c(spark: SparkSession, sf: str) -> DataFrame:
    """All fields from the product block, size from the name, no price as not for sale, promotions that have not ended."""
    c = Shown()
    until = F.when(c.key % 6 > 3, F.concat(F.lit(',"priceValidUntil":"2024-0'), (c.key % 6 + 2).cast("string"), F.lit('-15T00:00:00Z"'))).when(c.key % 6 == 0, ',"priceValidUntil":"soon"').otherwise(F.concat(F.lit(',"priceValidUntil":"2024-05-'), (c.key % 6 + 28).cast("string"), F.lit('"')))
    gtin = F.when(c.key % 5 > 0, F.concat(F.lit(',"gtin":"789'), c.key.cast("string"), F.lit('"'))).otherwise(F.lit(""))
    pages = _page(_around(spark, sf), "<p>end", name=F.concat("p_name", F.lit(" 2X"), c.grams, F.lit("G")), price=F.when(c.key % 13 == 0, "null").otherwise(c.dot), more=until, gtin=gtin)
    out = parsers.parsed_pages(pages, "auchan", "p_partkey", "html", F.to_date(F.lit("2024-06-01")))
    return out.select("p_partkey", "state", "price", "availability", "sign", "code", "size", "on_promotion", "promotion_ends")


@query("""with p as (select p_partkey, p_partkey // 20 as page, p_partkey % 20 as i, p_name, p_brand, p_type, floor(p_retailprice * 100 + 0.5) / 100 as price from part),
  s as (select *, case when i = 3 then 'malformed' when i = 5 then 'several' when i = 7 then 'incomplete' when i = 9 then 'repeated' when i = 11 then 'unlinked' else 'ok' end as state from p)
  select page, i::int as place, state, case when state in ('ok', 'unlinked', 'incomplete') then p_partkey::varchar when state = 'repeated' then (p_partkey - 1)::varchar end as id, case when state in ('ok', 'unlinked', 'repeated') then p_name || ' {"}" \\ & }{' end as name, case when state in ('ok', 'unlinked', 'repeated', 'incomplete') then price end as price,
    case when state in ('ok', 'unlinked', 'repeated', 'incomplete') then p_type || '/food' end as category, case when state in ('ok', 'incomplete') then '/x/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.html?a=1' when state = 'repeated' then '/x/' || string_split((select q.p_name from p q where q.p_partkey = s.p_partkey - 1), ' ')[1] || '-' || string_split((select q.p_name from p q where q.p_partkey = s.p_partkey - 1), ' ')[2] || '-' || (p_partkey - 1) || '.html?a=1' end as url from s
  union all select page, count(*)::int, 'malformed', null, null, null, null, null from p where page % 3 = 0 group by page""")
def embedded_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of pages of twenty parts, by brace matching that knows strings and escapes; every tile is accounted for."""
    c = Shown()
    i, raw = c.key % 20, F.concat("p_name", F.lit(' {"}" \\ & }{'))
    name = F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    id_ = F.when(i == 9, c.key - 1).otherwise(c.key)
    item = F.concat(F.lit('{"item_id":"'), id_.cast("string"), F.lit('","item_name":"'), F.when(i == 7, F.lit("")).otherwise(name), F.lit('","price":'), c.dot, F.lit(',"item_brand":"'), F.col("p_brand"), F.lit('","item_category":"food","item_category2":"'), F.col("p_type"), F.lit('"}'))
    body = F.when(i == 3, F.concat(F.lit('{"items":[oops '), item, F.lit("]}"))).when(i == 5, F.concat(F.lit('{"items":['), item, F.lit(","), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"a":{"b":{}},"items":['), item, F.lit("]}")))
    encoded = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    link = F.when(i == 11, F.lit("")).otherwise(F.concat(F.lit('<a href="/x/'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), c.key.cast("string"), F.lit('.html?a=1">x</a>')))
    tile = F.concat(F.lit('<div data-gtm-info="x" data-gtm-info="'), encoded, F.lit('">'), link, F.lit("</div>"))
    grid = _around(spark, sf).groupBy(F.floor(c.key / 20).alias("page")).agg(F.min("filler").alias("filler"), F.sort_array(F.collect_list(F.struct(c.key.alias("k"), tile.alias("t")))).alias("tiles"))
    tail = F.when(F.col("page") % 3 == 0, F.lit('<div data-gtm-info="{&quot;items&quot;:[{&quot;a&quot;:&quot;}&quot;')).otherwise(F.lit(""))
    html = F.concat("filler", F.array_join(F.transform("tiles", lambda x: x["t"]), ""), tail)
    found = elements.embedded_tiles(grid.select("page", html.alias("html")), "page", "html")
    return found.select("page", "place", "state", "id", F.nullif("name", F.lit("")).alias("name"), "price", "category", "url")
