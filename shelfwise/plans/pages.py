"""Queries of the page, walk, backfill and donor operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.operators import pages
from shelfwise.operators.rules import Rule
from shelfwise.plans.catalog import LISTINGS, listings, table
from shelfwise.plans.queries import query


@query("""with p as (select p_partkey, case p_partkey % 10 when 0 then 404 when 1 then 410 when 2 then 503 when 3 then null else 200 end as status, case when p_partkey % 10 <> 4 then p_name end as name, case when p_partkey % 7 > 1 then p_type when p_partkey % 7 = 1 then p_brand end as shelf from part),
  r as (select *, coalesce(status in (404, 410), false) or coalesce(status < 400 and name is null, false) as dead from p)
  select p_partkey, case when dead then 'dead' when status is null or status >= 400 or shelf is null then 'unreachable' when string_split(shelf, ' ')[1] in ('STANDARD', 'PROMO', 'JUMBO') then 'kept' else 'other' end as route, shelf, string_split(shelf, ' ')[1] as section from r""")
def page_routes(spark: SparkSession, sf: str) -> DataFrame:
    """H3 H4 H5: where each fetched page goes, with its top section; some pages name no shelf and take their target's."""
    key = F.col("p_partkey")
    status = F.when(key % 10 == 0, 404).when(key % 10 == 1, 410).when(key % 10 == 2, 503).when(key % 10 == 3, F.lit(None)).otherwise(200)
    name, shelf, target = F.when(key % 10 != 4, F.col("p_name")), F.when(key % 7 > 1, F.col("p_type")), F.when(key % 7 == 1, F.col("p_brand"))
    top = lambda s: F.split(s, " ")[0]
    rows = table(spark, sf, "part").withColumn("r", pages.route_page(status, name, shelf, target, lambda s, n: top(s).isin("STANDARD", "PROMO", "JUMBO")))
    return rows.select("p_partkey", "r.route", "r.shelf", top(F.col("r.shelf")).alias("section"))


@query("""with g as (select o_orderpriority as walk, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as page, case when o_orderpriority <> '1-URGENT' or o_orderdate < '1995-03-01' then o_custkey end as item from orders),
  p as (select distinct walk, page, case walk when '2-HIGH' then 900 when '3-MEDIUM' then 100000 end as published from g),
  s as (select walk, page, count(*) as n_tiles from g where item is not null group by 1, 2), f as (select walk, page, count(*) as fresh from (select walk, item, min(page) as page from g where item is not null group by 1, 2) group by 1, 2),
  j as (select walk, page, published, coalesce(n_tiles, 0) as n_tiles, coalesce(fresh, 0) as fresh from p left join s using (walk, page) left join f using (walk, page)),
  t as (select *, case when n_tiles = 0 then 'empty' when fresh = 0 then 'wrapped' when (page + 1) * 30 >= published then 'complete' when published is null and n_tiles < 30 then 'short' end as stop from j),
  w as (select *, count(stop) over (partition by walk order by page rows between unbounded preceding and 1 preceding) as ended, sum(fresh) over (partition by walk order by page) as collected from t)
  select walk, page::bigint as page, n_tiles, fresh, collected::bigint as collected, stop from w where ended = 0""")
def walked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each walk until an empty, repeated, last or short one. A page is a month of orders, an item a customer."""
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("long")
    item = F.when((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_orderdate") < F.lit("1995-03-01").cast("date")), F.col("o_custkey"))
    tiles = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("walk"), month.alias("page"), item.alias("item"))
    known = tiles.select("walk", "page").distinct().withColumn("published", F.when(F.col("walk") == "2-HIGH", 900).when(F.col("walk") == "3-MEDIUM", 100000))
    return pages.walk_stops(known, tiles, "walk", "page", "item", "published", 30)


@query("""with n as (select *, case p_size % 4 when 0 then round(p_size * 100::double * 0.001, 6) end as named, p_size % 4 = 1 as loose, case p_partkey % 4 when 1 then round(p_size * 100::double * 0.001, 6) when 2 then round(p_size * 105::double * 0.001, 6) when 3 then 1.0::double end as stored, case when p_partkey % 4 > 0 then 'kg' end as unit, case when p_partkey % 6 = 0 or p_partkey % 9 = 1 then 'listing' end as source, p_partkey % 5 = 0 as page_read, p_brand like '%3' as per_item, case when p_size > 25 then p_size end as pieces, p_retailprice > 1400 as implausible from part),
  d as (select *, case when named is null then stored when abs(stored / named - 1) <= 0.1 then named end as decided from n),
  v as (select *, case when per_item then case when pieces is not null then 'count' else 'kept' end
    when stored is null then case when source = 'listing' then 'kept' when named is not null then 'name' when loose then 'loose' else 'kept' end
    when source = 'listing' then case when decided = stored then 'kept' when decided is not null then 'listing' else case when named is not null then 'name' else 'cleared' end end
    when page_read then case when implausible then 'cleared' else 'kept' end
    when named = stored then 'kept' when named is not null then 'name' when loose then 'loose' else 'cleared' end as via from d)
  select p_partkey, case via when 'count' then pieces::double when 'kept' then stored when 'listing' then decided when 'name' then named when 'loose' then 1.0::double end as size, case via when 'count' then 'un' when 'kept' then unit when 'listing' then unit when 'name' then 'kg' when 'loose' then 'kg' end as unit, case when not per_item and stored is not null and source = 'listing' and via in ('name', 'cleared') then null else source end as source, via from v""")
def sizes_backfilled(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes settled again by their provenance. Names state grams, loose sale or nothing."""
    size, key = F.col("p_size"), F.col("p_partkey")
    grams = F.concat(F.lit(" "), (size * 100).cast("string"), F.lit(" g"))
    name = F.concat("p_name", F.when(size % 4 == 0, grams).when(size % 4 == 1, F.lit(" kg")).otherwise(F.lit("")))
    stored = F.when(key % 4 == 1, F.round((size * 100).cast("double") * 0.001, 6)).when(key % 4 == 2, F.round((size * 105).cast("double") * 0.001, 6)).when(key % 4 == 3, 1.0)
    source = F.when((key % 6 == 0) | (key % 9 == 1), "listing")
    got = pages.backfilled_size(F.col("parsed"), F.col("loose"), stored, F.when(key % 4 > 0, "kg"), source, key % 5 == 0, F.col("p_brand").endswith("3"), F.when(size > 25, size), F.lit(False), F.lit(False), F.col("p_retailprice") > 1400)
    read = table(spark, sf, "part").withColumns({"parsed": measures.parse_size(name), "loose": measures.sold_loose(name)})
    return read.select("p_partkey", got.alias("s")).select("p_partkey", "s.*")


@query(f"""with {LISTINGS}, i as (select store || '/' || product_id as id, store, product_id, kind, unit, case when product_id % 3 <> 0 or store < 'ASIA' then size end as weight, case when product_id % 2 = 0 then product_id // 4 end as code, sub_kind || '/' || kind as same from listings),
  m as (select w.id, 0 as rank, d.id as donor, d.weight, 'code' as via from i w join i d on w.code = d.code and w.unit = d.unit and w.store <> d.store where w.weight is null and d.weight is not null
    union all select w.id, 1, d.id, d.weight, 'same' from i w join i d on w.same = d.same and w.unit = d.unit and w.store <> d.store where w.weight is null and d.weight is not null)
  select id, weight, donor, via from m qualify row_number() over (partition by id order by rank, donor, weight) = 1""")
def donor_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights that a listing lacks, from another store's by its number, else by the same product, in the same unit."""
    x = listings(spark, sf)
    weight = F.when((F.col("product_id") % 3 != 0) | (F.col("store") < "ASIA"), F.col("size"))
    code = F.when(F.col("product_id") % 2 == 0, F.floor(F.col("product_id") / 4))
    items = x.select(F.concat_ws("/", "store", F.col("product_id").cast("string")).alias("id"), "store", "unit", weight.alias("weight"), code.alias("code"), F.concat_ws("/", "sub_kind", "kind").alias("same"))
    return pages.donor_values(items, "id", "store", ["code", "same"], ["unit"], "weight")


@query("""select p_type as kind, case when p_size % 3 > 0 then p_brand end as labels, count(*) as n_rows, ceil(count(*) / 5)::bigint as n_writes from part group by 1, 2""")
def grouped_writes(spark: SparkSession, sf: str) -> DataFrame:
    """K7: changes that write the same values, null equal to null, as writes of five rows."""
    changes = table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("labels"))
    return pages.grouped_writes(changes, ["kind", "labels"], 5)


GUESSES = [Rule("warm", ("hot",)), Rule("fixings", ("bolt", "rod")), Rule("round", ("ring", "gear", "plate"))]


@query("""with w as (select p_partkey, string_split(p_name, ' ')[1] as head, string_split(trim(regexp_replace(p_name, '\\b(?:plate|gizmo)\\b.*$', '')), ' ') as words from part), k as (select p_partkey, list_transform(list_concat([head], words), lambda x: case when x = 'hot' then 'warm' when x in ('bolt', 'rod') then 'fixings' when x in ('ring', 'gear', 'plate') then 'round' end) as kinds from w)
  select p_partkey, list_filter(kinds, lambda x: x is not null)[1] as guess from k""")
def name_guesses(spark: SparkSession, sf: str) -> DataFrame:
    """What a name alone suggests, by its head, then by its words before a cut."""
    return table(spark, sf, "part").select("p_partkey", pages.name_guess(F.col("p_name"), GUESSES, ["plate", "gizmo"]).alias("guess"))


@query("""select s_suppkey, s_nationkey, coalesce(case when n_nationkey % 7 > 0 and n_nationkey % 5 > 0 then n_name end, 'nation ' || s_nationkey) as n_name from supplier left join nation on s_nationkey = n_nationkey""")
def labels_looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """A label by its key, with a fallback for missing and nameless entries."""
    names = table(spark, sf, "nation").filter("n_nationkey % 7 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("n_name"))
    rows = pages.looked_up(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", "n_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))
    return rows.select("s_suppkey", "s_nationkey", "n_name")


@query("""select cast(o_orderdate as date) as day, count(*) as sent, count(*) filter (where o_orderstatus = 'F') as answered, sum(length(o_orderpriority)) / 3.0::double as units, case when day(min(o_orderdate)) = 1 then 'checked' end as note from orders group by 1""")
def usage_days(spark: SparkSession, sf: str) -> DataFrame:
    """A day's computed figures beside the note that was kept by hand for some days."""
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    days = o.groupBy("day").agg(F.count("*").alias("sent"), F.count_if(F.col("o_orderstatus") == "F").alias("answered"), (F.sum(F.length("o_orderpriority")) / F.lit(3.0)).alias("units"))
    notes = o.filter(F.dayofmonth("day") == 1).select("day", F.lit("checked").alias("note")).distinct()
    return pages.with_hand_columns(days, notes, "day")
