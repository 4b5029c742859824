"""Queries of load gates with counts taken from the tables, absences, corroboration, merged results and group order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import gates
from shelfwise.plans.catalog import OBSERVATIONS, observations, table
from shelfwise.plans.queries import query

_LOADS = f"""{OBSERVATIONS},
r as (select o.*, year(day) as y, (l_tax * 100)::int as code, l_discount, l_quantity from obs o join (select l_orderkey, l_linenumber, l_suppkey, l_partkey as product_id, l_tax, l_discount, l_quantity, l_extendedprice from lineitem) l using (l_orderkey, l_linenumber, l_suppkey, product_id)),
n as (select store, y, product_id, arg_max(row(price_cents, available, case when l_discount > 0.015 then code end, l_discount), row(day, l_orderkey, l_linenumber, price_cents)) as v from r group by 1, 2, 3),
m as (select coalesce(b.store, a.store) as store, coalesce(b.y, a.y + 1) as y, coalesce(b.product_id, a.product_id) as product_id, a.v as was, b.v as now from n a full join n b on a.store = b.store and a.product_id = b.product_id and b.y = a.y + 1),
c as (select store, y, count(was) as live, count(*) filter (where was is not null and now is null) as missing, count(*) filter (where was is not null and now is null and product_id % 3 = 0) as dead, count(*) filter (where was is not null and p_type = 'PROMO' and product_id % 3 = 0) as non_food,
    count(*) filter (where was is not null and now is not null) as compared, count(*) filter (where was[3] <> now[3] and product_id % 30 = 0) as swapped, count(*) filter (where was[3] is not null and now is not null and now[3] is null) as lost,
    count(*) filter (where was[1] <> now[1] and product_id % 2 = 0) as changed, count(*) filter (where was[1] <> now[1] and product_id % 2 = 0 and now[4] > 0.085) as turnover, count(*) filter (where was is not null and now is not null and (was[1] = now[1] or product_id % 2 = 1)) as unchanged, count(*) filter (where was[2] <> now[2]) as availability_changed
  from m join part on product_id = p_partkey group by 1, 2),
t as (select store, y, count(*) as tiles, count(*) filter (where l_quantity < 3) as malformed, count(*) filter (where l_quantity >= 3) as kept, count(*) filter (where l_quantity >= 3 and l_linenumber = 7 and y % 2 = 0) as uncategorised, count(*) filter (where l_quantity >= 3 and not available and y <> 1997) as unavailable, count(*) filter (where l_linenumber = 1 and l_quantity > 40) as short from r group by 1, 2)"""


@query(rf"""with {_LOADS}, l as (select c.*, tiles, malformed, kept, uncategorised, unavailable, y < 2001 as complete, c.live as attempted, tiles as published, tiles - case when y = 1999 then short else 5 end as delivered, case when y = 1998 and store = 'ASIA' then 1 else 0 end as failed from c join t using (store, y)),
  g as (select *, greatest(changed - turnover, 0) as moved from l),
  h as (select store, y, complete, list_filter([
    case when complete and attempted >= 500 and dead / attempted > 0.10 then 'dead-pages' end, case when attempted > 0 and non_food / attempted > 0.05 then 'non-food' end, case when complete and compared >= 500 and swapped / compared > 0.02 then 'barcode-swaps' end, case when complete and compared >= 500 and lost / compared > 0.10 then 'barcode-losses' end,
    case when complete and moved + unchanged + availability_changed >= 500 and moved / (moved + unchanged + availability_changed) > 0.30 then 'price-churn' end, case when complete and failed > 0 then 'failed-department' end, case when complete and published - delivered > 5 and published - delivered > 0.01 * published then 'truncated' end,
    case when complete and live >= 500 and missing / live > 0.10 then 'under-collected' end, case when complete and tiles >= 500 and malformed / tiles > 0.05 then 'tile-yield' end, case when complete and kept >= 500 and uncategorised / kept > 0.05 then 'empty-categories' end, case when complete and kept > 0 and (unavailable / kept < 0.01 or unavailable / kept > 0.40) then 'unavailable-share' end], lambda x: x is not null) as reasons from g)
  select store, y, reasons, complete and len(list_filter(reasons, lambda x: x <> 'unavailable-share')) = 0 as may_confirm from h""")
def loads_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 Q5a Q5b Q5c Q5d Q5e Q6 Q6a Q6b Q6c Q6d Q6e Q6f Q22: all gates over a year's load of each store, with counts from the rows."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("product_id"), "l_tax", "l_discount", "l_quantity")
    r = observations(spark, sf).join(lines, ["l_orderkey", "l_linenumber", "l_suppkey", "product_id"]).withColumn("y", F.year("day"))
    code = F.when(F.col("l_discount") > 0.015, (F.col("l_tax") * 100).cast("decimal(12,0)").cast("int"))
    state = F.max(F.struct("day", "l_orderkey", "l_linenumber", "price_cents", F.struct(F.col("price_cents").alias("price"), "available", code.alias("code"), F.col("l_discount").alias("off")).alias("v")))
    n = r.groupBy("store", "y", "product_id").agg(state.alias("m")).select("store", "y", "product_id", F.col("m.v").alias("v"))
    was = n.select("store", (F.col("y") + 1).alias("y"), "product_id", F.col("v").alias("was"))
    m = was.join(n.withColumnRenamed("v", "now"), ["store", "y", "product_id"], "full_outer")
    m = m.join(table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_type"), "product_id")
    key, both = F.col("product_id"), F.col("was").isNotNull() & F.col("now").isNotNull()
    held, gone = F.col("was").isNotNull(), F.col("was").isNotNull() & F.col("now").isNull()
    moved = (F.col("was.price") != F.col("now.price")) & (key % 2 == 0)
    c = m.groupBy("store", "y").agg(
        F.count("was").alias("live"), F.count_if(gone).alias("missing"), F.count_if(gone & (key % 3 == 0)).alias("dead"), F.count_if(held & (F.col("p_type") == "PROMO") & (key % 3 == 0)).alias("non_food"), F.count_if(both).alias("compared"),
        F.count_if((F.col("was.code") != F.col("now.code")) & (key % 30 == 0)).alias("swapped"), F.count_if(both & F.col("was.code").isNotNull() & F.col("now.code").isNull()).alias("lost"), F.count_if(moved).alias("changed"), F.count_if(moved & (F.col("now.off") > 0.085)).alias("turnover"),
        F.count_if(both & ((F.col("was.price") == F.col("now.price")) | (key % 2 == 1))).alias("unchanged"), F.count_if(F.col("was.available") != F.col("now.available")).alias("availability_changed"),
    )
    ok = F.col("l_quantity") >= 3
    t = r.groupBy("store", "y").agg(F.count("*").alias("tiles"), F.count_if(~ok).alias("malformed"), F.count_if(ok).alias("kept"), F.count_if(ok & (F.col("l_linenumber") == 7) & (F.col("y") % 2 == 0)).alias("uncategorised"), F.count_if(ok & ~F.col("available") & (F.col("y") != 1997)).alias("unavailable"), F.count_if((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 40)).alias("short"))
    loads = c.join(t, ["store", "y"]).select("*", (F.col("y") < 2001).alias("complete"), F.col("live").alias("attempted"), F.col("tiles").alias("published"), (F.col("tiles") - F.when(F.col("y") == 1999, F.col("short")).otherwise(5)).alias("delivered"), F.when((F.col("y") == 1998) & (F.col("store") == "ASIA"), 1).otherwise(0).alias("failed"))
    return gates.gates(loads).select("store", "y", "reasons", "may_confirm")


_SEEN = "published as (select distinct l_partkey as id from lineitem where l_shipdate >= timestamp '2001-06-01'), held as (select distinct l_partkey as id from lineitem where l_shipdate < timestamp '1995-09-01'), checked as (select p_partkey as id from part where p_partkey % 5 = 0)"


@query(f"with {_SEEN} select id from published where id not in (select id from held) and id not in (select id from checked)")
def published_unheld(spark: SparkSession, sf: str) -> DataFrame:
    """Published ids in neither the catalogue nor the check table."""
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    checked = table(spark, sf, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"))
    return gates.unheld(ids.filter(F.col("l_shipdate") >= at("2001-06-01")), [ids.filter(F.col("l_shipdate") < at("1995-09-01")), checked], "id")


@query("""with h as (select distinct l_partkey as id, l_linestatus as side from lineitem where l_shipdate < timestamp '1996-01-01'), p as (select distinct l_partkey as id from lineitem where l_shipdate >= timestamp '1996-01-01' and l_quantity < 4),
  q as (select count(*) filter (where id not in (select id from p)) <= 0.05 * count(*) as believed from (select distinct id from h)) select distinct id, believed from h, q where id not in (select id from p)""")
def held_unpublished(spark: SparkSession, sf: str) -> DataFrame:
    """Held ids that the published list lacks, and whether so many are believed."""
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate", "l_quantity")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return gates.unpublished(ids.filter(early), ids.filter(~early & (F.col("l_quantity") < 4)), "id")


@query("""with s as (select p_partkey as id, case when p_partkey % 11 > 0 then p_brand end as code, case when p_partkey % 6 > 0 then p_retailprice * (1 + p_partkey % 3) end as price, case when p_partkey % 10 > 0 then p_size::double end as size, case when p_partkey % 8 > 0 then 'kg' else 'l' end as unit, p_partkey % 13 = 0 as delisted from part),
  e as (select p_partkey as id, p_partkey + 25 as other, p_size * (case when p_partkey % 4 = 0 then 1.005 else 1 end) as true_size from part)
  select e.id, case when h.code is null then 'code unknown here' when t.id is null or t.delisted then 'no longer on sale' when t.code is distinct from h.code then 'another code' when t.unit <> 'kg' or t.size is null or abs(t.size - true_size) > 0.01 * true_size then 'another size' when greatest(h.price, t.price) / least(h.price, t.price) > 1.5 and h.price is not null and t.price is not null then 'another price' end as problem
  from e join s h on e.id = h.id left join s t on e.other = t.id""")
def sizes_vouched(spark: SparkSession, sf: str) -> DataFrame:
    """whether the other store's product of the same code still vouches for a confirmed size."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    facts = F.struct(F.when(key % 11 > 0, F.col("p_brand")).alias("code"), F.when(key % 6 > 0, F.col("p_retailprice") * (1 + key % 3)).alias("price"), F.when(key % 10 > 0, F.col("p_size").cast("double")).alias("size"), F.when(key % 8 > 0, "kg").otherwise("l").alias("unit"), (key % 13 == 0).alias("delisted"))
    known = p.select(key.alias("other"), facts.alias("there"))
    entries = p.select(key.alias("id"), (key + 25).alias("other"), (F.col("p_size") * F.when(key % 4 == 0, 1.005).otherwise(1.0)).alias("true_size"), facts.alias("here"))
    return entries.join(known, "other", "left").select("id", gates.corroboration(F.col("true_size"), F.lit("kg"), F.col("here"), F.col("there")).alias("problem"))


@query("""with r as (select o_orderpriority as label, o_orderkey as item, case when o_orderstatus = 'F' then 3 end as expected, case when o_orderpriority = '5-LOW' then null when o_orderkey % 2 = 0 then 1 end as duplicates from orders where o_custkey % 10 = 0)
  select label, list(item order by item) as items, sum(expected)::bigint as expected, sum(duplicates)::bigint as duplicates from r group by 1""")
def results_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Passes merged by label, nullable counts added."""
    o = table(spark, sf, "orders").filter("o_custkey % 10 = 0")
    rows = o.select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", 3).alias("expected"), F.when((F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderkey") % 2 == 0), 1).alias("duplicates"))
    return gates.merged_by_label(rows, "label", "at", "item", ["expected", "duplicates"])


@query("""with g as (select p_type as kind, case when p_partkey % 6 > 0 then string_split(p_name, ' ')[1] end as sub_kind, list_sort(list_distinct(list(p_brand))) as labels from part where p_partkey % 3 > 0 group by 1, 2, p_partkey % 4)
  select kind, sub_kind, labels, row_number() over (partition by kind order by case when sub_kind is null then 999 when sub_kind = 'small' then 1 when sub_kind = 'red' then 2 when sub_kind = 'hot' then 3 else 998 end, len(labels), array_to_string(labels, ','), sub_kind nulls first)::int as place from g""")
def groups_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a kind in the order of the sub-kind rules, then by number of labels, then by their text."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    g = p.filter("p_partkey % 3 > 0").groupBy(F.col("p_type").alias("kind"), F.when(key % 6 > 0, F.split("p_name", " ")[0]).alias("sub_kind"), (key % 4).alias("i")).agg(F.sort_array(F.collect_set("p_brand")).alias("labels"))
    rules = spark.createDataFrame([("small", 1), ("red", 2), ("hot", 3)], "sub_kind string, order int")
    made = gates.group_order(g, rules)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("rule", "n_labels", "label_text", F.col("sub_kind").asc_nulls_first()))
    return made.select("kind", "sub_kind", "labels", place.alias("place"))
