"""Queries of certainty, reviews, sections, shown groups, successors and page sizes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import measures
from shelfwise.operators import resolve, sections, verified
from shelfwise.plans.catalog import LISTINGS, listings, table
from shelfwise.plans.queries import query

#: Decisions on listings: a kind by product, another one at some stores; head, cut word or shelf; some reviewed.
_DECIDED = f"""{LISTINGS}, decided as (select store || '/' || product_id as id, store, product_id, case when product_id % 7 <> 0 then product_id // 3 end as code, kind || '/' || sub_kind as shelf,
  case when (product_id + length(store)) % 9 = 0 then null when (product_id * length(store)) % 8 = 1 then 'k' || (product_id + 1) % 6 else 'k' || product_id % 6 end as kind, case when (product_id + length(store)) % 9 <> 0 then ['head', 'cut', 'shelf'][(product_id + length(store)) % 3 + 1] end as step, product_id % 10 = 3 as reviewed from listings)"""
_LEVELS = f"""{_DECIDED}, peers as (select distinct code, store, kind, coalesce(reviewed, false) or coalesce(step = 'head', false) as firm from decided where code is not null),
found as (select d.id, coalesce(list_sort(list(distinct p.kind) filter (where p.kind is not null)), []) as kinds, coalesce(bool_or(p.firm and p.kind = d.kind), false) as confirmed from decided d left join peers p on d.code = p.code and d.store <> p.store group by d.id),
levels as (select d.*, case when reviewed then case when kind is null then 'none' else 'high' end when kind is null then case when len(kinds) > 0 then 'review' else 'none' end when len(list_filter(kinds, lambda k: k <> kind)) > 0 then 'review' when step = 'head' or confirmed then 'high' else 'review' end as level,
  case when reviewed then 'decided in review' when kind is null then case when len(kinds) > 0 then 'no kind here, but the same code is ' || array_to_string(kinds, ' / ') || ' elsewhere' else 'no kind' end when len(list_filter(kinds, lambda k: k <> kind)) > 0 then 'the same code is ' || array_to_string(list_filter(kinds, lambda k: k <> kind), ' / ') || ' at another store'
    when step = 'head' then 'decided by the head word' else 'decided by ' || case when step = 'cut' then 'a cut word' else 'the shelf' end || case when confirmed then ', confirmed by code' else ', unconfirmed' end end as why from decided d join found using (id))"""


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    p, n = F.col("product_id"), F.length("store")
    none = (p + n) % 9 == 0
    kind = F.when(~none, F.concat(F.lit("k"), F.when((p * n) % 8 == 1, (p + 1) % 6).otherwise(p % 6).cast("string")))
    step = F.when(~none, F.element_at(F.array(F.lit("head"), F.lit("cut"), F.lit("shelf")), ((p + n) % 3 + 1).cast("int")))
    return listings(spark, sf).select(F.concat_ws("/", "store", p.cast("string")).alias("id"), "store", "product_id", F.when(p % 7 != 0, F.floor(p / 3)).alias("code"), F.concat_ws("/", "kind", "sub_kind").alias("shelf"), kind.alias("kind"), step.alias("step"), (p % 10 == 3).alias("reviewed"))


@query(f"with {_LEVELS} select id, level, why from levels")
def kinds_certain(spark: SparkSession, sf: str) -> DataFrame:
    """K8: how sure a listing's kind is, by its step, by review and by other stores' listings of its code."""
    return verified.certainty_levels(_decided(spark, sf), "id", "store", "code").select("id", "level", "why")


@query(f"with {_LEVELS}, g as (select *, dense_rank() over (order by n desc, store, shelf, kind, step) as place from (select store, shelf, coalesce(kind, '-') as kind, coalesce(step, 'barcode') as step, count(*) as n from levels where level = 'review' and coalesce(kind, '') <> 'k5' group by 1, 2, 3, 4)) select place::int as place, n as n_items, store, shelf, kind, step from g where place <= 40")
def review_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 largest batches of listings in need of review (the feature's limit); one kind is hidden."""
    levels = verified.certainty_levels(_decided(spark, sf), "id", "store", "code")
    return verified.review_batches(levels, ["store", "shelf", "kind", "step"], 40, spark.createDataFrame([("k5",)], "kind string"))


@query(f"""with {_DECIDED}, gold as (select store, product_id, kind from decided where reviewed union all select 'ASIA', p_partkey, case when p_partkey % 4 > 0 then 'k' || p_partkey % 5 end from part where p_partkey % 6 = 1)
  select distinct store, product_id, g.kind as verified, d.kind as now from gold g join decided d using (store, product_id) where g.kind is distinct from d.kind""")
def gold_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Verified kinds, from review and by hand, that are others today; of the first none may be."""
    now = _decided(spark, sf)
    p = F.col("p_partkey")
    hand = table(spark, sf, "part").filter(p % 6 == 1).select(F.lit("ASIA").alias("store"), p.alias("product_id"), F.when(p % 4 > 0, F.concat(F.lit("k"), (p % 5).cast("string"))).alias("kind"))
    return verified.gold_broken(now, [now.filter("reviewed"), hand], ["store", "product_id"])


@query("""with r as (select p_partkey as id, date '2026-11-01' + (p_size % 12)::int as read_on, (p_partkey % 3 = 0)::int + 1 as round, p_size % 5 > 0 as known from part), k as (select * from r where known),
  a as (select *, date_diff('day', read_on, date '2026-11-10') >= 2 as able, round < 2 as turn from k)
  select id, 2 + (not turn)::int as round, not turn as new_round from a where able and (turn or not (select coalesce(bool_or(turn and not able), false) from a)) order by not turn, sha256('s' || id), id limit 75""")
def rereads_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """75 rows to read again (the feature's pace), none twice before all others had their turn."""
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.date_add(F.lit("2026-11-01").cast("date"), (F.col("p_size") % 12).cast("int"))).alias("read_on"), ((F.col("p_partkey") % 3 == 0).cast("int") + 1).alias("reread_round"))
    return verified.rereads(r, "id", F.lit("2026-11-10").cast("date"), 2, 75, "s")


_SEEN = """seen as (select distinct o_orderpriority as store, strftime(o_orderdate, '%Y-%m') as run, ['Frescos', 'Peixaria', 'Casa', 'Cães'][o_custkey % 4 + 1] || '/' || o_custkey % 60 as path from orders),
runs as (select store, run, right(run, 2)::int % 4 <> 0 as complete from (select distinct store, run from seen)), kinds(section, kind) as (values ('frescos', 'food'), ('PEIXARIA', 'mixed'), ('caes', 'other'))"""


@query(f"""with {_SEEN}, o as (select *, lag(run) over (partition by store order by run) as b from runs),
  x as (select s.store, s.run, s.path, 'added' as change from (select store, path, min(run) as run from seen group by 1, 2) s join o on s.store = o.store and s.run = o.run and o.b is not null
    union all select o.store, o.run, s.path, 'vanished' from o join seen s on s.store = o.store and s.run = o.b where o.complete and not exists (from seen t where t.store = o.store and t.run = o.run and t.path = s.path))
  select x.*, coalesce(k.kind, 'undecided') as kind, coalesce(k.kind, '') in ('food', 'mixed') as is_food from x left join kinds k on lower(strip_accents(split_part(x.path, '/', 1))) = lower(k.section)""")
def sections_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Sections added and vanished over all loads, vanished on complete loads only, with their decided kind."""
    word = F.element_at(F.array(*(F.lit(x) for x in ("Frescos", "Peixaria", "Casa", "Cães"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    seen = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("store"), F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.concat_ws("/", word, (F.col("o_custkey") % 60).cast("string")).alias("path")).distinct()
    runs = seen.select("store", "run").distinct().withColumn("complete", F.substring("run", 6, 2).cast("int") % 4 != 0)
    decided = spark.createDataFrame([("frescos", "food"), ("PEIXARIA", "mixed"), ("caes", "other")], "section string, kind string")
    return sections.section_changes(seen, runs, seen.select("store").distinct().crossJoin(F.broadcast(decided)))  # three rows


@query("""with l as (select o_orderstatus as store, strftime(o_orderdate, '%Y-%m') as run, case when o_custkey % 3 = 0 then ' Laticínios' when o_custkey % 3 = 1 then 'Peixaria ' else 'Pão' end as label, month(o_orderdate) % 2 as odd from orders),
  k as (select store, run, lower(strip_accents(trim(case when odd = 1 then upper(label) else label end))) as section, count(*) as n from l where not (section = 'pao' and run like '%-05') group by 1, 2, 3),
  t as (select store, run, sum(n)::bigint as total from k group by 1, 2), r as (select *, lag(total) over w as was, lead(run) over w as nxt from t window w as (partition by store order by run))
  select store, run, null as section, was, total as now, 'fell' as warning from r where was > 0 and total < was * 0.9
  union all select b.store, r.nxt, b.section, b.n, c.n, case when c.n is null then 'missing' else 'fell' end from k b join r on b.store = r.store and b.run = r.run and r.nxt is not null left join k c on c.store = b.store and c.run = r.nxt and c.section = b.section where b.n >= 20 and (c.n is null or c.n < 0.8 * b.n)""")
def section_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Stores and sections that fell from one load to the next, sections known by labels without accents and case."""
    word = F.when(F.col("o_custkey") % 3 == 0, " Laticínios").when(F.col("o_custkey") % 3 == 1, "Peixaria ").otherwise("Pão")
    label = F.when(F.month("o_orderdate") % 2 == 1, F.upper(word)).otherwise(word)
    loads = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("store"), F.date_format("o_orderdate", "yyyy-MM").alias("run"), label.alias("label")).agg(F.count("*").alias("collected"))
    return sections.section_warnings(loads.filter("not (lower(label) = 'pão' and run like '%-05')"), least=20)


@query("""with u as (select list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^?#]*)', 1), '/+$', ''), '/'), lambda x: x <> '') as parts from pages), d as (select array_to_string(parts[1:i], '/') as path, i::int as depth from (select parts, unnest(range(1, len(parts) + 1)) as i from u))
  select path, depth, count(*) as n_pages, split_part(path, '/', 1) in ('en', 'de', 'fr') as known from d group by path, depth""")
def sections_audited(spark: SparkSession, sf: str) -> DataFrame:
    """Section paths of published addresses at every depth, and whether their top one has been decided."""
    return sections.audited_paths(table(spark, sf, "pages"), "url", spark.createDataFrame([("en",), ("de",), ("fr",)], "slug string"))


@query("""with p as (select c_custkey as department, case when c_custkey % 10 > 0 then c_custkey % 25 end as published from customer), h as (select o_custkey as department, count(*) as held from orders group by 1)
  select department, published, coalesce(held, 0) as held, published - coalesce(held, 0) as gap from p left join h using (department)""")
def departments_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Published counts against rows held; unread counts have no gap, negative gaps stay."""
    c = table(spark, sf, "customer")
    published = c.select(F.col("c_custkey").alias("department"), F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey") % 25).alias("published"))
    return sections.coverage(published, table(spark, sf, "orders").select(F.col("o_custkey").alias("department")), "department")


_FLAGS = {0: None, 1: "", 2: "[]", 3: '["weak-links"]', 4: '["weak-links","duplicate-store"]', 5: "not json", 6: '["barcode-unconfirmed"]'}


@query(f"""with {LISTINGS}, g as (select kind, sub_kind, count(distinct store) filter (where price_cents is not null) as stores_compared, count(distinct store) filter (where price_cents is not null and own_brand) as own_brand_priced, max(product_id) % 9 = 0 as others, max(product_id) % 7 as f from listings group by 1, 2),
  s as (select *, stores_compared >= 3 and not others and f not in (4, 5, 6) as shown from g) select kind, sub_kind, shown, shown and own_brand_priced >= 3 as own_brand_shown from s""")
def groups_shown(spark: SparkSession, sf: str) -> DataFrame:
    """groups that a page shows: enough stores, not the remainder, no hiding flag, flags that can be read."""
    priced = F.when(F.col("price_cents").isNotNull(), F.col("store"))
    last = F.max("product_id")
    flags = F.lit(None).cast("string")
    for i, text in _FLAGS.items():
        flags = F.when(F.col("f") == i, F.lit(text)).otherwise(flags)
    g = listings(spark, sf).groupBy("kind", "sub_kind").agg(F.countDistinct(priced).alias("stores_compared"), F.countDistinct(F.when(F.col("own_brand"), priced)).alias("own_brand_priced"), (last % 9 == 0).alias("others"), (last % 7).alias("f"))
    return sections.groups_shown(g.withColumn("flags", flags), 3, ["duplicate-store", "barcode-unconfirmed"]).select("kind", "sub_kind", "shown", "own_brand_shown")


@query("""with i as (select c_custkey as id, case when c_custkey % 5 = 0 then c_custkey - 3 end as successor, c_custkey % 7 = 2 as delisted from customer), d as (select distinct least(o_custkey, o_orderkey % (select max(c_custkey) from customer)) as a, greatest(o_custkey, o_orderkey % (select max(c_custkey) from customer)) as b from orders), n as (select *, a * 10000000 + b as id from d),
  m as (select n.id, n.a, n.b, least(coalesce(sa.successor, n.a), coalesce(sb.successor, n.b)) as x, greatest(coalesce(sa.successor, n.a), coalesce(sb.successor, n.b)) as y, sa.successor is not null or sb.successor is not null as moved from n left join (select i.* from i join i s on s.id = i.successor and not s.delisted) sa on sa.id = n.a left join (select i.* from i join i s on s.id = i.successor and not s.delisted) sb on sb.id = n.b),
  j as (select *, case when not moved then 'kept' when exists (from n t where t.a = m.x and t.b = m.y) or id <> min(id) filter (where moved) over (partition by x, y) then 'retired' else 'repointed' end as state from m)
  select id, case when state = 'repointed' then x else a end as a, case when state = 'repointed' then y else b end as b, state from j""")
def successors_followed(spark: SparkSession, sf: str) -> DataFrame:
    """Decided pairs that follow a member's successor one hop, unless it is delisted or the pair is there already."""
    c = F.col("c_custkey")
    items = table(spark, sf, "customer").select(c.alias("id"), F.when(c % 5 == 0, c - 3).alias("superseded_by"), (c % 7 == 2).alias("delisted"))
    most = table(spark, sf, "customer").agg(F.max("c_custkey").alias("most"))
    pair = F.col("o_orderkey") % F.col("most")
    pairs = table(spark, sf, "orders").crossJoin(F.broadcast(most)).select(F.least("o_custkey", pair).alias("a"), F.greatest("o_custkey", pair).alias("b")).distinct()  # one row
    return resolve.follow_successors(pairs.withColumn("id", F.col("a") * 10000000 + F.col("b")), items)


_PAGE = """pg as (select p_partkey, p_retailprice as price, p_size * 37 + 5 as cents, case when p_partkey % 4 = 0 then p_name || ' cápsulas' when p_partkey % 4 = 1 then p_name || ' KG' when p_partkey % 4 = 2 then p_name || ' 800G a 1 kg' else p_name || ' 1kg' end as name, round((p_size * 37 + 5) / 100.0, 2)::double as figure,
  case when p_partkey % 3 = 0 then '€/Kg' when p_partkey % 3 = 1 then ' € / lt' else '€/un' end as per, p_size / 20.0 as label, case when p_partkey % 2 = 0 then 'l' else 'kg' end as label_unit from part)"""


@query(f"""with {_PAGE}, n as (select *, case p_partkey % 3 when 0 then 'kg' when 1 then 'l' end as unit, round(price, 2) / figure as s, case when p_partkey % 5 = 0 and p_partkey % 3 < 2 then case p_partkey % 3 when 0 then 'kg' else 'l' end end as whole from pg),
  d as (select *, round(price, 2) / (figure + 0.005) as lo, round(price, 2) / (figure - 0.005) as hi, floor(s * pow(10, 0 - floor(log10(s))) + 0.5) / pow(10, 0 - floor(log10(s))) as d1, floor(s * pow(10, 1 - floor(log10(s))) + 0.5) / pow(10, 1 - floor(log10(s))) as d2, floor(s * pow(10, 2 - floor(log10(s))) + 0.5) / pow(10, 2 - floor(log10(s))) as d3 from n),
  t as (select *, case when d1 between lo and hi then d1 when d2 between lo and hi then d2 else d3 end as t from d)
  select p_partkey, p_partkey % 4 in (1, 2) as loose, figure as shown, coalesce(unit, 'un') as shown_unit, whole, case when unit = 'kg' and t between 0.001 and 30 then t when unit = 'l' and t between 0.01 and 10 then t end as derived,
    case when whole is not null then 1.0 when p_partkey % 4 = 0 and (label_unit = 'l' or label >= 1) then null else label end::double as size, p_partkey % 6 < 3 as on_promotion, case when p_partkey % 6 < 3 then round(price, 2) + 1 end::double as regular_price from t""")
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What a page's price and size texts mean: loose goods, unit prices, derived and corrected sizes, struck prices."""
    key, comma = F.col("p_partkey"), lambda x: F.replace(F.format_string("%.2f", x), F.lit("."), F.lit(","))
    price, figure = F.round(F.col("p_retailprice").cast("double"), 2), F.round((F.col("p_size") * 37 + 5) / 100.0, 2)
    name = F.concat("p_name", F.when(key % 4 == 0, " cápsulas").when(key % 4 == 1, " KG").when(key % 4 == 2, " 800G a 1 kg").otherwise(" 1kg"))
    per = F.when(key % 3 == 0, "€/Kg").when(key % 3 == 1, " € / lt").otherwise("€/un")
    headline = F.concat(comma(price), F.when(key % 5 == 0, per).otherwise("€"))
    struck = F.concat(F.lit("Preço "), comma(F.when(key % 6 < 3, price + 1).otherwise(price)), F.lit(" €"))
    rows = table(spark, sf, "part").select("p_partkey", price.alias("price"), name.alias("name"), measures.parse_shown_unit_price(F.concat(F.lit("0.1 Kg | "), comma(figure), per)).alias("f"), measures.parse_price(headline).alias("read"), headline.alias("headline"), struck.alias("struck"), (F.col("p_size") / 20.0).alias("label"), F.when(key % 2 == 0, "l").otherwise("kg").alias("label_unit"))
    rows = rows.withColumn("whole", measures.priced_per_unit(F.col("headline"), F.col("read"))).withColumn("p", measures.struck_promotion(F.col("struck"), F.col("price")))
    size = measures.corrected_size(F.col("name"), F.col("label"), F.col("label_unit"), F.col("whole"))["total"]
    return rows.select("p_partkey", measures.sold_loose(F.col("name")).alias("loose"), F.col("f.figure").alias("shown"), F.col("f.unit").alias("shown_unit"), "whole", measures.size_from_unit_price(F.col("price"), F.col("f.figure"), F.col("f.unit")).alias("derived"), size.alias("size"), "p.on_promotion", "p.regular_price")
