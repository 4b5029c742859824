"""One query per operator over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import codes, measures, text
from shelfwise.operators import compare, ordered, periods, quality, resolve, rules
from shelfwise.plans.catalog import LISTINGS, OBSERVATIONS, PRODUCTS, RUNS, listings, observations, products, runs, stores, table
from shelfwise.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


GROUP = ["kind", "sub_kind", "unit"]

CELLS = f"""{LISTINGS},
best as (
  select kind, sub_kind, unit, store, count(price_cents) as n_priced,
    min(case when price_cents is not null and size > 0 then row(price_cents / size, product_id) end) as b,
    min(case when price_cents is not null and not coalesce(size > 0, false) then product_id end) as unsized
  from listings group by 1, 2, 3, 4
), grid as (
  select g.kind, g.sub_kind, g.unit, s.store,
    case when b is not null then 'price' when n_priced > 0 then 'no-size' else 'not-stocked' end as state,
    cast(floor(b[1] + 0.5) as bigint) as unit_cents, b[2] as item, case when b is null and n_priced > 0 then unsized end as example
  from (select distinct kind, sub_kind, unit from listings) g cross join (select r_name as store from region) s
  left join best on g.kind = best.kind and g.sub_kind = best.sub_kind and g.unit = best.unit and s.store = best.store
), winners as (
  select *, count(unit_cents) over w as n_priced,
    coalesce(unit_cents = min(unit_cents) over w and count(unit_cents) over w >= 2, false) as is_winner
  from grid window w as (partition by kind, sub_kind, unit)
)"""


@query(f"with {CELLS} select kind, sub_kind, unit, store, state, unit_cents, item, example, n_priced, is_winner from winners")
def cheapest_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Three-state cells of a dense grid, and the stores tied at the lowest cent."""
    return compare.with_winners(compare.cells(listings(spark, sf), stores(spark, sf), GROUP), GROUP)


@query(f"with {CELLS.replace('from listings group by 1, 2, 3, 4', 'from listings where own_brand group by 1, 2, 3, 4').replace('(select distinct kind, sub_kind, unit from listings)', '(select distinct kind, sub_kind, unit from listings where own_brand)')} select kind, sub_kind, unit, store, state, unit_cents, item from grid")
def own_brand_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    """The same over own-brand rows."""
    return compare.cells(listings(spark, sf).filter("own_brand"), stores(spark, sf), GROUP).select(*GROUP, "store", "state", "unit_cents", "item")


@query(f"""with {CELLS} select kind, unit, store, n_members, b[1] as unit_cents, b[2] as sub_kind from (
  select kind, unit, store, min(row(unit_cents, sub_kind)) as b from grid where unit_cents is not null group by 1, 2, 3) x
  join (select kind, unit, count(distinct sub_kind) as n_members from grid group by 1, 2 having count(distinct sub_kind) >= 2) m using (kind, unit)""")
def family_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best of the groups of a kind and unit, for families of two groups or more."""
    return compare.family_best(compare.cells(listings(spark, sf), stores(spark, sf), GROUP), ["kind", "unit"], "sub_kind")


@query(f"""with {LISTINGS}, g as (select kind, sub_kind, count(*) as n_products, count(distinct unit) as n_labels from listings group by 1, 2)
  select kind, sub_kind, n_products, n_labels from g qualify row_number() over (partition by kind order by sub_kind is null, n_labels, n_products desc, sub_kind) = 1""")
def main_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The main group of each kind."""
    g = listings(spark, sf).groupBy("kind", "sub_kind").agg(F.count("*").alias("n_products"), F.countDistinct("unit").alias("n_labels"))
    return compare.main_group(g, ["kind"], "sub_kind", "n_labels", "n_products", "sub_kind")


@query(f"""with {LISTINGS} select product_id, n_prices, low, high, high - low as gap, shortest[2] as name from (
  select product_id, count(price_cents) as n_prices, min(price_cents) as low, max(price_cents) as high, min(row(length(name), name)) as shortest
  from listings group by 1 having count(price_cents) >= 2) order by gap desc, product_id limit 20""")
def largest_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty products with the largest price gap between stores."""
    return compare.price_gaps(listings(spark, sf), "product_id", "price_cents", "name").orderBy(F.col("gap").desc(), "product_id").limit(20)


@query(f"""with {LISTINGS}, u as (select kind, floor(price_cents / size + 0.5) as unit_cents from listings where price_cents is not null and size > 0)
  select kind, count(*) as n, median(unit_cents)::double as middle, min(unit_cents)::bigint as low, max(unit_cents)::bigint as high, (max(unit_cents) / nullif(min(unit_cents), 0))::double as breadth from u group by 1
  order by coalesce(breadth, 0) desc, kind limit 25""")
def kind_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Median, lowest and breadth of unit prices of each kind, the broadest first."""
    rows = listings(spark, sf).filter(compare.comparable(F.col("price_cents"), F.col("size"), F.col("unit")))
    rows = rows.withColumn("unit_cents", F.floor(measures.unit_price(F.col("price_cents"), F.col("size")) + 0.5))
    out = rows.groupBy("kind").agg(F.count("*").alias("n"), F.median("unit_cents").alias("middle"), F.min("unit_cents").alias("low"), F.max("unit_cents").alias("high"))
    out = out.withColumn("breadth", F.try_divide(F.col("high").cast("double"), F.col("low")))
    return out.orderBy(F.coalesce("breadth", F.lit(0.0)).desc(), "kind").limit(25)


@query(f"""with {PRODUCTS}, c as (select kind, count(*) over (partition by brand, sub_kind) as block from products), s as (select kind, block, row_number() over (partition by kind order by block) - 1 as i, count(*) over (partition by kind) as n from c)
  select kind, min(case when i >= least(floor(n * 0.5), n - 1) then block end)::bigint as p50, min(case when i >= least(floor(n * 0.9), n - 1) then block end)::bigint as p90, min(case when i >= least(floor(n * 0.99), n - 1) then block end)::bigint as p99, max(block)::bigint as most from s group by 1""")
def block_size_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles of block sizes."""
    p = products(spark, sf)
    block = p.withColumn("block", F.count("*").over(Window.partitionBy("brand", "sub_kind")))
    return quality.nearest_rank(block, ["kind"], "block", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0})


@query(f"""with {LISTINGS} select store, count(*) as total, count(*) filter (where price_cents is null) as no_price, count(*) filter (where price_cents is not null and size is null) as no_size, count(*) filter (where price_cents is not null and size is not null and own_brand) as own_brand, count(*) filter (where price_cents is not null and size is not null and not own_brand) as rest from listings group by 1""")
def counts_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each store by the first reason that holds, and the remainder."""
    reasons = {"no_price": F.col("price_cents").isNull(), "no_size": F.col("size").isNull(), "own_brand": F.col("own_brand")}
    return quality.count_by_reason(listings(spark, sf), ["store"], reasons)


@query("""with p as (select string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/?([^?#]*)', 1), '/') as parts, url from pages),
  f as (select list_filter(parts, lambda x: x <> '') as parts, url from p), e as (select unnest(range(1, least(len(parts), 3) + 1)) as depth, parts, url from f)
  select depth::int as depth, array_to_string(parts[1:depth], '/') as section, count(*) as n, min(url) as example from e group by 1, 2""")
def path_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under each prefix of their path to depth 3."""
    p = table(spark, sf, "pages").withColumn("parts", ingest.path_segments(F.col("url")))
    return quality.path_rollup(p, [], "parts", "url")


@query("select l_partkey, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1 having count(*) > 1")
def price_range(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest and highest amount of products seen more than once."""
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("*").alias("n"))
    return rows.filter("n > 1").drop("n")


@query(f"""with {LISTINGS} select kind, count(*) filter (where store = 'AFRICA') as africa, count(*) filter (where store = 'AMERICA') as america, count(*) filter (where store = 'ASIA') as asia, count(*) filter (where store = 'EUROPE') as europe, count(*) filter (where store = 'MIDDLE EAST') as middle_east, count(*) as total from listings group by 1""")
def coverage_by_store(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of kinds by store, with a total."""
    names = {"AFRICA": "africa", "AMERICA": "america", "ASIA": "asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east"}
    counts = [F.count_if(F.col("store") == k).alias(v) for k, v in names.items()]
    return listings(spark, sf).groupBy("kind").agg(*counts, F.count("*").alias("total"))


@query(f"""with {PRODUCTS}, g as (select brand, count(distinct kind) as n_kinds, count(kind) as n_with, count(*) as n from products group by 1)
  select case when n_with = 0 then 'none' when n_with < n then 'partial' when n_kinds = 1 then 'same' else 'differ' end as agreement, count(*) as n_codes, sum(n)::bigint as n_products from g group by 1""")
def code_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How far products that share a code agree on their kind (the brand stands for the code)."""
    g = products(spark, sf).groupBy("brand").agg(F.countDistinct("kind").alias("n_kinds"), F.count("kind").alias("n_with"), F.count("*").alias("n"))
    state = F.when(F.col("n_with") == 0, "none").when(F.col("n_with") < F.col("n"), "partial").when(F.col("n_kinds") == 1, "same").otherwise("differ")
    return g.groupBy(state.alias("agreement")).agg(F.count("*").alias("n_codes"), F.sum("n").alias("n_products"))


@query(f"""with {PRODUCTS}, g as (select sub_kind, count(*) as n from products group by 1)
  select sub_kind, n, row_number() over (order by n desc, sub_kind)::int as place, floor(1e6 * sum(n) over (order by n desc, sub_kind rows unbounded preceding) / sum(n) over ())::bigint as share_ppm from g""")
def covering_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Running share of groups in descending order."""
    g = products(spark, sf).groupBy("sub_kind").agg(F.count("*").alias("n"))
    return quality.cumulative_share(g, "sub_kind", "n").select("sub_kind", "n", "place", F.floor(F.col("share") * 1e6).cast("long").alias("share_ppm"))


@query("""with a as (select o_orderstatus as status, date_diff('day', cast(o_orderdate as date), date '2001-01-31') as age from orders)
  select status, count(*) as total, count(*) filter (where age <= 0) as today, count(*) filter (where age > 0 and age <= 7) as week, count(*) filter (where age > 7 and age <= 30) as month, count(*) filter (where age > 30) as older, max(age)::int as oldest, ceil(count(*) / nullif(count(*) filter (where age <= 0), 0))::bigint as coverage_days from a group by 1""")
def staleness_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by days since they were checked."""
    rows = table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    return quality.staleness(rows, ["status"], F.datediff(F.lit("2001-01-31").cast("date"), F.col("o_orderdate").cast("date")))


PERIODS = f"""{OBSERVATIONS}, ordered as (
  select *, row_number() over w as i, lag(price_cents) over w as before_cents, lag(available) over w as before_available
  from obs window w as (partition by store, product_id order by day, l_orderkey, l_linenumber, l_suppkey, price_cents)
), marked as (
  select *, sum(case when i = 1 or price_cents is distinct from before_cents or available is distinct from before_available then 1 else 0 end)
    over (partition by store, product_id order by i rows unbounded preceding) as period from ordered
), periods as (
  select store, product_id, period, any_value(price_cents) as price_cents, any_value(available) as available, min(day) as first_seen, max(day) as last_seen, count(*) as n_seen
  from marked group by 1, 2, 3
)"""


def _periods(spark: SparkSession, sf: str, following: str | None = None) -> DataFrame:
    return periods.price_periods(observations(spark, sf), ["store", "product_id"], ["day", "l_orderkey", "l_linenumber", "l_suppkey", "price_cents"], "day", ["price_cents", "available"], following)


@query(f"with {PERIODS} select store, product_id, period::bigint as period, price_cents, available, first_seen, last_seen, n_seen, period = max(period) over (partition by store, product_id) as is_open from periods")
def price_periods(spark: SparkSession, sf: str) -> DataFrame:
    """T1 W4 ST8: periods of unchanged price and availability per listing."""
    return _periods(spark, sf)


@query(f"""with {PERIODS}, held as (
    select store, product_id, price_cents, available, first_seen as "from", lead(first_seen) over w is null as is_last, coalesce(lead(first_seen) over w, last_seen) as until
    from periods window w as (partition by store, product_id order by first_seen, period)
  ), open as (select h.*, kind from held h join (select p_partkey, p_type as kind from part) on product_id = p_partkey where available and price_cents is not null),
  days as (select distinct kind, "from" as day from open)
  select kind, day, store, b[1] as price_cents, b[2] as product_id from (
    select d.kind, d.day, store, min(row(price_cents, product_id)) as b from days d join open o on d.kind = o.kind and d.day >= o."from" and (d.day < o.until or (o.is_last and d.day = o.until)) group by 1, 2, 3)""")
def price_history(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest price of a kind per store on each day of change, over all products."""
    p = _periods(spark, sf, "following").filter(F.col("price_cents").isNotNull() & F.col("available"))
    held = p.select("product_id", "store", "price_cents", F.col("first_seen").alias("from"), F.col("following").isNull().alias("is_last"), F.coalesce("following", "last_seen").alias("until"))
    held = held.join(products(spark, sf).select("product_id", "kind"), "product_id")
    days = held.select("kind", F.col("from").alias("day")).distinct()
    # one number that orders as (price_cents, product_id): the least of structs cannot be hashed, and would sort every range of every stretch
    step, shift = (F.lit(x).cast("decimal(20,0)") for x in (str(2**64), str(2**63)))
    packed = (F.col("price_cents").cast("decimal(19,0)") * step + (F.col("product_id").cast("decimal(19,0)") + shift)).cast("decimal(38,0)")
    least = periods.interval_least(days, held, ["kind"], ["store"], "day", "from", "until", "is_last", packed)
    least = least.withColumn("_low", F.pmod("least", step.cast("decimal(38,0)")))
    return least.select("kind", "day", "store", ((F.col("least") - F.col("_low")) / step).cast("long").alias("price_cents"), (F.col("_low") - shift).cast("long").alias("product_id"))


@query("""with m as (select *, event_type = 'error' as hit, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events)
  select event_id, user_id, coalesce(sum(hit::int) over (partition by user_id, run order by ts, event_id rows unbounded preceding), 0)::bigint as streak,
    hit and sum(hit::int) over (partition by user_id, run order by ts, event_id rows unbounded preceding) = 3 as reached from m""")
def dead_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """T4 ST3 W6: consecutive dead sightings, and where they reach three."""
    rows = periods.streaks(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3)
    return rows.select("event_id", "user_id", "streak", "reached")


@query("""with m as (select user_id, sum(case when event_type in ('view', 'click') then 0 else 1 end) over (partition by user_id order by event_id desc rows unbounded preceding) as broken from events)
  select user_id, count(*) filter (where broken = 0) as streak from m group by 1""")
def newest_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the newest run of rows that agree."""
    return periods.newest_streak(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type").isin("view", "click"))


@query(f"""with {RUNS}, b as (select *, median(collected) over w as baseline, count(collected) over w as n_before from runs window w as (partition by section order by run rows between 5 preceding and 1 preceding))
  select run, section, collected, baseline::double as baseline, n_before, round((collected - baseline) / baseline, 9)::double as drift from b""")
def run_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Each load against the median of the five before."""
    return quality.rolling_baseline(runs(spark, sf), ["section"], "run", "collected").withColumn("drift", F.round("drift", 9))


@query(f"""with {RUNS}, a as (select strftime((run || '-01')::date + interval 1 month, '%Y-%m') as run, section, collected as "before" from runs), b as (select run, section, collected as now from runs)
  select run, section, "before", now, case when now is null or (now = 0 and "before" > 0) then 'missing' when "before" is null then 'new' when "before" >= 50 and now < 0.8 * "before" then 'dropped' else 'ok' end as state from a full join b using (run, section) where run in (select run from runs)""")
def section_drops(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 Q2 H6: sections that lost rows from one load to the next, over all loads."""
    r = runs(spark, sf)
    shifted = r.withColumn("run", F.date_format(F.add_months(F.to_date(F.concat("run", F.lit("-01"))), 1), "yyyy-MM")).join(r.select("run").distinct(), "run", "left_semi")
    return quality.drop_warnings(r, shifted, ["run", "section"], "collected")


@query("""with r as (select o_orderstatus as file, strftime(o_orderdate, '%Y-%m') as run, count(*) as entries from orders group by 1, 2),
  w as (select *, lag(entries) over o as last, lag(entries, 2) over o as second, max(entries) over (partition by file order by run rows between unbounded preceding and 1 preceding) as high from r window o as (partition by file order by run))
  select file, run, entries, case when high is null then 'first' when entries >= 0.8 * high then 'trusted' when coalesce(abs(entries - last) <= greatest(50, 0.005 * entries) and abs(entries - second) <= greatest(50, 0.005 * entries), false) then 'accepted' else 'doubted' end as trust from w""")
def load_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 ST9: whether a load's size is believed."""
    r = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("file"), F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.count("*").alias("entries"))
    return quality.sitemap_verdict(r, "file", "run", "entries")


@query("""with a as (select l_partkey, min(l_extendedprice) as p, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), b as (select l_partkey, min(l_extendedprice) as p, count(*) as n from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1)
  select coalesce(a.l_partkey, b.l_partkey) as l_partkey, a.p as was_price, b.p as now_price,
    case when b.n is null then 'disappeared' when a.n is null then 'new' when greatest(a.p, b.p) / least(a.p, b.p) >= 5 then 'absurd' when abs(b.p - a.p) / a.p >= 0.5 then 'mover' when a.n <> b.n then 'renamed' else 'same' end as state
  from a full join b on a.l_partkey = b.l_partkey""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every item between two snapshots (its row count stands for its name)."""
    l = table(spark, sf, "lineitem")
    side = lambda c: l.filter(c).groupBy("l_partkey").agg(F.min("l_extendedprice").alias("p"), F.count("*").alias("n"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return quality.run_diff(side(F.col("l_shipdate") >= cut), side(F.col("l_shipdate") < cut), "l_partkey", "p", "n").select("l_partkey", "was_price", "now_price", "state")


@query("""with a as (select l_partkey as k, count(*) as n, max(l_quantity) as q from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), b as (select l_partkey as k, count(*) as n, max(l_quantity) as q from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1)
  select k, 'n' as field, a.n::varchar as was, b.n::varchar as now from a join b using (k) where a.n <> b.n union all select k, 'q', a.q::varchar, b.q::varchar from a join b using (k) where a.q <> b.q""")
def field_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Field-level change log between two snapshots."""
    l = table(spark, sf, "lineitem")
    side = lambda c: l.filter(c).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return periods.field_changes(side(F.col("l_shipdate") < cut), side(F.col("l_shipdate") >= cut), "k", ["n", "q"])


@query("""with a as (select distinct o_custkey as id from orders where o_orderdate < timestamp '1998-01-01'), b as (select distinct o_custkey as id from orders where o_orderdate >= timestamp '1998-01-01')
  select coalesce(a.id, b.id) as id, case when b.id is null then 'vanished' else 'appeared' end as change from a full join b on a.id = b.id where a.id is null or b.id is null""")
def appeared_vanished(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric difference with its direction."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return quality.appeared_vanished(o.filter(F.col("o_orderdate") >= cut), o.filter(F.col("o_orderdate") < cut), "id")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders) and c_nationkey not in (select s_nationkey from supplier)")
def unseen_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Published ids in neither of two tables, by anti-joins."""
    c, o, s = (table(spark, sf, t) for t in ("customer", "orders", "supplier"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").join(s, c.c_nationkey == s.s_nationkey, "left_anti").select("c_custkey")


BASKET = f"""{LISTINGS}, lines as (select l_orderkey as basket, l_partkey as item, sum(cast(l_quantity as bigint)) as quantity from lineitem where l_quantity > 0 group by 1, 2),
known as (select store, product_id as item, price_cents from listings where price_cents is not null), everywhere as (select item, count(distinct store) = 5 as everywhere from known group by 1),
totals as (select basket, store, sum(case when everywhere then quantity * price_cents end)::bigint as comparable_cents, sum(quantity * price_cents)::bigint as full_cents, count(*) filter (where everywhere) as n_comparable, count(*) as n_priced
  from lines join known using (item) join everywhere using (item) group by 1, 2)"""


@query(f"""with {BASKET} select g.basket, g.store, comparable_cents, full_cents, coalesce(n_comparable, 0) as n_comparable, coalesce(n_priced, 0) as n_priced, n_items - coalesce(n_priced, 0) as n_missing
  from (select basket, count(*) as n_items, r_name as store from lines cross join region group by basket, r_name) g left join totals t on g.basket = t.basket and g.store = t.store""")
def basket_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Comparable and full totals of every basket at every store."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("quantity"))
    return compare.basket(lines, listings(spark, sf).select(F.col("product_id").alias("item"), "store", "price_cents"), stores(spark, sf))


@query("""with c as (select c_custkey, lpad((c_custkey * 7919)::varchar, 14, '0') as g from customer),
  d as (select *, list_sum(list_transform(range(1, 15), lambda i: cast(g[i] as int) * case when i % 2 = 1 then 3 else 1 end)) % 10 = 0 as valid from c)
  select c_custkey, g as gtin, valid, case when valid and g[2] <> '2' and g <> '00000000000000' then g end as matchable from d""")
def trade_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """X11: padding, check digit and restricted numbers."""
    c = table(spark, sf, "customer").withColumn("raw", (F.col("c_custkey") * 7919).cast("string"))
    g = codes.normalize_gtin(F.col("raw"))
    return c.select("c_custkey", g.alias("gtin"), codes.check_digit_ok(g).alias("valid"), codes.matchable_gtin(F.col("raw")).alias("matchable"))


TOKENS = r"""t as (select doc_id, source, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: len(x) > 1)) as tokens from documents)"""


@query(rf"with {TOKENS} select doc_id, len(tokens)::int as n_tokens, array_to_string(list_sort(tokens), ' ') as tokens from t")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct accent-free words of a whole text."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text.plain(F.col("text")), "[^a-z0-9 ]", " "), " +", " "))
    tokens = F.array_distinct(F.filter(F.split(clean, " "), lambda t: F.length(t) > 1))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("""select p_partkey, regexp_replace(lower(strip_accents(p_brand)), '[^a-z0-9]', '', 'g') as brand, list_transform(string_split(lower(p_name), ' '), lambda x: case when x like '%oes' and len(x) >= 5 then x[:-4] || 'ao' when x like '%aes' and len(x) >= 4 then x[:-4] || 'ao' when x like '%ais' and len(x) >= 5 then x[:-4] || 'al' when x like '%s' and len(x) >= 4 then x[:-2] else x end) as folded, replace(lower(p_name), ' ', '-') as slug from part""")
def folded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Plural folding, brand keys, slugs."""
    return table(spark, sf, "part").select("p_partkey", text.normalize_brand(F.col("p_brand")).alias("brand"), F.transform(F.split(F.lower("p_name"), " "), text.fold_plural).alias("folded"), text.section_key(F.col("p_name")).alias("slug"))


@query("""select p_partkey, p_size, case when p_size % 4 = 1 and p_size < 10 then null else case p_size % 4 when 0 then case when p_size <= 30 then p_size * 1.0::double end when 1 then p_size / 1000.0 * 6 when 2 then p_size / 100.0 else p_size * 1.0 end end::double as total, case when (p_size % 4 = 0 and p_size > 30) or (p_size % 4 = 1 and p_size < 10) then null else case p_size % 4 when 0 then 'kg' when 1 then 'l' when 2 then 'l' else 'un' end end as unit, case when (p_size % 4 = 0 and p_size > 30) or (p_size % 4 = 1 and p_size < 10) then null when p_size % 4 = 1 then 6 else 1 end as pack_count
  from part""")
def parsed_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes read back from names made with thousands dots, multipacks, centilitres and units; over 30 kg and under one centilitre is refused."""
    n = F.col("p_size").cast("string")
    name = F.concat("p_name", F.lit(" "), F.when(F.col("p_size") % 4 == 0, F.concat(n, F.lit(".000 g"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("6 x "), n, F.lit(" ml"))).when(F.col("p_size") % 4 == 2, F.concat(n, F.lit("cl"))).otherwise(F.concat(n, F.lit(" un"))))
    rows = table(spark, sf, "part").withColumn("s", measures.parse_size(name))
    return rows.select("p_partkey", "p_size", "s.total", "s.unit", "s.pack_count")


ITEMS = f"""{PRODUCTS}, items as (select product_id as id, product_id % 5 as store, brand, size, unit, own_brand, lower(name) as name, case when product_id % 3 <> 0 then product_id // 6 end as gtin, case when product_id % 7 <> 0 and size > 0 then p_retailprice * (1 + product_id % 4) / size end as unit_price, list_distinct(list_append(string_split(lower(name), ' '), lower(kind))) as tokens from products join part on p_partkey = product_id)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Products as items of five stores, with trade item numbers (six neighbours share one) and unit prices, both unknown for some."""
    p = products(spark, sf, "p_retailprice")
    key = F.col("product_id")
    gtin = F.when(key % 3 != 0, F.floor(key / 6))
    price = F.when((key % 7 != 0) & (F.col("size") > 0), F.col("p_retailprice") * (1 + key % 4) / F.col("size"))
    tokens = F.array_distinct(F.concat(F.split(F.lower("name"), " "), F.array(F.lower("kind"))))
    return p.select(key.alias("id"), (key % 5).alias("store"), "brand", "size", "unit", "own_brand", F.lower("name").alias("name"), gtin.alias("gtin"), price.alias("unit_price"), tokens.alias("tokens"))


PAIRS = f"""{ITEMS}, x as (select id, store, unnest(tokens) as token from items), df as (select store as target, token, count(*) as df from x group by 1, 2),
known as (select i.id, t.target from items i join (select distinct brand, store as target from items where brand <> '') t on i.brand = t.brand and t.target <> i.store),
keys as (select id, target, token from (select x.id, df.target, x.token, df, row_number() over (partition by x.id, df.target order by df, x.token) as rank from x join df on x.token = df.token and df.target <> x.store left join known k on x.id = k.id and df.target = k.target where k.id is null) where rank = 1 or (rank <= 2 and df <= 400)),
looked as (select i.id as i, j.id as j, 1 as prio from known k join items i on k.id = i.id join items j on j.store = k.target and j.brand = i.brand union all select distinct keys.id, x.id, 2 from keys join x on x.store = keys.target and x.token = keys.token),
scored as (select l.*, p.store as store, q.store as target, len(list_intersect(p.tokens, q.tokens)) / len(list_distinct(list_concat(p.tokens, q.tokens))) as score from looked l join items p on l.i = p.id join items q on l.j = q.id),
kept as (select * from scored where score >= 0.45 qualify row_number() over (partition by i, target order by score desc, j) <= 5),
coded as (select a.id as a, b.id as b, a.store as store_a, b.store as store_b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) as score from items a join items b on a.gtin = b.gtin and a.id < b.id and a.store <> b.store),
pairs as (select a, b, any_value(store_a) as store_a, any_value(store_b) as store_b, any_value(score) as score, case min(prio) when 1 then 'brand' when 2 then 'token' else 'gtin' end as block from (
  select least(i, j) as a, greatest(i, j) as b, case when i < j then store else target end as store_a, case when i < j then target else store end as store_b, score, prio from kept union all select a, b, store_a, store_b, score, 3 from coded) group by 1, 2)"""


@query(f"with {PAIRS} select a, b, store_a, store_b, score, block from pairs")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Blocked and scored candidate pairs."""
    return resolve.candidate_pairs(_items(spark, sf), gtin="gtin")


LADDER = f"""{PAIRS}, sides as (select p.*, i.gtin as ga, j.gtin as gb, i.own_brand and j.own_brand as own, i.brand = j.brand as same_brand, i.size is not null and j.size is not null as known,
    coalesce(i.unit = j.unit and greatest(i.size, j.size) > 0 and i.size is not null and j.size is not null and (greatest(i.size, j.size) - least(i.size, j.size)) / greatest(i.size, j.size) <= 0.05, false) as same_size,
    case when i.unit_price is not null and j.unit_price is not null then (greatest(i.unit_price, j.unit_price) - least(i.unit_price, j.unit_price)) / greatest(i.unit_price, j.unit_price) end as gap,
    contains(i.name, 'plated') <> contains(j.name, 'plated') or contains(i.name, 'polished') <> contains(j.name, 'polished') as qualified from pairs p join items i on p.a = i.id join items j on p.b = j.id),
ladder as (select a, b, case when ga is not null and gb is not null and ga <> gb and not own and not (known and not same_size) then 'reject' when ga = gb then 'ean' when same_brand and same_size and score >= 0.7 then case when qualified then 'fuzzy' else 'exact' end when score >= 0.45 and known and not same_size then 'cross-size' when score >= 0.45 then 'fuzzy' else 'reject' end as rung, coalesce(gap > 0.4, false) as dear from sides)"""

QUALIFIERS = [("plated", "plated"), ("polished", "polished")]


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    side = lambda s: items.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("gtin", "brand", "size", "unit", "unit_price", "own_brand", "name")))
    pairs = resolve.candidate_pairs(items, gtin="gtin").join(side("a"), "a").join(side("b"), "b")
    both = [F.col(f"{c}_{s}") for c in ("gtin", "brand") for s in "ab"] + [F.col(f"{c}_{s}") for s in "ab" for c in ("size", "unit")] + [F.col(f"unit_price_{s}") for s in "ab"]
    c = resolve.classify(F.col("score"), *both, text.qualifier_mismatch(F.col("name_a"), F.col("name_b"), QUALIFIERS), F.col("own_brand_a"), F.col("own_brand_b"))
    return pairs.withColumn("c", c).select("a", "b", "c.rung", "c.veto")


@query(f"with {LADDER} select a, b, rung, case when rung = 'reject' then 'REJECTED' when rung in ('ean', 'exact') and not dear then 'CONFIRMED' else 'REVIEW' end as verdict from ladder")
def pair_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Rung of the ladder and verdict of every pair, with numbers, unit prices, qualifiers and own brands."""
    return _ladder(spark, sf).select("a", "b", "rung", resolve.verdict(F.col("rung"), F.col("veto")).alias("verdict"))


@query(f"""with {PAIRS}, found as (select distinct least(i, j) as a, greatest(i, j) as b from kept)
  select count(*) as n_true, count(f.a) as n_found, count(f.a) / count(*) as recall from coded t left join found f on t.a = f.a and t.b = f.b""")
def pairs_recalled(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of different stores with one number the lookups by brand and words find without the number."""
    items = _items(spark, sf)
    coded = items.filter("gtin is not null").select("id", "store", "gtin")
    b = coded.select(F.col("id").alias("b"), F.col("store").alias("store_b"), "gtin")
    truth = coded.select(F.col("id").alias("a"), "store", "gtin").join(b, "gtin").filter("a < b and store <> store_b").select("a", "b")
    return resolve.recall(resolve.candidate_pairs(items), truth)


REACH = f"""{LADDER}, strong as (select a, b from ladder where rung in ('ean', 'exact') and not dear), links as (select a, b from strong union select b, a from strong),
  reach as (select a as id, a as other from links union select reach.id, links.b from reach join links on reach.other = links.a)"""


@query(f"""with recursive {REACH} select id, min(other) as component from reach group by 1""")
def product_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of confirmed pairs."""
    return resolve.components(_ladder(spark, sf).filter("rung in ('ean', 'exact') and veto is null").select("a", "b"))


@query(f"""with recursive {REACH}, members as (select r.id, component, store, size, unit, gtin, r.id % 2 = 0 as expected from (select id, min(other) as component from reach group by 1) r join items using (id)),
  inside as (select component, count(*) as n_links, count(*) filter (where rung not in ('ean', 'exact')) as weak from ladder join members on a = members.id where rung in ('ean', 'exact', 'cross-size') and b in (select id from members m where m.component = members.component) group by 1),
  refused as (select distinct m.component from members m join members o on o.id = m.id + 1 and o.component = m.component where m.id % 50 = 0),
  twice as (select distinct component from (select component, store from members group by 1, 2 having count(*) > 1 and (count(gtin) < count(*) or count(distinct gtin) > 1))),
  stats as (select component, count(*) as n, count(distinct store) as n_stores, max(size) as hi, min(size) as lo, count(distinct unit) as units, count(distinct gtin) as codes, bool_or(expected and gtin is null) as missing from members group by 1),
  flagged as (select component, n, n_stores, list_filter([case when component in (select component from twice) then 'duplicate-store' end, case when codes > 1 or missing then 'barcode-unconfirmed' end, case when coalesce(weak, 1) > 0 then 'weak-links-only' end, case when n > 2 * n_stores then 'oversized' end, case when units > 1 or (hi - lo) / hi > 0.05 then 'size-spread' end, case when component in (select component from refused) then 'refused-pair' end], lambda x: x is not null) as flags from stats left join inside using (component))
  select *, len(list_intersect(flags, ['oversized', 'size-spread', 'refused-pair'])) = 0 as emit from flagged""")
def group_guards(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks against each group, refused pairs among it, and whether it is shown."""
    # written once: components, links and their guards read it
    links = resolve.checkpoint(_ladder(spark, sf).filter("rung in ('ean', 'exact', 'cross-size')"))
    items = _items(spark, sf).withColumn("expected", F.col("id") % 2 == 0)
    found = resolve.components(links.filter("rung <> 'cross-size' and veto is null").select("a", "b"))
    members = found.join(items, "id")
    other = found.select(F.col("id").alias("b"), F.col("component").alias("same"))
    inside = links.select("a", "b", "rung").join(found.withColumnRenamed("id", "a"), "a").join(other, "b").filter("component = same").select("a", "b", "rung")
    refused = items.filter("id % 50 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return resolve.guards(members, inside, refused)


@query()
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of groups carried over to new clusters; tested against greedy assignment."""
    c = table(spark, sf, "customer")
    old = c.select((F.col("c_nationkey") * 10 + F.col("c_custkey") % 3).alias("group"), F.col("c_custkey").alias("member"))
    new = c.select((F.col("c_nationkey") * 100 + F.col("c_custkey") % 5).alias("cluster"), F.col("c_custkey").alias("member"))
    return resolve.reconcile_ids(old, new)


KINDS = [rules.Rule("ring", ("small", "economy")), rules.Rule("tube", require="steel|brass", exclude="plated"), rules.Rule("metal", require="tin|copper|nickel"), rules.Rule("other", exclude="zzz")]
LABELS = [rules.Rule("bright", require="polished|burnished"), rules.Rule("coated", require="plated|anodized"), rules.Rule("metal", require="steel|tin|copper|nickel|brass", kinds=("STANDARD", "PROMO", "ECONOMY"))]


@query("""with p as (select p_partkey, lower(p_name || ' ' || p_type) as name, string_split(lower(p_name || ' ' || p_type), ' ')[1] as head, p_type from part)
  select p_partkey, case when head in ('small', 'economy') then 'ring' when regexp_matches(name, 'steel|brass') and not regexp_matches(name, 'plated') then 'tube' when regexp_matches(name, 'tin|copper|nickel') then 'metal' else 'other' end as kind,
    list_filter([case when regexp_matches(name, 'polished|burnished') then 'bright' end, case when regexp_matches(name, 'plated|anodized') then 'coated' end, case when regexp_matches(name, 'steel|tin|copper|nickel|brass') and p_type in ('STANDARD', 'PROMO', 'ECONOMY') then 'metal' end], lambda x: x is not null) as labels from p""")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    """K2 K4 K5 K6 F8: first rule that matches, and gated labels."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", rules.first_match(KINDS, name).alias("kind"), rules.label_set(LABELS, name, F.col("p_type")).alias("labels"))


@query("""with p as (select p_partkey, p_type as kind, p_brand from part), i as (select p_partkey, case when p_partkey % 14 = 0 then null else 'item' end as v from part where p_partkey % 7 = 0), g as (select distinct p_brand, 'group' as v from part where p_brand like '%2')
  select p.p_partkey, case when i.p_partkey is not null then i.v when g.p_brand is not null then g.v else kind end as final, case when i.p_partkey is not null then 'item' when g.p_brand is not null then 'group' else 'rule' end as source from p left join i on p.p_partkey = i.p_partkey left join g on p.p_brand = g.p_brand""")
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Item override, then group override, then the rule; null overrides count."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind"), "p_brand")
    by_item = p.filter("p_partkey % 7 = 0").select("p_partkey", F.when(F.col("p_partkey") % 14 != 0, "item").alias("kind"))
    by_group = p.filter(F.col("p_brand").endswith("2")).select("p_brand").distinct().withColumn("kind", F.lit("group"))
    return rules.with_overrides(p, by_item, by_group, "p_partkey", "p_brand", "kind").select("p_partkey", "final", "source")


@query(f"""with {LISTINGS}, l as (select store, max(last_seen) as latest from listings group by 1) select li.store, product_id, last_seen from listings li join l on li.store = l.store where last_seen >= latest - interval 14 day""")
def current_only(spark: SparkSession, sf: str) -> DataFrame:
    """F2 T19 ST7: rows of each store seen within 14 days of that store's own newest."""
    rows = listings(spark, sf)
    fresh = rows.groupBy("store").agg(F.max("last_seen").alias("latest"))
    return rows.join(fresh, "store").filter(F.col("last_seen") >= F.date_sub("latest", 14)).select("store", "product_id", "last_seen")


@query("""select o_orderkey, (o_orderstatus <> 'F' or o_orderpriority is null) and o_orderpriority in ('1-URGENT', '2-HIGH') as wanted, starts_with(o_orderpriority, '1') as urgent, case when o_totalprice > 0.01 then floor(o_totalprice * 100 + 0.5)::bigint end as cents, case when o_orderstatus <> 'P' then o_totalprice end as for_sale from orders""")
def predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Filters and masks as columns."""
    o = table(spark, sf, "orders")
    wanted = (F.col("o_orderstatus") != "F") | F.col("o_orderpriority").isNull()
    return o.select("o_orderkey", (wanted & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("wanted"), F.col("o_orderpriority").startswith("1").alias("urgent"), measures.cents(measures.sellable_price(F.col("o_totalprice"))).alias("cents"), measures.for_sale(F.col("o_totalprice"), F.col("o_orderstatus") != "P").alias("for_sale"))


@query("""select p_partkey, p_retailprice / nullif(case when p_size % 10 <> 0 then p_size end, 0) as per_unit, case when p_size % 10 = 0 or p_size % 7 = 0 then 'doubtful' when p_size <= 25 then 'ok' else 'large' end as verdict from part where p_size % 10 <> 0""")
def comparable_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Comparable rows and an ordered verdict."""
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") % 10 != 0, F.col("p_size")))
    verdict = F.when((F.col("p_size") % 10 == 0) | (F.col("p_size") % 7 == 0), "doubtful").when(F.col("p_size") <= 25, "ok").otherwise("large")
    return p.filter(compare.comparable(F.col("p_retailprice"), F.col("size"), F.lit("un"))).select("p_partkey", measures.unit_price(F.col("p_retailprice"), F.col("size")).alias("per_unit"), verdict.alias("verdict"))


@query("""with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank, count(*) over (partition by o_custkey) as n from orders)
  select o_custkey, list({'day': day, 'o_orderkey': o_orderkey} order by day, o_orderkey) as orders from o where rank > n - 5 group by 1""")
def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """S3: one-to-many relation as an array of structs (the newest five of each)."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    few = o.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("o_custkey", F.struct(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey").alias("s"))
    return few.groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("orders"))


@query("""select s_suppkey, s_acctbal, row_number() over (order by (case when s_suppkey % 5 = 0 then null else s_acctbal end) asc nulls last, s_suppkey)::int as cheapest_first, row_number() over (order by (case when s_suppkey % 5 = 0 then null else s_acctbal end) desc nulls last, s_suppkey)::int as newest_first, row_number() over (order by s_suppkey % 5 <> 0, s_acctbal, s_suppkey)::int as stalest_first from supplier""")
def orderings(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls last in both directions, never-checked first."""
    s = table(spark, sf, "supplier").withColumn("v", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")))
    v, key = F.col("v"), F.col("s_suppkey")
    out = ordered.places(s, "cheapest_first", [v.isNull(), v, key])
    out = ordered.places(out, "newest_first", [v.isNull(), -v, key])
    out = ordered.places(out, "stalest_first", [key % 5 != 0, F.col("s_acctbal"), key])
    return out.select("s_suppkey", "s_acctbal", *(F.col(c).cast("int").alias(c) for c in ("cheapest_first", "newest_first", "stalest_first")))


@query("""select p_partkey, p_type, sha256('7' || p_partkey::varchar) as draw from part qualify row_number() over (partition by p_type order by sha256('7' || p_partkey::varchar), p_partkey) <= 5""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five of each cell in hash order."""
    p = table(spark, sf, "part").withColumn("draw", F.sha2(F.concat(F.lit("7"), F.col("p_partkey").cast("string")), 256))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("p_type").orderBy("draw", "p_partkey"))).filter("rank <= 5").select("p_partkey", "p_type", "draw")


@query("""select c_custkey, c_mktsegment, turn::int as turn from (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as turn from customer) order by turn, c_mktsegment limit 12""")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in turn from every group."""
    c = table(spark, sf, "customer").withColumn("neg", -F.col("c_acctbal"))
    return quality.round_robin(c, "c_mktsegment", ["neg", "c_custkey"], 12).select("c_custkey", "c_mktsegment", "turn")


@query("""with r as (select o_orderkey as id, o_custkey % 10 as host, o_orderdate as s, o_orderdate + interval 1 day * (o_orderkey % 3) as e from orders), m as (select *, max(e) over (partition by host order by s, id rows between unbounded preceding and 1 preceding) as reach from r)
  select id, host, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by host order by s, id rows unbounded preceding)::bigint as cluster from m""")
def run_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """W8 ST6: overlapping runs as one night."""
    o = table(spark, sf, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("host"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 3 as int))").alias("e"))
    return periods.clusters(r, ["host"], "s", "e", "id").select("id", "host", "cluster")


@query("""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id, ts, value from events where event_type = 'view')
  select l.event_id, l.user_id, (select arg_max(r.value, r.ts) from r where r.user_id = l.user_id and r.ts < l.ts) as as_of from l""")
def as_of_view(spark: SparkSession, sf: str) -> DataFrame:
    """Newest earlier value of the same key."""
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return periods.as_of(left, e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value"), ["user_id"], "ts", "seen", "value").select("event_id", "user_id", "as_of")


@query("""with s as (select event_id, user_id, epoch(ts)::bigint as sec, cast(ts as date) as day from events)
  select event_id, user_id, recent, recent <= 2 and today < 300 as allowed from (select *, count(*) over (partition by user_id order by sec range between 86399 preceding and current row) as recent, count(*) over (partition by day order by sec, event_id rows between unbounded preceding and 1 preceding) as today from s)""")
def sliding_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Q19 ST4: sliding limit per key and daily total."""
    e = table(spark, sf, "events")
    return quality.limiter(e, "user_id", "ts", "event_id", 2, 86400, 300).select("event_id", "user_id", "recent", "allowed")


@query("""with d as (select cast(ts as date) as day, count(*) as n from events group by 1), m as (select *, median(n) over (order by day rows between unbounded preceding and 1 preceding) as "before", count(n) over (order by day rows between unbounded preceding and 1 preceding) as c from d)
  select day, n, "before"::double as "before", coalesce(c >= 3 and n > 1.05 * "before", false) as unusual from m""")
def unusual_days(spark: SparkSession, sf: str) -> DataFrame:
    """Q18 Q12: days above a multiple of the median of earlier days."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.unusual_usage(d, "day", "n", 1.05)


@query("""with r as (select p_partkey as id, p_size = 1 as changed, p_size = 2 as reported, p_size > 45 as odd, p_size % 2 = 0 as unread, p_size % 7 as days_since from part),
  m as (select *, case when changed then 'changed' when reported then 'reported' when unread then 'unread' when days_since >= 3 then 'reread' end as reason from r), k as (select id, reason, row_number() over (partition by reason order by odd desc, sha256('x' || id::varchar), id)::int as place from m where reason is not null)
  select id, reason, place from k where reason in ('changed', 'reported') or (reason = 'unread' and place <= 300) or (reason = 'reread' and place <= 75)""")
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to review, by reason and pace (the feature's limits)."""
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") == 1).alias("changed"), (F.col("p_size") == 2).alias("reported"), (F.col("p_size") > 45).alias("odd"), (F.col("p_size") % 2 == 0).alias("unread"), (F.col("p_size") % 7).alias("days_since"))
    return quality.select_review(r, "x", 300, 75).select("id", "reason", "place")


@query("""with p as (select p_partkey, p_brand, p_type, p_partkey % 5 as store from part)
  select a.p_partkey, case when count(b.p_type) = 0 then 'none' when count(distinct b.p_type) = 1 and any_value(b.p_type) = a.p_type then 'high' else 'review' end as certainty from p a left join p b on a.p_brand = b.p_brand and a.store <> b.store group by a.p_partkey, a.p_type""")
def kind_certainty(spark: SparkSession, sf: str) -> DataFrame:
    """K8 in its simple form: agreement with other stores' items of the same brand; see kinds_certain."""
    p = table(spark, sf, "part").withColumn("store", F.col("p_partkey") % 5)
    return rules.certainty(p, "p_partkey", "store", "p_brand", "p_type")


@query("""with h as (select page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '[-/_]([0-9]{3,})(?:\\.html)?/?(?:[?#].*)?$', 1) as pid, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as n_links from pages)
  select page_id, host, nullif(pid, '') as product_id, replace(replace(replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&euro;', '€'), '&amp;', '&') as title, n_links::int as n_links from h""")
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of pages by patterns, entities decoded."""
    p = table(spark, sf, "pages")
    title = ingest.decode_entities(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return p.select("page_id", ingest.host(F.col("url")).alias("host"), ingest.product_id(F.col("url")).alias("product_id"), title.alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"))


@query("""select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host, count(*) as requests, count(*) filter (where page_id % 50 = 0) as failed, sum(strlen(html))::bigint as bytes, (sum(page_id % 100)::double / count(*)) as mean_millis from pages group by 1""")
def host_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, failures and bytes by host."""
    r = table(spark, sf, "pages").select("url", F.when(F.col("page_id") % 50 == 0, 500).otherwise(200).alias("status"), F.octet_length("html").cast("long").alias("bytes"), (F.col("page_id") % 100).alias("millis"))
    return ingest.request_stats(r)


@query("""select event_type, sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0))::bigint as total, count(*) filter (where json_extract_string(props, '$.k') is null) as bad from events group by 1""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """JSON payloads, what cannot be read counted."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.coalesce(k.try_cast("long"), F.lit(0))).alias("total"), F.count_if(k.isNull()).alias("bad"))


@query("""with a as (select l_partkey as k, l_suppkey as v, 0 as w, l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'), b as (select l_partkey, l_suppkey, 1, l_orderkey, l_linenumber from lineitem where l_returnflag = 'A'), c as (select l_partkey, l_suppkey, 2, l_orderkey, l_linenumber from lineitem where l_returnflag is null or l_returnflag not in ('R', 'A'))
  select k, v from (select * from a union all select * from b union all select * from c) qualify row_number() over (partition by k order by w, v) = 1""")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Union of walks, the earliest walk's row of each key."""
    l = table(spark, sf, "lineitem")
    flag = F.coalesce("l_returnflag", F.lit(""))
    walk = lambda c: l.filter(c).select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"))
    return ingest.first_wins([walk(flag == "R"), walk(flag == "A"), walk(~flag.isin("R", "A"))], ["k"])


@query("""with o as (select c_custkey as id, c_acctbal as price, c_name as name, c_custkey % 4 as dead_count, c_custkey % 4 = 3 as delisted from customer where c_custkey % 3 <> 0), n as (select c_custkey as id, case when c_custkey % 4 = 0 then null else c_acctbal + 1 end as price, c_custkey % 2 = 0 as set_price from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0)
  select coalesce(o.id, n.id) as id, case when n.set_price then n.price else o.price end as price, o.name, case when n.id is not null then 0 else o.dead_count end::bigint as dead_count, case when n.id is not null then false else o.delisted end as delisted from o full join n on o.id = n.id""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Merge where absent keeps and null clears, and a sighting revives."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    old = c.filter("id % 3 <> 0").select("id", F.col("c_acctbal").alias("price"), F.col("c_name").alias("name"), (F.col("id") % 4).alias("dead_count"), (F.col("id") % 4 == 3).alias("delisted"))
    new = c.filter("id % 2 = 0 or id % 3 = 0").select("id", F.when(F.col("id") % 4 != 0, F.col("c_acctbal") + 1).alias("price"), (F.col("id") % 2 == 0).alias("set_price"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("set_name"))
    return quality.merge_upsert(old, new, ["id"], ["price", "name"])


@query("""with s as (select count(*) filter (where o_totalprice > 400000) <= 0.05 * count(*) as ok from orders) select o_orderkey, ok and o_totalprice > 400000 as stopped from orders, s""")
def guarded_mark(spark: SparkSession, sf: str) -> DataFrame:
    """M5 M7: mark rows, unless they are too many."""
    o = table(spark, sf, "orders")
    return quality.guarded_mark(o, o.filter("o_totalprice > 400000").select("o_orderkey"), "o_orderkey", "stopped", 0.05).select("o_orderkey", "stopped")


@query("""with c as (select o_orderstatus as status, count(*) as attempted, count(*) filter (where o_orderpriority = '1-URGENT') as dead, count(*) filter (where o_orderpriority = '5-LOW') as swapped from orders group by 1)
  select status, list_filter([case when attempted >= 500 and dead / attempted > 0.1 then 'dead-pages' end, case when attempted >= 500 and swapped / attempted > 0.02 then 'barcode-swaps' end], lambda x: x is not null) as reasons from c""")
def load_brakes(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 Q6 Q11 Q22: reasons to stop, from one row of counts per load."""
    c = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("attempted"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("dead"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("swapped"))
    c = c.withColumn("compared", F.col("attempted")).withColumn("complete", F.lit(True)).withColumn("dead_limit", F.lit(0.1))
    for name in ("non_food", "lost", "changed", "turnover", "tiles", "malformed", "kept", "uncategorised", "unavailable", "live", "missing"):
        c = c.withColumn(name, F.lit(0))
    return quality.brakes(c.withColumn("unchanged", F.lit(1))).select("status", "reasons")


@query("""select o_orderkey, date_diff('day', cast(o_orderdate as date), date '2001-06-30') >= case when o_orderkey % 5 = 0 then -100000 when o_orderkey % 40 < 7 then 7 when o_orderkey % 40 < 30 then 30 else 90 + o_orderkey % 40 end as due from orders""")
def rechecks(spark: SparkSession, sf: str) -> DataFrame:
    """Which delisted rows are due for another check."""
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    checked = F.when(F.col("o_orderkey") % 5 != 0, F.date_add("d", (F.col("o_orderkey") % 40).cast("int")))
    return o.select("o_orderkey", periods.recheck_due(F.col("d"), checked, F.lit("2001-06-30").cast("date")).alias("due"))


@query("""with old as (select o_orderkey as id, o_custkey as gtin from orders where o_orderdate < timestamp '1997-01-01'), new as (select o_orderkey as id, o_custkey as gtin from orders where o_orderdate >= timestamp '1997-01-01'), c as (select gtin, count(*) as n, min(id) as e from old group by 1)
  select new.id, gtin, case when n = 1 then e end as earlier_id, case when n = 1 then 'matched' else 'ambiguous' end as status from new join c using (gtin)""")
def reidentified(spark: SparkSession, sf: str) -> DataFrame:
    """New items matched to the one earlier item with their number."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gtin"), "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return resolve.match_earlier(o.filter(F.col("o_orderdate") >= cut).drop("o_orderdate"), o.filter(F.col("o_orderdate") < cut).drop("o_orderdate"))


@query("""with l as (select doc_id, quality = 1 as good from labels), d as (select doc_id, n_chars >= 200 as said from documents) select count(*) as n_true, count(*) filter (where said) as n_found, count(*) filter (where said) / count(*) as recall from l join d using (doc_id) where good""")
def rule_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of a rule against labelled truth."""
    truth = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    said = table(spark, sf, "documents").filter("n_chars >= 200").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    return resolve.recall(said, truth)
