"""Queries of the watching, merging, display and parsing operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import measures, shown, text
from shelfwise.operators import compare, periods, quality, resolve, rules, watch
from shelfwise.plans.catalog import LISTINGS, listings, table
from shelfwise.plans.queries import query


@query(f"""with {LISTINGS} select kind, case kind when 'STANDARD' then ['kg'] when 'PROMO' then ['un'] else coalesce(list_sort(list(distinct unit) filter (where price_cents is not null and size > 0 and unit in ('kg', 'l'))), []) end as units from listings group by kind""")
def units_present(spark: SparkSession, sf: str) -> DataFrame:
    """Units of each kind; kinds that may be sold in either show those they have."""
    rows = listings(spark, sf).withColumn("declared", F.when(F.col("kind") == "STANDARD", "kg").when(F.col("kind") == "PROMO", "un"))
    return watch.units_present(rows, "kind", "declared", "unit", compare.comparable(F.col("price_cents"), F.col("size"), F.col("unit")))


@query("select l_partkey, max(cast(l_shipdate as date)) as lastmod from lineitem group by 1")
def latest_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Newest date of each product, combined before the shuffle."""
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max(F.to_date("l_shipdate")).alias("lastmod"))


@query("""with listed as (select distinct l_partkey from lineitem where l_shipdate >= '2001-06-01'), p as (select p_partkey, case p_partkey % 5 when 0 then 'gone' when 1 then 'unavailable' when 2 then 'unreachable' else 'alive' end as page, p_size > 10 as list_read from part)
  select p_partkey, case when page in ('gone', 'unavailable') then page when list_read and l_partkey is null then 'unlisted' else page end as verdict from p left join listed on p_partkey = l_partkey""")
def missing_products(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: verdict on products that a walk missed."""
    listed = table(spark, sf, "lineitem").filter("l_shipdate >= '2001-06-01'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("listed")).distinct()
    page = F.when(F.col("p_partkey") % 5 == 0, "gone").when(F.col("p_partkey") % 5 == 1, "unavailable").when(F.col("p_partkey") % 5 == 2, "unreachable").otherwise("alive")
    rows = table(spark, sf, "part").join(listed, "p_partkey", "left")
    return rows.select("p_partkey", watch.missing_verdict(page, F.col("p_size") > 10, F.coalesce("listed", F.lit(False))).alias("verdict"))


@query("""with c as (select l_suppkey, count(*) as seen, count(*) filter (where l_tax > 0.01 and l_discount > 0.02) as is_on, count(*) filter (where l_tax > 0.01 and l_discount <= 0.02) as is_off, count(*) filter (where l_tax <= 0.01) as unknown from lineitem where l_suppkey % 3 > 0 or l_tax <= 0.01 group by 1)
  select l_suppkey, case when seen > 0 and unknown / seen > 0.05 then unknown / seen end as unknown_share, case when seen < 500 then null when unknown / seen > 0.5 then 'unknown' when is_on = 0 then 'none' when is_on / (is_on + is_off) > 0.7 then 'too many' end as warning from c""")
def promotion_watch(spark: SparkSession, sf: str) -> DataFrame:
    """Q11 Q12: share without a sign, and whether the promotion mark of a source looks wrong."""
    rows = table(spark, sf, "lineitem").filter("l_suppkey % 3 > 0 or l_tax <= 0.01")
    known, on = F.col("l_tax") > 0.01, F.col("l_discount") > 0.02
    c = rows.groupBy("l_suppkey").agg(F.count("*").alias("seen"), F.count_if(known & on).alias("is_on"), F.count_if(known & ~on).alias("is_off"), F.count_if(~known).alias("unknown"))
    return c.select("l_suppkey", watch.unknown_availability(F.col("seen"), F.col("unknown")).alias("unknown_share"), watch.promotion_warning(F.col("seen"), F.col("is_on"), F.col("is_off"), F.col("unknown")).alias("warning"))


@query("""with t as (select o_orderpriority as store, strftime(o_orderdate, '%Y-%m') as run, count(*) as total from orders group by 1, 2), b as (select *, lag(total) over (partition by store order by run) as previous_total from t)
  select store, run, total, previous_total, 100 * (total - previous_total) / previous_total as percent, coalesce(total < previous_total, false) as shrank from b""")
def size_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of each run against the one before."""
    totals = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("store"), F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.count("*").alias("total"))
    return watch.size_changes(totals, "store", "run", "total")


@query("""with s as (select p_type as run, case p_size % 3 when 0 then 'food' when 1 then 'mixed' else 'other' end as kind, p_size % 2 as depth, case p_partkey % 4 when 0 then 'undecided' when 1 then 'added' when 2 then 'vanished' end as state from part)
  select run, count(*) filter (where state = 'undecided') as undecided, count(*) filter (where state = 'added' and kind in ('food', 'mixed')) as worth_deciding, count(*) filter (where state = 'vanished' and depth = 1 and kind = 'food') as gone_food from s group by 1""")
def section_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: sections that need a decision, by run."""
    kind = F.when(F.col("p_size") % 3 == 0, "food").when(F.col("p_size") % 3 == 1, "mixed").otherwise("other")
    state = F.when(F.col("p_partkey") % 4 == 0, "undecided").when(F.col("p_partkey") % 4 == 1, "added").when(F.col("p_partkey") % 4 == 2, "vanished")
    return watch.section_problems(table(spark, sf, "part").select(F.col("p_type").alias("run"), kind.alias("kind"), (F.col("p_size") % 2).alias("depth"), state.alias("state")), "run")


@query("""with r as (select l_returnflag, count(*) - case l_returnflag when 'R' then 5 else 0 end as reported from lineitem group by 1), s as (select l_returnflag, count(*) as saved, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates, count(*) filter (where l_orderkey not in (select o_orderkey from orders where o_orderkey % 100 <> 0)) as orphans from lineitem group by 1)
  select l_returnflag, reported, saved, duplicates, orphans, reported = saved and duplicates = 0 and orphans = 0 as ok from r join s using (l_returnflag)""")
def saves_check(spark: SparkSession, sf: str) -> DataFrame:
    """Q15: saved against reported counts, duplicates and orphans."""
    saved = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    reported = saved.groupBy("l_returnflag").agg((F.count("*") - F.when(F.col("l_returnflag") == "R", 5).otherwise(0)).alias("reported"))
    return watch.reconcile(reported, saved, table(spark, sf, "orders").filter("o_orderkey % 100 <> 0"), "l_returnflag", ["o_orderkey", "l_linenumber"], "o_orderkey")


ANSWERS = """a as (select case when event_id % 50 = 0 then null else user_id end as line, cast(ts as date) as day, event_type as answer, event_id % 97 as size from events),
  j as (select *, case when size > 90 then 'too long' when answer not in ('view', 'click', 'purchase') then 'unknown answer' when line is null then 'no row' end as problem from a)"""


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("line"), F.to_date("ts").alias("day"), F.col("event_type").alias("answer"), (F.col("event_id") % 97).alias("size"))
    return watch.take_in_answers(e, "line", "day", "answer", F.col("size"), ["view", "click", "purchase"], 90)


@query(f"with {ANSWERS} select day, count(*) filter (where problem is null) as taken, count(*) filter (where problem = 'too long') as too_long, count(*) filter (where problem = 'unknown answer') as unknown_answer, count(*) filter (where problem = 'no row') as no_row from j group by 1")
def answer_days(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: answers taken and refused by day."""
    return _answers(spark, sf)[0]


@query(f"with {ANSWERS} select line, count(*) as answers from j where problem is null group by 1 having min(answer) <> max(answer)")
def answer_disputes(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: rows on which answers disagree."""
    return _answers(spark, sf)[1]


@query("""select c_custkey, case when not regexp_full_match(lower(c_mktsegment), '[a-z0-9-]{1,60}') then 'comparison' when c_nationkey % 6 = 5 then 'store' when c_custkey % 7 >= 5 then 'reason' when c_custkey % 60 > 50 then 'comment' end as problem from customer""")
def report_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Q20: the first thing wrong with a report."""
    store = F.get(F.array(*(F.lit(s) for s in ("", "AFRICA", "ASIA", "EUROPE", "AMERICA", "MARS"))), F.col("c_nationkey") % 6)
    reason = F.when(F.col("c_custkey") % 7 < 5, "price").otherwise("weather")
    problem = watch.report_problem(F.lower("c_mktsegment"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "-")), store, reason, F.expr("repeat('x', int(c_custkey % 60))"), ["AFRICA", "ASIA", "EUROPE", "AMERICA"], ["price", "size"], 50)
    return table(spark, sf, "customer").select("c_custkey", problem.alias("problem"))


@query("""with c as (select o_custkey, cast(o_orderdate as date) as day, o_orderkey from orders where o_orderstatus = 'F'), d as (select distinct o_custkey, cast(o_orderdate as date) as moved from orders where o_orderstatus = 'O')
  select o_orderkey, exists (select 1 from d where d.o_custkey = c.o_custkey and d.moved between c.day and c.day + 30) as signalled from c""")
def date_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Q21: changes that a moved date accompanies in the nights after."""
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    dates = o.filter("o_orderstatus = 'O'").select("o_custkey", F.col("day").alias("moved"))
    return watch.moved_with(o.filter("o_orderstatus = 'F'").select("o_custkey", "day", "o_orderkey"), dates, "o_custkey", "day", "moved", 30).select("o_orderkey", "signalled")


@query("select o_orderkey, not starts_with(o_orderpriority, '1-') and date_diff('day', cast(o_orderdate as date), date '2001-08-01') > 90 as prune from orders")
def old_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Q24: logs past their days, but for a prefix that stays."""
    return table(spark, sf, "orders").select("o_orderkey", watch.logs_to_prune(F.col("o_orderpriority"), F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"), "1-").alias("prune"))


@query("""with r as (select strftime(o_orderdate, '%Y-%m') as run, o_orderpriority as section, count(*) as delivered, count(*) filter (where o_orderstatus = 'F') as gone from orders group by 1, 2),
  w as (select *, delivered + case when section like '1%' then 8 when section like '2%' then 3 else 0 end as published, case when run like '%-03' then 1 else 0 end as failed, run not like '%-12' as complete from r),
  t as (select *, complete and (failed > 0 or (published > delivered and published - delivered > 5 and published - delivered > 0.01 * published)) as truncated from w)
  select run, section, truncated, complete and not truncated as confirms, delivered >= 20 and gone / delivered > 0.8 as gone_brake from t""")
def walk_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Q6a Q6f Q6g: truncated walks, whether absences count, and the brake on gone pages."""
    r = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderpriority").alias("section")).agg(F.count("*").alias("delivered"), F.count_if(F.col("o_orderstatus") == "F").alias("gone"))
    more = F.when(F.col("section").startswith("1"), 8).when(F.col("section").startswith("2"), 3).otherwise(0)
    complete = ~F.col("run").endswith("-12")
    t = r.withColumn("truncated", watch.truncated_walk(complete, F.col("run").endswith("-03").cast("int"), F.col("delivered") + more, F.col("delivered")))
    return t.select("run", "section", "truncated", watch.confirms_absences(complete, F.col("truncated")).alias("confirms"), watch.gone_brake(F.col("delivered"), F.col("gone")).alias("gone_brake"))


@query("""with v as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity, 1 + l_linenumber % 3 as price, 1 + (l_linenumber + 1) % 3 as regular, case when l_tax > 0.06 then null else l_discount > 0.05 end as promo from lineitem),
  b as (select *, lag(price) over w as p0, lag(regular) over w as r0, lag(promo) over w as o0, row_number() over w as n from v window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity))
  select l_partkey, n, case when coalesce(o0, false) and not coalesce(promo, false) and price = r0 and price is distinct from p0 then 'ended' when not coalesce(o0, false) and coalesce(promo, false) and regular = p0 and price is distinct from p0 then 'started' end as turn from b where n > 1""")
def promotion_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Promotions that ended or started between two sightings."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = table(spark, sf, "lineitem").select("*", (1 + F.col("l_linenumber") % 3).cast("double").alias("price"), (1 + (F.col("l_linenumber") + 1) % 3).cast("double").alias("regular"), F.when(F.col("l_tax") <= 0.06, F.col("l_discount") > 0.05).alias("promo"))
    rows = rows.select("l_partkey", "price", "regular", "promo", *(F.lag(c).over(w).alias(f"{c}_0") for c in ("price", "regular", "promo")), F.row_number().over(w).alias("n"))
    turn = watch.promotion_turn(*(F.col(c) for c in ("price", "regular", "promo", "price_0", "regular_0", "promo_0")))
    return rows.filter("n > 1").select("l_partkey", "n", turn.alias("turn"))


SWAPS = "s as (select p_partkey as id, 10000 + p_partkey as before_code, 10001 + p_partkey as code, p_name as before_name, p_type as name from part where p_partkey % 11 = 0 and p_partkey % 2 = 0)"


def _swaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    before = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 10000).alias("code"), F.col("p_name").alias("name"))
    now = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 10000 + F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0)).alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("name"))
    return before, watch.identity_swaps(before, now, "id", "code", "name", F.col("name") == F.col("before_name"))


@query(f"with {SWAPS} select * from s")
def identity_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Ids whose number and name became another product's."""
    return _swaps(spark, sf)[1]


@query(f"with {SWAPS} select case when s.id is not null then p_partkey || '~retired-2001-08-01' else p_partkey::varchar end as id, p_name as name, case when s.id is not null then date '2001-08-01' end as delisted, case when s.id is not null then 'replaced' end as reason from part left join s on p_partkey = s.id")
def archived_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows of swapped ids under id~retired-date."""
    before, swaps = _swaps(spark, sf)
    catalogue = before.select("id", "name", F.lit(None).cast("date").alias("delisted"), F.lit(None).cast("string").alias("reason"))
    return watch.archive_swaps(catalogue, swaps, "id", F.lit("2001-08-01").cast("date"))


DECISIONS = """m as (select c_custkey as id, c_custkey % 5 <> 0 as live, case when c_custkey % 9 = 0 then c_custkey + 1 end as successor from customer where c_custkey % 31 <> 0),
  d as (select c_custkey as a, c_custkey + 7 as b, case when c_custkey % 2 = 0 then 'CONFIRMED' else 'REVIEW' end as verdict from customer),
  k as (select m.id, m.live, case when s.live then s.id end as next from m left join m s on m.successor = s.id),
  j as (select d.*, x.id is not null as has_a, y.id is not null as has_b, x.live as live_a, y.live as live_b, x.next as next_a, y.next as next_b, least(coalesce(x.next, a), coalesce(y.next, b)) as to_a, greatest(coalesce(x.next, a), coalesce(y.next, b)) as to_b from d left join k x on a = x.id left join k y on b = y.id),
  r as (select *, case when next_a is not null or next_b is not null then case when exists (select 1 from d t where t.a = j.to_a and t.b = j.to_b) then 'superseded' end when not has_a or not has_b then 'missing' when not coalesce(live_a and live_b, false) then 'delisted' end as reason, next_a is not null or next_b is not null as moves from j),
  o as (select case when reason is null and moves then to_a else a end as a, case when reason is null and moves then to_b else b end as b, verdict, case when reason is not null then 'retired' when moves then 'repointed' else 'kept' end as state, reason, live_a, live_b from r)"""


def _decisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    members = c.filter("c_custkey % 31 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 != 0).alias("live"), F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey") + 1).alias("successor"))
    decisions = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"), F.when(F.col("c_custkey") % 2 == 0, "CONFIRMED").otherwise("REVIEW").alias("verdict"))
    return watch.revalidate(decisions, members)


@query(f"with {DECISIONS} select a, b, verdict, state, reason from o")
def decisions_revalidated(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions kept, handed to successors, or retired."""
    return _decisions(spark, sf)[0]


@query(f"with {DECISIONS} select distinct id from (select a as id from o where reason in ('missing', 'delisted') and live_a union all select b from o where reason in ('missing', 'delisted') and live_b)")
def matched_anew(spark: SparkSession, sf: str) -> DataFrame:
    """Live members of retired decisions."""
    return _decisions(spark, sf)[1]


@query("""with p as (select l_partkey as a, l_suppkey as b, max(l_discount) as score from lineitem group by 1, 2), best as (select * from p where score >= 0.05 order by score desc, a, b limit 200), ids as (select id, max(score) as score from (select a as id, score from best union all select b, score from best) group by 1)
  select id, score from ids where id not in (select p_partkey from part where p_size < 10)""")
def enrichment_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Products of the best pairs (a top-k report by its nature) that were not read yet."""
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_discount").alias("score"))
    return watch.enrichment_queue(pairs, table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id")), 0.05, 200)


@query("""select p_size as component, p_partkey as id from part where p_partkey % 3 = 0 and (p_partkey % 2 = 0 or p_partkey % 60 > 30) and p_size % 5 = 0 order by 1, 2 limit 300""")
def barcode_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Members of unconfirmed groups whose number is to be read (at most 300, by its nature)."""
    p = table(spark, sf, "part")
    today = F.lit("2001-08-01").cast("date")
    members = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("component"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("gtin"), F.when(F.col("p_partkey") % 2 != 0, F.date_sub(today, (F.col("p_partkey") % 60).cast("int"))).alias("read_at"))
    return watch.barcode_queue(members, p.filter("p_size % 5 = 0").select(F.col("p_size").alias("component")), today)


@query("""with s as (select p_partkey as id, p_size % 4 as n, case when p_size % 10 <> 0 then p_size end as size, case when p_size % 3 = 0 then 'un' else 'kg' end as unit, case when p_partkey % 2 = 0 then p_brand end as code from part where p_partkey % 5 <> 0),
  n as (select p_partkey as id, case when p_partkey % 6 <> 0 then p_size + 1 end as size, case when p_partkey % 6 <> 0 then 'kg' end as unit, p_type as code from part where p_partkey % 3 = 0),
  j as (select coalesce(s.id, n.id) as id, n.id is not null as hit, s.n, s.size as s0, n.size as s1, s.unit as u0, n.unit as u1, s.code as c0, n.code as c1 from s full join n on s.id = n.id),
  k as (select *, hit and not coalesce(hit and s1 is null and u0 = 'un', false) as takes from j)
  select id, (coalesce(n, 0) + hit::int)::integer as n, case when takes then s1 else s0 end as size, case when takes then u1 else u0 end as unit, coalesce(c0, c1) as code from k""")
def checks_merged(spark: SparkSession, sf: str) -> DataFrame:
    """M2 M3 M4: counters, counts that stay, and fields that are only filled where null."""
    p = table(spark, sf, "part")
    stored = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("n"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 3 == 0, "un").otherwise("kg").alias("unit"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("code"))
    seen = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") + 1).alias("size"), F.when(F.col("p_partkey") % 6 != 0, F.lit("kg")).alias("unit"), F.col("p_type").alias("code"))
    return watch.merge_with_rules(stored, seen, "id", "n", "size", "unit", ["code"])


@query("""with s as (select p_partkey as id, p_size as w from part where p_partkey % 2 = 0), n as (select p_partkey as id, p_size + case when p_partkey % 10 = 0 then 1 else 0 end as w from part where p_partkey % 3 = 0)
  select s.id, s.w as was, n.w as now from s left join n on s.id = n.id where s.w is distinct from n.w""")
def retracted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Donated values that the nightly recomputation changes or withdraws."""
    p = table(spark, sf, "part")
    stored = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("w"))
    fresh = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0)).alias("w"))
    return watch.retracted(stored, fresh, "id", "w")


@query("select c_custkey, case when c_acctbal / 1e5 > 0 and c_acctbal / 1e5 <= 0.01 then null else c_acctbal / 1e5 end as price from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def cleared_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """M6 M7: placeholder prices become null; rows that turned positive leave the negative cache."""
    turned = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf, "customer").join(turned, "c_custkey", "left_anti").select("c_custkey", watch.clear_placeholders(F.col("c_acctbal") / 1e5).alias("price"))


LABEL = """case when s > 0 then case u when 'kg' then case when s < 1 then {g} || ' g' else {k} || ' kg' end when 'l' then case when s < 1 then {g} || ' ml' else {k} || ' L' end when 'un' then cast(floor(s + 0.5) as bigint) || ' un' end end""".format(
    g=r"regexp_replace(regexp_replace(cast(cast(floor(s * 1000 * 10 + 0.5) / 10 as decimal(18,1)) as varchar), '(\.\d*?)0+$', '\1'), '\.$', '')",
    k=r"regexp_replace(regexp_replace(cast(cast(floor(s * 1000 + 0.5) / 1000 as decimal(18,3)) as varchar), '(\.\d*?)0+$', '\1'), '\.$', '')",
)


@query(rf"""with p as (select p_partkey, case when p_partkey % 13 = 0 then null else p_size / 8.0 end as s, case p_partkey % 4 when 0 then 'kg' when 1 then 'l' when 2 then 'un' end as u, case when p_partkey % 17 <> 0 then p_size * 0.25 end as price from part), q as (select *, {LABEL} as label from p)
  select p_partkey, label, case when price is null or coalesce(u = 'kg' and u in ('kg', 'l') and abs(s - 1) < 1e-9, false) then null when label is null then printf('%.2f €', price) else printf('%.2f €', price) || ' · ' || label end as line from q""")
def pack_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Size labels and pack lines."""
    size = F.when(F.col("p_partkey") % 13 != 0, F.col("p_size") / 8.0)
    unit = F.when(F.col("p_partkey") % 4 == 0, "kg").when(F.col("p_partkey") % 4 == 1, "l").when(F.col("p_partkey") % 4 == 2, "un")
    price = F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") * 0.25)
    return table(spark, sf, "part").select("p_partkey", shown.size_label(size, unit).alias("label"), shown.pack_line(price, size, unit, F.lit("kg")).alias("line"))


@query("""with v as (select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_suppkey % 3 as item, case when l_linenumber % 7 <> 0 then l_quantity end as price, l_linenumber % 4 as size, case when l_tax > 0.06 then null else l_discount > 0.05 end as promo from lineitem),
  b as (select *, lag(item) over w as i0, lag(price) over w as p0, lag(promo) over w as o0, row_number() over w as n from v window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity)), s as (select *, coalesce(item = i0, false) as same from b)
  select l_partkey, n, case when size > 0 and price is not null then floor(price / size * 100 + 0.5) / 100 end as per_unit, case when same and p0 > 0 and price is not null then floor((price - p0) / p0 * 100 * 10 + 0.5) / 10 end as change_percent,
    case when promo is null then 'unknown' when same and promo is distinct from o0 then case when promo then 'started' else 'ended' end when promo then 'on' else 'off' end as promotion from s""")
def price_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be said of an entry, given the view before."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = table(spark, sf, "lineitem").select("*", (F.col("l_suppkey") % 3).alias("item"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")).alias("price"), (F.col("l_linenumber") % 4).alias("size"), F.when(F.col("l_tax") <= 0.06, F.col("l_discount") > 0.05).alias("promo"))
    rows = rows.select("l_partkey", "item", "price", "size", "promo", *(F.lag(c).over(w).alias(f"{c}_0") for c in ("item", "price", "promo")), F.row_number().over(w).alias("n"))
    return rows.select("l_partkey", "n", shown.price_facts(*(F.col(c) for c in ("item", "price", "size", "promo", "item_0", "price_0", "promo_0"))).alias("f")).select("l_partkey", "n", "f.*")


@query("""select p_partkey, case when p_partkey % 5 = 4 then null when p_partkey % 5 = 3 and p_size < 10 then null else list_concat(range(p_size::bigint, p_size::bigint + 3), [(p_partkey % 100)::bigint]) end as numbers from part""")
def number_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and ranges of numbers as text, read back."""
    written = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.col("p_size").cast("string"), F.lit("-x"))).when((F.col("p_partkey") % 5 == 3) & (F.col("p_size") < 10), F.concat(F.col("p_size").cast("string"), F.lit("-1"), F.lit("-2"))).otherwise(F.concat_ws("", F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit(", "), (F.col("p_partkey") % 100).cast("string")))
    return table(spark, sf, "part").select("p_partkey", shown.proposal_numbers(written).alias("numbers"))


@query("""with b as (select p_partkey, case p_partkey % 5 when 0 then null when 1 then ' House Label ' when 2 then 'Our ' || p_name when 3 then 'our' else p_brand end as brand from part)
  select p_partkey, case when brand is null or lower(trim(brand)) in ('house', 'house label') or regexp_matches(trim(brand), '(?i)^(the\\s+)?our\\s+\\S') then 'House' else trim(brand) end as brand from b""".replace("\\\\", "\\"))
def house_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand for the store's own brand."""
    k = F.col("p_partkey") % 5
    brand = F.when(k == 1, " House Label ").when(k == 2, F.concat(F.lit("Our "), "p_name")).when(k == 3, "our").when(k == 4, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", shown.house_brand(brand, "House", ["house", "house label"], r"(?i)^(the\s+)?our\s+\S").alias("brand"))


@query("""select p_partkey, regexp_matches(lower(p_name), 'tin|copper|steel') and regexp_matches(lower(p_name), '^[a-m]') and not regexp_matches(lower(p_name), 'plated') as included, case when p_size % 10 = 0 then 1 else p_size % 10 end as quantity, date_diff('day', date '2001-01-01' + p_size, date '2001-03-01') as days, row_number() over (partition by p_type order by lower(p_name), p_name, p_partkey) as place from part""")
def shown_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Names that fit patterns, quantities shown, days between, and order by letters without accents."""
    order = Window.partitionBy("p_type").orderBy(shown.collation_key(F.col("p_name")), "p_partkey")
    included = shown.includes(F.col("p_name"), ["tin|copper|steel", "^[a-m]"], "plated")
    days = shown.days_between(F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size")), F.lit("2001-03-01").cast("date")).cast("long")
    return table(spark, sf, "part").select("p_partkey", included.alias("included"), shown.shown_quantity(F.col("p_size") % 10).alias("quantity"), days.alias("days"), F.row_number().over(order).alias("place"))


@query("""with p as (select p_partkey as id, case when p_size % 9 <> 0 then p_size end as price, date '2001-08-01' as "at" from part), o as (select p_partkey as id from part where p_partkey % 4 = 0)
  select id, price, "at" as first_seen, "at" as last_seen, true as is_open from p where price is not null and id not in (select id from o)""")
def backfilled_periods(spark: SparkSession, sf: str) -> DataFrame:
    """An open period for each priced product without one."""
    p = table(spark, sf, "part")
    products = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("price"), F.lit("2001-08-01").cast("date").alias("at"))
    return periods.backfill_open(products, p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4 == 0).alias("is_open")), "id", "price", "at")


@query("""select case when o_orderkey % 7 = 0 and o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end as id, o_orderkey, o_orderstatus = 'O' and not (o_orderkey % 7 = 0 and o_custkey % 10 = 0) as is_open from orders where o_orderkey % 7 = 0
  union all select case when o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end, o_orderkey, o_orderstatus = 'O' and o_custkey % 10 <> 0 from orders where o_orderkey % 7 <> 0""")
def carried_history(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of replaced products under their successors, closed."""
    history = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", (F.col("o_orderstatus") == "O").alias("is_open"))
    moves = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return periods.carry_history(history, moves, "id")


@query("""with k as (select o_custkey, max(cast(o_orderdate as date)) as latest from orders where o_orderdate < '1999-01-01' group by 1), s as (select o_custkey, o_orderkey, cast(o_orderdate as date) as "at" from orders where o_orderdate >= '1998-06-01')
  select s.o_custkey, o_orderkey, "at" from s left join k on s.o_custkey = k.o_custkey where "at" is distinct from latest""")
def changed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that differ from the latest known one."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("at"))
    return periods.new_dates(o.filter("at >= '1998-06-01'"), o.filter("at < '1999-01-01'"), "o_custkey", "at")


@query("""with s as (select c_custkey as a, c_custkey + 1 as b, 'CONFIRMED' as verdict, case when c_custkey % 3 = 0 then 'HUMAN' else 'AUTO' end as source from customer where c_custkey % 2 = 0), m as (select c_custkey as a, c_custkey + 1 as b, 'REJECTED' as verdict, case when c_custkey % 5 = 0 then 'HUMAN' else 'AUTO' end as source from customer where c_custkey % 4 <> 1)
  select coalesce(s.a, m.a) as a, coalesce(s.b, m.b) as b, case when m.a is null or (s.source = 'HUMAN' and m.source = 'AUTO') then s.verdict else m.verdict end as verdict, case when m.a is null or (s.source = 'HUMAN' and m.source = 'AUTO') then s.source else m.source end as source from s full join m on s.a = m.a""")
def merged_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A person's decision is never replaced by the matcher's."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    who = lambda k: F.when(F.col("a") % k == 0, "HUMAN").otherwise("AUTO").alias("source")
    return resolve.merge_decisions(c.filter("a % 2 = 0").select("a", "b", F.lit("CONFIRMED").alias("verdict"), who(3)), c.filter("a % 4 <> 1").select("a", "b", F.lit("REJECTED").alias("verdict"), who(5)))


@query("""with o as (select o_orderkey, o_orderkey % 100 as price, o_custkey % 100 as regular, cast(o_orderdate as date) as ends, extract(day from o_orderdate) as d, extract(month from o_orderdate) as m from orders)
  select o_orderkey, case when ends >= date '1999-06-15' and regular > price then regular end as regular, case when ends >= date '1999-06-15' then ends end as ends, case when m = 2 and d = 29 then null when make_date(1999, m, d) >= date '1999-06-14' then make_date(1999, m, d) else make_date(2000, m, d) end as next_end from o where not (m = 2 and d = 29)""")
def promotions_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Promotions as shown, and the next date with a day and month."""
    today = F.lit("1999-06-15").cast("date")
    o = table(spark, sf, "orders").filter("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    p = measures.promotion_shown(F.col("o_orderkey") % 100, F.col("o_custkey") % 100, F.to_date("o_orderdate"), today)
    return o.select("o_orderkey", p["regular"].alias("regular"), p["ends"].alias("ends"), measures.promotion_end(F.dayofmonth("o_orderdate"), F.month("o_orderdate"), today).alias("next_end"))


@query("""with w as (select event_id, case event_type when 'view' then 'https://schema.org/InStock' when 'click' then 'OutOfStock' when 'purchase' then 'Disponível' when 'signup' then 'indisponível' end as word from events)
  select event_id, case when regexp_matches(lower(word), 'outofstock|soldout|discontinued|indispon') then false when regexp_matches(lower(word), 'instock|limitedavailability|onlineonly|dispon') then true end as available from w""")
def availability_words(spark: SparkSession, sf: str) -> DataFrame:
    """Availability from a schema word or a sign."""
    t = F.col("event_type")
    word = F.when(t == "view", "https://schema.org/InStock").when(t == "click", "OutOfStock").when(t == "purchase", "Disponível").when(t == "signup", "indisponível")
    return table(spark, sf, "events").select("event_id", measures.availability(word).alias("available"))


@query("""with p as (select p_partkey, string_split(lower(p_name), ' ') as l, case when p_partkey % 3 = 0 then ['new', string_split(lower(p_name), ' ')[1]] end as x, case when p_partkey % 4 = 0 then [string_split(lower(p_name), ' ')[2]] end as r from part)
  select p_partkey, list_sort(list_distinct(list_concat(list_filter(l, lambda v: not list_contains(coalesce(r, []), v)), coalesce(x, [])))) as labels, len(list_intersect(l, coalesce(x, []))) as shared from p""")
def labels_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Label lists with additions and removals, and the count of an intersection."""
    words = F.split(F.lower("p_name"), " ")
    add, remove = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("new"), words[0])), F.when(F.col("p_partkey") % 4 == 0, F.array(words[1]))
    shared = F.size(F.array_intersect(words, F.coalesce(add, F.array().cast("array<string>")))).cast("long")
    return table(spark, sf, "part").select("p_partkey", F.array_sort(rules.labels_with(words, add, remove)).alias("labels"), shared.alias("shared"))


@query("""with g as (select o_custkey, list_sort(list(distinct case o_orderstatus when 'F' then 'FAIL' when 'P' then 'WARN' else 'OK' end)) as l from orders group by 1)
  select o_custkey, case when list_contains(l, 'FAIL') then 'FAIL' when list_contains(l, 'WARN') then 'WARN' else 'OK' end as verdict from g""")
def worst_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: verdicts escalated; FAIL is never softened."""
    level = F.when(F.col("o_orderstatus") == "F", quality.FAIL).when(F.col("o_orderstatus") == "P", quality.WARN).otherwise(quality.OK)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(level).alias("l")).select("o_custkey", quality.escalate(F.col("l")).alias("verdict"))


@query("""with t as (select p_partkey, p_brand, case when p_size % 2 = 0 then p_size * 1.0::double end as drained, case when p_size % 3 = 0 then p_size * 1.5::double end as whole from part), n as (select *, count(drained) over (partition by p_brand) as nd, count(whole) over (partition by p_brand) as nf from t), b as (select *, case when nd + nf = 0 then null when nd >= nf then 'drained' else 'full' end as basis from n)
  select p_partkey, basis, case basis when 'drained' then drained when 'full' then whole end as weight from b""")
def tin_weights(spark: SparkSession, sf: str) -> DataFrame:
    """B2: tins of a row compared on the weight that more of them state."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1.0).alias("drained"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 1.5).alias("whole"))
    return compare.tin_basis(rows, ["p_brand"], "drained", "whole").select("p_partkey", "basis", "weight")


@query("""with p as (select a.p_partkey, lower(a.p_name) as na, lower(b.p_name) as nb, a.p_size as sa, case when b.p_size % 7 <> 0 then b.p_size end as sb, a.p_retailprice as pa, b.p_retailprice * (b.p_size % 3 + 1) as pb from part a join part b on b.p_partkey = a.p_partkey + 1)
  select p_partkey, case when contains(na, 'plated') <> contains(nb, 'plated') then 'plated' when contains(na, 'polished') <> contains(nb, 'polished') then 'polished' end as qualifier, greatest(pa, pb) / least(pa, pb) as ratio,
    list_filter([case when contains(na, 'ring') <> contains(nb, 'ring') or contains(na, 'small') <> contains(nb, 'small') then 'form-word' end, case when greatest(pa, pb) / least(pa, pb) >= 2 then 'price-gap' end, case when sa is null or sb is null then 'size-unread' end, case when abs(sa - sb) > 0.05 * greatest(sa, sb) then 'pack-sizes' end], lambda x: x is not null) as flags from p""")
def pair_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Qualifiers in one name only, price ratios, and flags of compared pairs."""
    p = table(spark, sf, "part")
    a = p.select("p_partkey", F.col("p_name").alias("na"), F.col("p_size").alias("sa"), F.col("p_retailprice").alias("pa"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("nb"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("sb"), (F.col("p_retailprice") * (F.col("p_size") % 3 + 1)).alias("pb"))
    c = {x: F.col(x) for x in ("na", "nb", "sa", "sb", "pa", "pb")}
    return a.join(b, "p_partkey").select("p_partkey", text.qualifier_mismatch(c["na"], c["nb"], [("plated", "plated"), ("polished", "polished")]).alias("qualifier"), measures.price_ratio(c["pa"], c["pb"]).alias("ratio"), compare.comparison_flags(c["na"], c["nb"], c["pa"], c["pb"], c["sa"], c["sb"], ["ring", "small"]).alias("flags"))


@query(r"""with w as (select p_partkey, lower(string_split(p_name, ' ')[1]) as a, lower(string_split(p_name, ' ')[2]) as b from part)
  select p_partkey, regexp_replace(regexp_replace(b, 's$', ''), '[oa]$', '') as stem, a = 'small' as small, sha256(a || '|' || '2001-08-01') as visitor, trim(b || '  ' || a) as comment from w""")
def words_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Word stems, search terms, visitor keys and cleaned comments."""
    words = F.split("p_name", " ")
    comment = text.clean_comment(F.concat(F.lit("\x07 "), F.lower(words[1]), F.lit("\n "), F.lower(words[0]), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", text.stem(words[1]).alias("stem"), text.matches_term(F.split(F.lower("p_name"), " "), F.lit("small")).alias("small"), text.visitor_key(F.lower(words[0]), F.lit("2001-08-01").cast("date")).alias("visitor"), comment.alias("comment"))


@query("""with p as (select p_partkey, p_size, case p_partkey % 5 when 0 then null when 1 then p_size * 1.05::double when 2 then p_size * 3.0::double when 3 then p_size * 0.5::double else p_size * 20.0::double end as tile from part)
  select p_partkey, case when tile is null then p_size when p_partkey % 5 = 1 then p_size when p_partkey % 5 = 2 and p_size % 2 = 0 then tile when p_partkey % 5 = 3 and p_size % 3 = 0 then tile end as size, p_size % 12 + 2 as pieces,
    case when p_size % 6 = 0 then 'gone' when abs(p_size - 20) <= 0.1 then 'unchanged' else 'changed' end as status from p""")
def sizes_settled(spark: SparkSession, sf: str) -> DataFrame:
    """A listing's figure against the name's, counts in names, and whether an override still holds."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("double")
    tile = F.when(k == 1, size * 1.05).when(k == 2, size * 3.0).when(k == 3, size * 0.5).when(k == 4, size * 20.0)
    named = F.concat(F.col("p_name"), F.lit(" "), (F.col("p_size") % 12 + 2).cast("string"), F.lit(" ovos"))
    status = measures.override_status(F.when(F.col("p_size") % 6 != 0, size), F.lit(20.0))
    return table(spark, sf, "part").select("p_partkey", measures.reconcile_size(tile, size, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("size"), measures.count_from_name(named, "ovos").alias("pieces"), status.alias("status"))


@query("""with p as (select p_partkey, string_split(p_name, ' ') as w, p_type from part), s as (select p_partkey, case lower(w[1]) when 'small' then 'food' when 'large' then 'mixed' when 'red' then 'other' else 'unknown' end as kind, lower(w[1]) = 'small' and lower(w[2]) = 'ring' as skip, p_type in ('PROMO', 'ECONOMY') as classified from p)
  select p_partkey, kind, case when kind = 'unknown' then 'unknown-section' when kind = 'other' then 'not-wanted' when skip then 'skipped' when kind = 'mixed' and not classified then 'unclassified' else 'kept' end as reason from s""")
def section_routing(spark: SparkSession, sf: str) -> DataFrame:
    """A section's verdict and what is kept of it, with the reason."""
    section = rules.section_verdict(text.path_keys(F.regexp_replace("p_name", " ", ">")), {"small": "food", "large": "mixed", "red": "other"}, [("small", "ring")])
    rows = table(spark, sf, "part").select("p_partkey", section.alias("s"), F.when(F.col("p_type").isin("PROMO", "ECONOMY"), F.col("p_type")).alias("k"))
    return rows.select("p_partkey", F.col("s.kind").alias("kind"), rules.keep_decision(F.col("s"), F.col("k"))["reason"].alias("reason"))


@query("""with k as (select p_type as kind, case when p_size % 2 = 0 then p_brand else 'nowhere' end as category from part where p_partkey % 40 = 0), c as (select distinct p_brand as category from part where p_partkey % 3 = 0)
  select 'duplicate-kind' as problem, kind as what from k group by kind having count(*) > 1 union all select 'unknown-category', kind from k where category not in (select category from c) union all select 'empty-category', category from c where category not in (select category from k)""")
def tree_check(spark: SparkSession, sf: str) -> DataFrame:
    """K9: problems of the kind tree."""
    p = table(spark, sf, "part")
    kinds = p.filter("p_partkey % 40 = 0").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("nowhere").alias("category"))
    return rules.tree_problems(p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("category")).distinct(), kinds)
