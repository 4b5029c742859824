"""Queries of changing groups, trust in loads and exact bounds over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.bounds import binomial_upper
from shelfwise.operators import groups, resolve, trust
from shelfwise.plans.catalog import table
from shelfwise.plans.queries import query


def _links(spark: SparkSession, sf: str, where: str) -> DataFrame:
    """A sparse graph of parts: an order line links its part to one a few numbers on."""
    lines = table(spark, sf, "lineitem").filter(where)
    return lines.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1 + F.col("l_suppkey") % 7).alias("b"))


_LINKS = "select distinct l_partkey as a, l_partkey + 1 + l_suppkey % 7 as b from lineitem where "
STORED, ADDED, REMOVED = "l_orderkey % 120 = 0", "l_orderkey % 1200 = 7", "l_orderkey % 600 = 0 and l_linenumber <= 3"


@query(f"""with recursive old as ({_LINKS}{STORED}), gone as ({_LINKS}{REMOVED}), more as ({_LINKS}{ADDED}), kept as (select * from old except select * from gone union select * from more),
  ways as (select a, b from kept union select b, a from kept), reach as (select a as id, a as other from ways union select reach.id, ways.b from reach join ways on reach.other = ways.a)
  select id, min(other) as component from reach group by id""")
def groups_updated(spark: SparkSession, sf: str) -> DataFrame:
    """Stored groups after links came and went, worked out over the touched groups only."""
    folder = f"{resolve.shared_folder(spark)}/stored-groups-{uuid.uuid4().hex}"
    groups.save_groups(_links(spark, sf, STORED), folder)
    return groups.apply_decisions(spark, folder, _links(spark, sf, ADDED), _links(spark, sf, REMOVED)).select("id", "component")


_REACH = "select a as id, a as other from {0} union select r.id, {0}.b from {1} r join {0} on r.other = {0}.a"


@query(f"""with recursive l0 as ({_LINKS}{STORED}), l1 as (select a, b from l0 union select b, a from l0), r1 as ({_REACH.format("l1", "r1")}),
  m as (select id, min(other) as component, case when id % 5 > 1 then id % 3 end as gtin from r1 group by id),
  refused as (select p_partkey as a, p_partkey + 3 as b from part where p_partkey % 4 = 0),
  inside as (select x.component, r.a, r.b from refused r join m x on r.a = x.id join m y on r.b = y.id and x.component = y.component),
  c as (select component, gtin, count(*) as n, min(id) as anchor from m where gtin is not null and component in (select component from inside) group by 1, 2),
  t as (select component, min(gtin) as proof, min(anchor) as anchor from c x where n >= 2 and n = (select max(n) from c y where y.component = x.component) group by 1 having count(*) = 1),
  k as (select m.id, m.component, anchor from m join t using (component) where gtin is null or gtin = proof),
  l2 as (select a, b from l1 where a in (select id from k) and b in (select id from k)), r2 as ({_REACH.format("l2", "r2")}),
  p as (select k.id, component, anchor, coalesce(g.part, k.id) as part from k left join (select id, min(other) as part from r2 group by id) g on k.id = g.id),
  core as (select component, part as core from p where id = anchor),
  proven as (select component, core from core where (select count(*) from p where p.part = core.core) >= 2 and not exists (select 1 from inside i join p x on i.a = x.id join p y on i.b = y.id where x.part = core.core and y.part = core.core))
  select m.id, m.component, case when v.core is null then m.component else coalesce(p.part, m.id) end as "group", v.core is not null as trimmed, v.core is null or coalesce(p.part, m.id) = v.core as core
  from m left join proven v on m.component = v.component left join p on m.id = p.id""")
def groups_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with a refused pair, cut down to the part that one number proves; what is cut off comes back."""
    links = resolve.checkpoint(_links(spark, sf, STORED).distinct())
    gtin = F.when(F.col("id") % 5 > 1, F.col("id") % 3)
    members = resolve.components(links).withColumn("gtin", gtin)
    refused = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 3).alias("b"))
    return groups.trim_groups(members, links, refused)


_RUNS = """l0 as (select o_orderstatus as source, strftime(o_orderdate, '%Y-%m') as run, count(*) as n, count(distinct o_orderpriority) as f from orders group by 1, 2),
  l1 as (select source, run, case when source = 'F' and run >= '1998' then n // 2 when source = 'P' and run[6:] = '05' then n // 3 else n end::bigint as entries, case when source = 'O' and run >= '1997-06' and run < '2000' then f - 1 when run[6:] = '11' then 0 else f end::bigint as files, source = 'P' and run[6:] = '08' as failed from l0)"""


@query(f"""with recursive {_RUNS}, l as (select *, row_number() over (partition by source order by run) as i from l1),
  fold as (select source, i, run, entries, files, case when failed or files = 0 then false else true end as trusted, case when failed then 'unreadable' when files = 0 then 'no files' end as why, null::bigint as was_entries, null::bigint as was_files,
      case when not (failed or files = 0) then entries end as base_entries, case when not (failed or files = 0) then files end as base_files, entries as e1, files as f1, failed or files = 0 as d1, null::bigint as e2, null::bigint as f2, false as d2 from l where i = 1
    union all select source, i, run, entries, files, trusted, case when not hard and doubt is not null and trusted then 'accepted' else doubt end, base_entries, base_files, case when trusted then entries else base_entries end, case when trusted then files else base_files end, entries, files, not trusted, e1, f1, d1 from (
      select *, doubt is null or (not hard and coalesce(d1 and f1 = files and abs(e1 - entries) <= greatest(50, entries * 0.005) and d2 and f2 = files and abs(e2 - entries) <= greatest(50, entries * 0.005), false)) as trusted from (
        select l.*, p.base_entries, p.base_files, p.e1, p.f1, p.d1, p.e2, p.f2, p.d2, l.failed or l.files = 0 as hard, case when l.failed then 'unreadable' when l.files = 0 then 'no files' when l.files < p.base_files then 'fewer files' when l.entries < p.base_entries * 0.95 then 'shrunk' end as doubt
        from fold p join l on l.source = p.source and l.i = p.i + 1)))
  select source, run, entries, files, trusted, why, was_entries, was_files from fold""")
def source_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 ST9: trust in each month's load of a source, from what was believed before; levels that fall and stay are accepted."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("f"))
    month = F.substring("run", 6, 2)
    entries = F.when((F.col("source") == "F") & (F.col("run") >= "1998"), F.floor(F.col("n") / 2)).when((F.col("source") == "P") & (month == "05"), F.floor(F.col("n") / 3)).otherwise(F.col("n"))
    files = F.when((F.col("source") == "O") & (F.col("run") >= "1997-06") & (F.col("run") < "2000"), F.col("f") - 1).when(month == "11", 0).otherwise(F.col("f"))
    failed = F.when((F.col("source") == "P") & (month == "08"), "timed out")
    return trust.load_trust(o.select("source", "run", entries.alias("entries"), files.alias("files"), failed.alias("error")), "source", "run", "entries", "files", "error")


@query("""with recursive g as (select s_nationkey, l_linenumber, count(*) as tries, count(*) filter (where l_returnflag = 'R' and l_quantity > 40) as hits from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2),
  b as (select s_nationkey, l_linenumber, hits, tries, hits / tries as low, 1.0::double as high, 0 as i from g where hits < tries
    union all select s_nationkey, l_linenumber, hits, tries, case when more then (low + high) / 2 else low end, case when more then high else (low + high) / 2 end, i + 1 from (
      select *, list_sum(list_transform(range(0, hits + 1), lambda k: exp(lgamma(tries + 1) - lgamma(k + 1) - lgamma(tries - k + 1) + k * ln((low + high) / 2) + (tries - k) * ln(1 - (low + high) / 2)))) > 0.05 as more from b where i < 50))
  select s_nationkey, l_linenumber, g.hits, g.tries, round(coalesce(high, 1.0), 9) as bound from g left join (select * from b where i = 50) b using (s_nationkey, l_linenumber)""")
def share_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The exact upper bound of a share in each group, as a column."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = joined.groupBy("s_nationkey", "l_linenumber").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("hits"), F.count("*").alias("tries"))
    return counted.withColumn("bound", F.round(binomial_upper(F.col("hits"), F.col("tries")), 9))
