"""The driver's tables in the engine's schemas: listings of stores, price observations, runs. Spark and SQL side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store is a region."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("store"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price seen for a product at a store on a day."""
    l, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    place = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("store"))
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long")
    return l.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select("store", F.col("l_partkey").alias("product_id"), F.col("l_shipdate").cast("date").alias("day"), cents.alias("price_cents"), (F.col("l_linestatus") == "O").alias("available"), "l_orderkey", "l_linenumber", "l_suppkey")


OBSERVATIONS = """
obs as (
  select r_name as store, l_partkey as product_id, cast(l_shipdate as date) as day,
    cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) as price_cents, l_linestatus = 'O' as available,
    l_orderkey, l_linenumber, l_suppkey
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def products(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Products with kind, sub-kind, size (unknown for some), unit, brand, own-brand mark, and more columns of the table."""
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double"))
    unit = F.when(F.col("p_size") % 3 == 0, "kg").when(F.col("p_size") % 3 == 1, "l").otherwise("un")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.split("p_name", " ")[0].alias("sub_kind"), size.alias("size"), unit.alias("unit"), F.col("p_brand").endswith("1").alias("own_brand"), *more)


PRODUCTS = """
products as (
  select p_partkey as product_id, p_name as name, p_brand as brand, p_type as kind, string_split(p_name, ' ')[1] as sub_kind,
    case when p_size % 10 <> 0 then cast(p_size as double) end as size,
    case p_size % 3 when 0 then 'kg' when 1 then 'l' else 'un' end as unit, p_brand like '%1' as own_brand
  from part
)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest observation of each (store, product); products whose number is a multiple of 17 have no price.

    The newest row is an aggregate of structs, which combines before the shuffle; a window would move every row.
    """
    newest = observations(spark, sf_dir).groupBy("store", "product_id").agg(F.max(F.struct("day", "l_orderkey", "l_linenumber", "l_suppkey", "price_cents")).alias("m"))
    price = F.when(F.col("product_id") % 17 != 0, F.col("m.price_cents"))
    return newest.select("store", "product_id", F.col("m.day").alias("last_seen"), price.alias("price_cents")).join(products(spark, sf_dir), "product_id")


LISTINGS = f"""{OBSERVATIONS}, {PRODUCTS},
listings as (
  select store, o.product_id, o.day as last_seen, case when o.product_id % 17 <> 0 then price_cents end as price_cents,
    name, brand, kind, sub_kind, size, unit, own_brand
  from (
    select * from obs
    qualify row_number() over (partition by store, product_id order by day desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, price_cents desc) = 1
  ) o join products p on o.product_id = p.product_id
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load is a month of orders; a section is an order priority."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(month.alias("run"), F.col("o_orderpriority").alias("section")).agg(F.count("*").alias("collected"))


RUNS = "runs as (select strftime(o_orderdate, '%Y-%m') as run, o_orderpriority as section, count(*) as collected from orders group by 1, 2)"
