"""Streams over the driver's tables, dealt to files in the order in which rows arrive, each with the SQL of its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import resolve
from shelfwise.plans.catalog import OBSERVATIONS, observations, table
from shelfwise.plans.queries import PERIODS, query
from shelfwise.streaming import sink, states


def _arriving(rows: DataFrame, order: list[str], files: int, last: DataFrame | None = None) -> DataFrame:
    """A stream of a table's rows that arrives in so many batches, in that order (and then the rows of last).

    Every batch is written on its own, as a source reads files by their time, and as equally many files, as a batch is a
    number of files: many, so that no task writes or reads a whole batch; empty ones make up what a batch has fewer.
    """
    spark = rows.sparkSession
    folder = f"{resolve.shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    held = resolve.checkpoint(rows)
    cuts = held.selectExpr(f"approx_percentile({order[0]}, array({', '.join(str(k / files) for k in range(1, files))})) as c").first().c if files > 1 else []
    at, each = F.col(order[0]), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(files):
        part = held
        if k:
            part = part.filter(at > cuts[k - 1])
        if k < files - 1:
            part = part.filter(at <= cuts[k])
        path = f"{folder}/batch={k}"
        part.repartition(each).write.parquet(path)
        for _ in range(each - len(spark.read.schema(held.schema).parquet(path).inputFiles())):
            held.limit(0).coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        last.coalesce(1).write.parquet(f"{folder}/batch={files}")
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/*")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{resolve.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a task and of a saved bucket, and of a shard, of a stream over a table whose size is known.
ROWS, SHARD_ROWS = 500_000, 100_000


def _stateful(spark: SparkSession, rows: int = 0):
    return states.settings(spark, spark__sql__streaming__stateStore__providerClass=states.ROCKS, spark__sql__shuffle__partitions=str(max(spark.sparkContext.defaultParallelism, rows // ROWS)))


@query(f"with {PERIODS} select store, product_id, period::bigint as period, price_cents, available, first_seen, last_seen, n_seen, period = max(period) over (partition by store, product_id) as is_open from periods")
def periods_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 ST8 T1 ST1: price periods from a stream whose rows come up to 20 days late, saved by exactly-once upserts."""
    obs = observations(spark, sf)
    order = F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "price_cents")))
    day = F.col("day").cast("timestamp")
    arrives = F.unix_timestamp(day) + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(20)) * 86400
    rows = obs.select("store", "product_id", day.alias("day"), order.alias("ord"), F.col("price_cents").alias("cents"), "available", arrives.alias("arrives"))
    # a last row of no product moves the watermark past all days
    end = spark.range(1).selectExpr("cast(null as string) as store", "cast(null as bigint) as product_id", "timestamp'2200-01-01' as day", "'' as ord", "cast(null as bigint) as cents", "cast(null as boolean) as available", "0L as arrives")
    stream = _arriving(rows, ["arrives"], 2, end)
    schema = "store string, product_id bigint, period bigint, price_cents bigint, available boolean, first_seen date, last_seen date, n_seen bigint, is_open boolean"
    n = rows.count()
    target = sink.VersionedTable(spark, _new_folder(spark, "periods"), schema, ["store", "product_id", "period"], max(sink.BUCKETS, n // ROWS))
    with _stateful(spark, n):
        made = states.streamed_periods(stream, "21 days", max(64, n // SHARD_ROWS))
        sink.in_slices(made.writeStream.outputMode("append"), target.merge, _new_folder(spark, "offsets"))
    return target.read().filter("product_id is not null")


LIMIT, WINDOW_MS, PER_DAY = 2, 6 * 3_600_000, 40


@query(f"""with recursive e as (select user_id as visitor, event_id as request, epoch_ms(ts)::bigint as ms, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as i from events),
  f as (select visitor, i, request, ms, true as admitted, [ms] as times from e where i = 1
    union all select visitor, i, request, ms, len(kept) < {LIMIT}, case when len(kept) < {LIMIT} then list_append(kept, ms) else kept end from (
      select e.visitor, e.i, e.request, e.ms, list_filter(f.times, lambda t: t > e.ms - {WINDOW_MS} and t // 86400000 = e.ms // 86400000) as kept from f join e on e.visitor = f.visitor and e.i = f.i + 1)),
  r as (select *, row_number() over (partition by ms // 86400000, admitted order by ms, request) as place from f)
  select visitor, request, admitted, admitted and place <= {PER_DAY} as allowed from r""")
def reports_limited(spark: SparkSession, sf: str) -> DataFrame:
    """ST4: a sliding limit per visitor as a stream with a daily reset, then the daily total over the admitted ones."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("visitor"), F.col("event_id").alias("request"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrives")).withColumn("ts", F.col("ts").cast("timestamp"))
    schema = "visitor bigint, request bigint, at bigint, admitted boolean"
    target = sink.VersionedTable(spark, _new_folder(spark, "limits"), schema, ["request"])
    with _stateful(spark):
        made = states.streamed_limits(_arriving(e, ["arrives"], 2), LIMIT, WINDOW_MS)
        sink.in_slices(made.writeStream.outputMode("append"), target.merge, _new_folder(spark, "offsets"))
    rows = target.read()
    # the last request of a day that the total admits; of each day only that many rows are ranked
    day = F.floor(F.col("at") / states.DAY_MS)
    first = rows.filter("admitted").withColumn("day", day).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("at", "request"))).filter(F.col("place") <= PER_DAY)
    ok = first.select("request", F.lit(True).alias("allowed"))
    return rows.join(ok, "request", "left").select("visitor", "request", "admitted", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query("""with e as (select user_id % 20 as host, event_id as request, ts, event_type in ('error', 'view', 'click') as refused from events),
  m as (select *, sum(case when refused then 0 else 1 end) over (partition by host order by epoch_ms(ts), request rows unbounded preceding) as run from e),
  s as (select *, sum(refused::int) over (partition by host, run order by epoch_ms(ts), request rows unbounded preceding)::bigint as in_a_row from m),
  a as (select *, case when in_a_row > 0 and in_a_row % 3 = 0 then case when in_a_row // 3 > 2 then 'stop' else 'pause' end end as act, epoch_ms(ts) as ms from s),
  f as (select host, min(row(ms, request)) as stop from a where act = 'stop' group by 1)
  select a.host, request, in_a_row, act from a left join f on a.host = f.host where act is not null and (stop is null or row(ms, request) <= stop)""")
def refusals_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """ST5 H2: pauses and the stop of each host as a stream."""
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("host"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("error", "view", "click").alias("refused"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrives"))
    target = sink.VersionedTable(spark, _new_folder(spark, "refusals"), "host bigint, request bigint, in_a_row bigint, act string", ["request"])
    with _stateful(spark):
        made = states.streamed_refusals(_arriving(e, ["arrives"], 2), 3, 2)
        sink.in_slices(made.writeStream.outputMode("append"), target.merge, _new_folder(spark, "offsets"))
    return target.read()


@query(f"""with {OBSERVATIONS}, r as (select *, row_number() over (partition by store, product_id order by day desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, price_cents desc) as k, count(*) over (partition by store, product_id) as n from obs)
  select store, product_id, price_cents, available, day as last_seen, n as sightings from r where k = 1""")
def sightings_saved(spark: SparkSession, sf: str) -> DataFrame:
    """S24 ST1 M12 M3: sightings saved as they come, in slices: a run with a limit, a repeated batch, then the run that ends it.

    A listing holds its newest sighting and their number. The repeated batch has an id that was saved and changes nothing.
    """
    obs = observations(spark, sf)
    order = ["day", "l_orderkey", "l_linenumber", "l_suppkey", "price_cents"]
    rows = obs.withColumn("arrives", F.unix_date("day").cast("long"))
    schema = "store string, product_id bigint, price_cents bigint, available boolean, last_seen date, sightings bigint, newest struct<day: date, l_orderkey: bigint, l_linenumber: int, l_suppkey: bigint, price_cents: bigint>"
    key = ["store", "product_id"]
    target = sink.VersionedTable(spark, _new_folder(spark, "sightings"), schema, key)

    def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = stored.unionByName(new).groupBy(*key).agg(F.sum("sightings").alias("sightings"), F.max(F.struct("newest", "available")).alias("m"))
        return both.select(*key, F.col("m.newest.price_cents").alias("price_cents"), F.col("m.available").alias("available"), F.col("m.newest.day").alias("last_seen"), "sightings", F.col("m.newest").alias("newest"))

    def save(batch_rows: DataFrame, batch: int) -> bool:
        top = F.max(F.struct(F.struct(F.col("day"), F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_suppkey").cast("long").alias("l_suppkey"), "price_cents").alias("newest"), "available")).alias("m")
        made = batch_rows.groupBy(*key).agg(F.count("*").alias("sightings"), top)
        made = made.select(*key, F.col("m.newest.price_cents").alias("price_cents"), F.col("m.available").alias("available"), F.col("m.newest.day").alias("last_seen"), "sightings", F.col("m.newest").alias("newest"))
        return target.merge(made, batch, combine)

    stream, offsets = _arriving(rows, ["arrives"], 4), _new_folder(spark, "offsets")
    sink.in_slices(stream.writeStream, save, offsets, slices=2)
    save(rows.filter("l_linenumber = 1"), target.last()[1])
    sink.in_slices(stream.writeStream, save, offsets)
    return target.read().select("store", "product_id", "price_cents", "available", "last_seen", "sightings")
