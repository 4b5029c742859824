"""History: price periods, streaks, stretches, as-of and interval joins, interval clusters. Keys shuffle once per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_periods(observations: DataFrame, keys: list[str], order: list[str], at: str, values: list[str], following: str | None = None) -> DataFrame:
    """Periods in which the values stay the same, null equal to null.

    A period goes from its first to its last sighting, so a gap without sightings stays visible; the last one of a
    key is open. order begins with `at` and breaks its ties completely. Returns keys, period, values, first_seen,
    last_seen, n_seen, is_open, and the first sighting of the next period where following names that column.

    Rows are sorted once: a period is its first row, with what the first row of the next one and the key's totals say.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [F.lag(v).over(w) for v in values]
    changed = (F.row_number().over(w) == 1) | ~sum((F.col(v).eqNullSafe(b).cast("int") for v, b in zip(values, before, strict=True)), F.lit(0)).eqNullSafe(F.lit(len(values)))
    marked = observations.withColumns({"_new": changed, "_i": F.row_number().over(w), "_before": F.lag(at).over(w), "_n": F.count("*").over(whole), "_end": F.max(at).over(whole), "_begin": F.min(at).over(whole), "_undated": F.count_if(F.col(at).isNull()).over(whole)})
    starts = marked.filter("_new").withColumns({"period": F.row_number().over(w).cast("long"), "_next": F.lead("_i").over(w), "_last": F.lead("_before").over(w), "_following": F.lead(at).over(w)})
    is_open = F.col("_next").isNull()
    stop = F.when(is_open, F.col("_n") + 1).otherwise(F.col("_next"))
    # rows without a date come first; a period that begins there is first seen at the key's first date, if it gets so far
    first = F.coalesce(at, F.when(stop > F.col("_undated") + 1, F.col("_begin")))
    made = {"first_seen": first, "last_seen": F.when(is_open, F.col("_end")).otherwise(F.col("_last")), "n_seen": stop - F.col("_i"), "is_open": is_open}
    more = [F.col("_following").alias(following)] if following else []
    return starts.select(*keys, "period", *values, *(c.alias(name) for name, c in made.items()), *more)


def stretches(periods: DataFrame, keys: list[str], first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """How long each period's value holds: until the next one begins (`until`, exclusive); the last until its last sighting."""
    w = Window.partitionBy(*keys).orderBy(first)
    following = F.lead(first).over(w)
    return periods.withColumn("from", F.col(first)).withColumn("is_last", following.isNull()).withColumn("until", F.coalesce(following, F.col(last)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, closed: str, width: int) -> DataFrame:
    """Intervals [start, end), or [start, end] where closed holds, that hold a point of the same keys (dates).

    A range predicate alone would compare every pair; both sides are dealt to buckets of `width` days and meet on
    (keys, bucket), so a long interval has a row per bucket it touches.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(day(c) / width).cast("int")
    left = points.withColumn("_bucket", bucket(point))
    right = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    hold = (F.col(point) >= F.col(start)) & ((F.col(point) < F.col(end)) | (F.col(closed) & (F.col(point) == F.col(end))))
    return left.join(right, [*keys, "_bucket"]).filter(hold).drop("_bucket")


#: Levels of dyadic day ranges: 2 ** 15 days are 89 years.
LEVELS = 16


def interval_least(points: DataFrame, intervals: DataFrame, keys: list[str], by: list[str], point: str, start: str, end: str, closed: str, value: Column) -> DataFrame:
    """Of each point (keys, date) and each by-group of its keys, the least value among the intervals that hold it.

    Intervals are [start, end), or [start, end] where closed holds. Each is cut into the few dyadic ranges of days that
    make it up (two a level at most); the least value of each range is taken first, and a point looks up the one range
    of each level that it lies in. So no point meets an interval: rows are points and intervals times levels.
    Returns keys, point, by, least.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1900-01-01").cast("date"))
    low, high = day(start), day(end) + F.col(closed).cast("int")
    cut = intervals.select(*keys, *by, value.alias("_v"), low.alias("_a"), high.alias("_z"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level"))
    width = F.pow(F.lit(2), F.col("_level")).cast("long")
    cut = cut.withColumn("_l", F.ceil(F.col("_a") / width).cast("long")).withColumn("_r", F.floor(F.col("_z") / width).cast("long")).filter("_l < _r")
    last = F.col("_level") == LEVELS - 1
    nodes = F.when(last, F.sequence(F.col("_l"), F.col("_r") - 1)).otherwise(F.array_compact(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1))))
    ranges = cut.select(*keys, *by, "_level", F.explode(nodes).alias("_node"), "_v").groupBy(*keys, *by, "_level", "_node").agg(F.min("_v").alias("_v"))
    asked = points.select(*keys, point, day(point).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level"))
    asked = asked.withColumn("_node", F.floor(F.col("_d") / width).cast("long"))
    return asked.join(ranges, [*keys, "_level", "_node"]).groupBy(*keys, point, *by).agg(F.min("_v").alias("least"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the newest right value strictly before it: one union, one window, no range join."""
    a = left.withColumn("_at", F.col(left_at)).withColumn("_side", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("as_of", F.last("_value", ignorenulls=True).over(w))
    return both.filter("_side = 0").drop("_at", "_side", "_value")


def streaks(rows: DataFrame, keys: list[str], order: list[str], hit: Column, limit: int) -> DataFrame:
    """Running count of consecutive hits per key, reset by any other row; reached marks where it first gets to limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_run", F.sum((~F.col("_hit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("streak", F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("reached", F.col("_hit") & (F.col("streak") == limit)).drop("_hit", "_run")


def newest_streak(rows: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """Length of the run of rows, from the newest back, for which same holds."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    broken = rows.withColumn("_broken", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return broken.groupBy(*keys).agg(F.count_if(F.col("_broken") == 0).alias("streak"))


def clusters(runs: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Groups of overlapping [start, end] runs: a new one begins where a run starts after all earlier ones have ended."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    return marked.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def recheck_due(delisted: Column, checked: Column, now: Column, first: int = 7, second: int = 30, later: int = 90) -> Column:
    """Due after 7 and 30 days from delisting, then every 90; never checked is due at once."""
    age, at = F.datediff(now, delisted), F.datediff(checked, delisted)
    step = F.when(at < first, age >= first).when(at < second, age >= second).otherwise(F.datediff(now, checked) >= later)
    return F.coalesce(F.when(checked.isNull(), F.lit(True)).otherwise(step), F.lit(False))


def backfill_open(products: DataFrame, periods: DataFrame, key: str, price: str, at: str) -> DataFrame:
    """One open period for each priced product that has none."""
    missing = products.filter(F.col(price).isNotNull()).join(periods.filter("is_open"), key, "left_anti")
    return missing.select(key, F.col(price), F.col(at).alias("first_seen"), F.col(at).alias("last_seen"), F.lit(True).alias("is_open"))


def carry_history(periods: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Periods of a replaced product under its successor's key, no longer open; all others as they are."""
    moved = periods.join(moves.select(F.col("old").alias(key), "new"), key, "left")
    return moved.withColumn("is_open", F.col("is_open") & F.col("new").isNull()).withColumn(key, F.coalesce("new", key)).drop("new")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, was, now) of every field that differs for keys on both sides, null equal to null."""
    joined = before.alias("b").join(after.alias("a"), key)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("was"), F.col(f"a.{f}").cast("string").alias("now")) for f in fields))
    return joined.select(key, F.explode(F.filter(pairs, lambda p: ~p["was"].eqNullSafe(p["now"]))).alias("c")).select(key, "c.*")


def new_dates(seen: DataFrame, known: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose date differs from the latest known one of their key."""
    latest = known.groupBy(key).agg(F.max(at).alias("_latest"))
    return seen.join(latest, key, "left").filter(~F.col(at).eqNullSafe(F.col("_latest"))).drop("_latest")
