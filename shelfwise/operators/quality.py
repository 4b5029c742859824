"""Monitoring of data loads: baselines, run diffs, brakes, verdicts, review selection, limiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.ordered import places

OK, WARN, FAIL = "OK", "WARN", "FAIL"


def middle(values: Column) -> Column:
    """Median of an array, interpolated; Spark has no ordered window form of median(). Nulls are left out."""
    v = F.array_sort(F.array_compact(values))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)


def count_by_reason(rows: DataFrame, keys: list[str], reasons: dict[str, Column]) -> DataFrame:
    """Total, rows for each reason (first that holds), and the remainder, in one pass."""
    names = list(reasons)
    chain = F.lit("rest")
    for n in reversed(names):
        chain = F.when(F.coalesce(reasons[n], F.lit(False)), n).otherwise(chain)
    marked = rows.withColumn("_reason", chain)
    return marked.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("_reason") == n).alias(n) for n in [*names, "rest"]))


def path_rollup(rows: DataFrame, keys: list[str], path: str, example: str, depth: int = 3) -> DataFrame:
    """Rows under each prefix of a path (array) to that depth, with the first example in order."""
    levels = F.explode(F.sequence(F.lit(1), F.least(F.size(path), F.lit(depth))))
    spread = rows.filter(F.size(path) > 0).select(*keys, F.col(path).alias("_path"), F.col(example).alias("_example"), levels.alias("depth"))
    return spread.withColumn("section", F.array_join(F.slice("_path", F.lit(1), F.col("depth")), "/")).groupBy(*keys, "depth", "section").agg(F.count("*").alias("n"), F.min("_example").alias("example"))


def tally(rows: DataFrame, reason: str, example: str, most: int = 3) -> DataFrame:
    """Count and the first few examples in order, of each reason; partial limits keep a common reason from gathering."""
    w = Window.partitionBy(reason).orderBy(example)
    few = rows.select(reason, example).distinct().withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)
    few = few.groupBy(reason).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return rows.groupBy(reason).agg(F.count("*").alias("n")).join(few, reason, "left")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at floor(n * q) in ascending order, from counts of distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = {n: F.least(F.floor(F.col("_all") * q), F.col("_all") - 1) for n, q in quantiles.items()}
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > k, F.col(value))).alias(n) for n, k in at.items()))


def rolling_baseline(runs: DataFrame, keys: list[str], order: str, value: str, back: int = 5) -> DataFrame:
    """Median of the up to `back` runs before each run, and how far the run is from it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, -1)
    out = runs.withColumn("baseline", middle(F.collect_list(value).over(w))).withColumn("n_before", F.count(value).over(w))
    return out.withColumn("drift", F.try_divide(F.col(value) - F.col("baseline"), F.col("baseline")))


def drop_warnings(now: DataFrame, before: DataFrame, key: str | list[str], value: str, share: float = 0.2, least: int = 50) -> DataFrame:
    """missing, dropped (more than a share of at least `least` rows), new or ok, of each key of two runs."""
    keys = [key] if isinstance(key, str) else key
    joined = before.select(*keys, F.col(value).alias("before")).join(now.select(*keys, F.col(value).alias("now")), keys, "full_outer")
    state = F.when(F.col("now").isNull() | (F.col("now") == 0) & (F.col("before") > 0), "missing").when(F.col("before").isNull(), "new").when((F.col("before") >= least) & (F.col("now") < (1 - share) * F.col("before")), "dropped").otherwise("ok")
    return joined.withColumn("state", state)


def appeared_vanished(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Symmetric difference of two key sets with its direction."""
    a, b = now.select(key).distinct().withColumn("_now", F.lit(True)), before.select(key).distinct().withColumn("_before", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_now is null or _before is null")
    return both.select(key, F.when(F.col("_now").isNull(), "vanished").otherwise("appeared").alias("change"))


def brakes(counts: DataFrame) -> DataFrame:
    """Reasons to stop a destructive step, from one row of counts per load.

    Columns: complete, attempted, dead, dead_limit, non_food, compared, swapped, lost, changed, turnover, unchanged,
    tiles, malformed, kept, uncategorised, unavailable, live, missing.
    """
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    changed = F.greatest(F.col("changed") - F.col("turnover"), F.lit(0))
    big = F.col("complete") & (F.col("compared") >= 500)
    gates = {
        "dead-pages": F.col("complete") & (F.col("attempted") >= 500) & (share("dead", "attempted") > F.col("dead_limit")),
        "non-food": share("non_food", "attempted") > 0.05,
        "barcode-swaps": big & (share("swapped", "compared") > 0.02),
        "barcode-losses": big & (share("lost", "compared") > 0.10),
        "price-churn": big & (F.try_divide(changed, changed + F.col("unchanged")) > 0.30),
        "tile-yield": share("malformed", "tiles") > 0.05,
        "empty-categories": share("uncategorised", "kept") > 0.05,
        "unavailable-share": (share("unavailable", "kept") < 0.01) | (share("unavailable", "kept") > 0.40),
        "under-collected": (F.col("live") >= 500) & (share("missing", "live") > 0.10),
    }
    return counts.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in gates.items()))))


def escalate(levels: Column) -> Column:
    """The worst of an array of verdicts; FAIL is never softened."""
    return F.when(F.array_contains(levels, FAIL), FAIL).when(F.array_contains(levels, WARN), WARN).otherwise(OK)


def sitemap_verdict(runs: DataFrame, key: str, order: str, entries: str, share: float = 0.8, equal: int = 3) -> DataFrame:
    """Whether each run's number of entries is believed: not under a share of the last one, or for the third time about the same.

    About the same is within 50 or 0.5 %, whichever is more.
    """
    w = Window.partitionBy(key).orderBy(order)
    last, second = F.lag(entries, 1).over(w), F.lag(entries, 2).over(w)
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(50.0), 0.005 * a)
    stable = near(F.col(entries), last) & near(F.col(entries), second) if equal == 3 else near(F.col(entries), last)
    high = F.max(entries).over(w.rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(high.isNull(), "first").when(F.col(entries) >= share * high, "trusted").when(F.coalesce(stable, F.lit(False)), "accepted").otherwise("doubted")
    return runs.withColumn("trust", state)


def run_diff(now: DataFrame, before: DataFrame, key: str, price: str, name: str, mover: float = 0.5, absurd: float = 5.0) -> DataFrame:
    """What became of every item between two loads: new, disappeared, absurd, mover, renamed or same."""
    joined = before.select(key, F.col(price).alias("was_price"), F.col(name).alias("was_name")).join(now.select(key, F.col(price).alias("now_price"), F.col(name).alias("now_name"), F.lit(True).alias("_now")), key, "full_outer")
    ratio = F.try_divide(F.greatest("was_price", "now_price"), F.least("was_price", "now_price"))
    change = F.try_divide(F.abs(F.col("now_price") - F.col("was_price")), F.col("was_price"))
    state = F.when(F.col("_now").isNull(), "disappeared").when(F.col("was_name").isNull(), "new").when(ratio >= absurd, "absurd").when(change >= mover, "mover").when(F.col("was_name") != F.col("now_name"), "renamed").otherwise("same")
    return joined.withColumn("state", state).drop("_now")


def round_robin(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows spread evenly over groups: all firsts, then all seconds, and so on."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def staleness(rows: DataFrame, keys: list[str], age_days: Column) -> DataFrame:
    """Items by days since they were last checked, the oldest, and days to go round at today's pace."""
    a = rows.withColumn("_age", age_days)
    out = a.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("_age") <= 0).alias("today"), F.count_if((F.col("_age") > 0) & (F.col("_age") <= 7)).alias("week"), F.count_if((F.col("_age") > 7) & (F.col("_age") <= 30)).alias("month"), F.count_if((F.col("_age") > 30) | F.col("_age").isNull()).alias("older"), F.max("_age").alias("oldest"))
    return out.withColumn("coverage_days", F.ceil(F.try_divide(F.col("total").cast("double"), F.col("today"))).cast("long"))


def select_review(rows: DataFrame, seed: str, pace: int, per_day: int) -> DataFrame:
    """Rows to review: all changed, all reported, then unread up to the pace (odd ones first, then hash order), then rereads.

    rows: id, changed, reported, odd, unread, days_since. Adds reason and place.
    """
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    reason = F.when(F.col("changed"), "changed").when(F.col("reported"), "reported").when(F.col("unread"), "unread").when(F.col("days_since") >= 3, "reread")
    w = Window.partitionBy("reason").orderBy(F.col("odd").desc(), "_order", "id")
    ranked = rows.withColumn("reason", reason).withColumn("_order", order).filter("reason is not null").withColumn("place", F.row_number().over(w))
    return ranked.filter(F.col("reason").isin("changed", "reported") | ((F.col("reason") == "unread") & (F.col("place") <= pace)) | ((F.col("reason") == "reread") & (F.col("place") <= per_day))).drop("_order")


def unusual_usage(days: DataFrame, day: str, value: str, factor: float = 2.0, least: int = 3) -> DataFrame:
    """Days above so many times the median of all earlier days, once there are enough of them."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("before", middle(F.collect_list(value).over(w))).withColumn("unusual", F.coalesce((F.count(value).over(w) >= least) & (F.col(value) > factor * F.col("before")), F.lit(False)))


def limiter(events: DataFrame, key: str, at: str, tie: str, per_window: int, seconds: int, per_day: int) -> DataFrame:
    """Which events a sliding limit lets through: at most per_window earlier ones of the key within so many seconds, and a daily total.

    Counts attempts; see streaming.limiter for the form that counts admitted events only. Times count to the nearest
    second, a half to the even one.
    """
    ts = F.rint(F.unix_micros(F.col(at).cast("timestamp")) / 1e6).cast("long")
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds + 1, Window.currentRow)
    day = Window.partitionBy("_day").orderBy("_s", tie).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("_s", ts).withColumn("_day", F.to_date(at)).withColumn("recent", F.count("*").over(w)).withColumn("_today", F.count("*").over(day))
    return out.withColumn("allowed", (F.col("recent") <= per_window) & (F.col("_today") < per_day)).drop("_s", "_day", "_today")


def cumulative_share(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Running share of the total in descending order; how many groups cover x per cent. No task holds all groups."""
    out = places(rows, "place", [-F.col(value), F.col(key)], value, "_running")
    total = rows.agg(F.sum(value).alias("_total"))
    return out.crossJoin(total).withColumn("share", F.col("_running") / F.col("_total")).withColumn("place", F.col("place").cast("int")).drop("_running", "_total")


def binomial_upper(hits: int, tries: int, level: float = 0.95) -> float:
    """Exact upper bound of a share by bisection on the binomial distribution."""
    from math import comb

    if tries == 0 or hits >= tries:
        return 1.0
    low, high = hits / tries, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if sum(comb(tries, k) * p**k * (1 - p) ** (tries - k) for k in range(hits + 1)) > 1 - level:
            low = p
        else:
            high = p
    return high


def merge_upsert(stored: DataFrame, seen: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer merge; a value is replaced where seen has its flag set_<value>: true with null clears, false keeps.

    A sighting revives: dead_count 0 and delisted false. Unseen rows stay as they are.
    """
    joined = stored.alias("o").join(seen.withColumn("_seen", F.lit(True)).alias("n"), key, "full_outer")
    columns = [F.when(F.col(f"n.set_{v}"), F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values]
    seen_now = F.coalesce(F.col("_seen"), F.lit(False))
    return joined.select(*key, *columns, F.when(seen_now, F.lit(0)).otherwise(F.col("o.dead_count")).alias("dead_count"), F.when(seen_now, F.lit(False)).otherwise(F.col("o.delisted")).alias("delisted"))


def guarded_mark(rows: DataFrame, marks: DataFrame, key: str, column: str, limit: float) -> DataFrame:
    """Set a flag on marked rows, or on none of them where they are more than a share of all rows."""
    share = rows.join(marks.select(key).distinct().withColumn("_m", F.lit(1)), key, "left").agg((F.count("_m") <= limit * F.count("*")).alias("_ok"))
    marked = rows.join(marks.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").join(F.broadcast(share))
    return marked.withColumn(column, F.col("_ok") & F.coalesce("_m", F.lit(False))).drop("_ok", "_m")
