"""What is done with fetched pages and walks: routes, stop rules, size backfill, donors, grouped writes, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.measures import reconcile_size
from shelfwise.operators.rules import Rule, classify

#: Rows of one write.
SLICE = 500


def route_page(status: Column, name: Column, shelf: Column, target_shelf: Column, is_food: Callable[[Column, Column], Column]) -> Column:
    """struct<route, shelf, reason> of a fetched page: kept, other, dead or unreachable.

    404, 410 and an answer that cannot be read as a product (null name) are dead; no answer and other errors are
    unreachable, as is a page without a shelf where the target has none either. The page's shelf comes before the
    target's. is_food(shelf, name) tells what is kept; null counts as no.
    """
    where = F.coalesce(shelf, target_shelf)
    dead = F.coalesce(status.isin(404, 410), F.lit(False)) | F.coalesce((status < 400) & name.isNull(), F.lit(False))
    failed = status.isNull() | (status >= 400)
    route = F.when(dead, "dead").when(failed | where.isNull(), "unreachable").when(F.coalesce(is_food(where, name), F.lit(False)), "kept").otherwise("other")
    reason = F.when(dead, "gone or not a product").when(failed, "no answer").when(where.isNull(), "no shelf")
    return F.struct(route.alias("route"), where.alias("shelf"), reason.alias("reason"))


def save_by_section(batch: DataFrame, path: str, section: Column) -> None:
    """Append a batch of kept rows, one folder for each top section."""
    batch.withColumn("section", section).write.mode("append").partitionBy("section").parquet(path)


def walk_stops(pages: DataFrame, tiles: DataFrame, walk: str, page: str, item: str, published: str, page_size: int) -> DataFrame:
    """Pages of each walk up to the one that ends it: (walk, page, n_tiles, fresh, collected, stop).

    A walk ends at a page without tiles (`empty`) or without an id that no earlier page had (`wrapped`), where the
    published count is reached (`complete`), or, if none is published, at a page that is not full (`short`). pages:
    walk, page (from 0), published; tiles: walk, page, item. Null items are no tiles. The ending page is part of it.
    """
    held = tiles.filter(F.col(item).isNotNull())
    first = held.groupBy(walk, item).agg(F.min(page).alias(page)).groupBy(walk, page).agg(F.count("*").alias("fresh"))
    seen = held.groupBy(walk, page).agg(F.count("*").alias("n_tiles"))
    rows = pages.select(walk, page, published).join(seen, [walk, page], "left").join(first, [walk, page], "left").na.fill(0, ["n_tiles", "fresh"])
    stop = F.when(F.col("n_tiles") == 0, "empty").when(F.col("fresh") == 0, "wrapped").when((F.col(page) + 1) * page_size >= F.col(published), "complete").when(F.col(published).isNull() & (F.col("n_tiles") < page_size), "short")
    before = Window.partitionBy(walk).orderBy(page)
    ended = F.count("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("stop", stop).withColumn("_ended", ended).withColumn("collected", F.sum("fresh").over(before))
    return out.filter("_ended = 0").select(walk, page, "n_tiles", "fresh", "collected", "stop")


def backfilled_size(parsed: Column, loose: Column, size: Column, unit: Column, source: Column, page_read: Column, per_item: Column, count: Column, multipack: Column, tin: Column, implausible: Column) -> Column:
    """struct<size, unit, source, via>: a stored size settled again by where it came from.

    In this order: things sold by the piece take their count, or stay as they are; a listing's figure is held against
    the name once more, and gives way to the name where it no longer decides; a page's figure stays unless it cannot be
    true; any other stored size is what the name says today, 1 kg where it is sold loose, else unknown. A blank is
    filled from the name, then from loose sale, but not where a listing left it blank on purpose. parsed is the name's
    parse_size(), loose its sold_loose(), both as columns of their own: they are read many times.
    """
    none, one = F.lit(None).cast("double"), F.lit(1.0)
    blank = F.lit(None).cast("string")
    made = lambda a, b, c, via: F.struct(a.cast("double").alias("size"), b.alias("unit"), c.alias("source"), F.lit(via).alias("via"))
    stays = made(size, unit, source, "kept")
    listed, read = F.coalesce(source == "listing", F.lit(False)), F.coalesce(page_read, F.lit(False))
    decided = reconcile_size(size, F.when(parsed["unit"] == unit, parsed["total"]), multipack, tin)
    from_name = F.when(parsed.isNotNull(), made(parsed["total"], parsed["unit"], blank, "name"))
    from_listing = F.when(~unit.isin("kg", "l") | unit.isNull() | (decided == size), stays).when(decided.isNotNull(), made(decided, unit, source, "listing")).otherwise(F.coalesce(from_name, made(none, blank, blank, "cleared")))
    from_page = F.when(F.coalesce(implausible, F.lit(False)), made(none, blank, source, "cleared")).otherwise(stays)
    loose = F.coalesce(loose, F.lit(False))
    again = F.when((parsed["total"] == size) & (parsed["unit"] == unit), stays).when(parsed.isNotNull(), made(parsed["total"], parsed["unit"], source, "name")).when(loose, made(one, F.lit("kg"), source, "loose")).otherwise(made(none, blank, source, "cleared"))
    filled = F.when(listed, stays).when(parsed.isNotNull(), made(parsed["total"], parsed["unit"], source, "name")).when(loose, made(one, F.lit("kg"), source, "loose")).otherwise(stays)
    pieces = F.when(count.isNotNull(), made(count, F.lit("un"), source, "count")).otherwise(stays)
    return F.when(F.coalesce(per_item, F.lit(False)), pieces).when(size.isNull(), filled).when(listed, from_listing).when(read, from_page).otherwise(again)


def donor_values(items: DataFrame, item: str, store: str, keys: list[str], fits: list[str], value: str) -> DataFrame:
    """(item, value, donor, via) for items without a value, from other stores' items that share a key and all of `fits`.

    Keys rank in their order; within a key the donor with the smallest id gives its value. Donors are reduced to one
    for each key, fit and store before they meet the items, so a key meets at most as many rows as there are stores.
    Null keys and null fits match nothing. Items without any donor are left out.
    """
    wanted = items.filter(F.col(value).isNull())
    found = None
    for rank, key in enumerate(keys):
        on = [key, *fits]
        best = items.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(*on, F.col(store).alias("_from")).agg(F.min(F.struct(F.col(item).alias("donor"), F.col(value).alias("value"))).alias("_d"))
        met = wanted.select(item, store, *on).join(best, on).filter(F.col("_from") != F.col(store))
        met = met.groupBy(item).agg(F.min(F.struct(F.lit(rank).alias("rank"), F.col("_d.donor").alias("donor"), F.col("_d.value").alias("value"), F.lit(key).alias("via"))).alias("_m"))
        found = met if found is None else found.unionByName(met)
    best = found.groupBy(item).agg(F.min("_m").alias("_m"))
    return best.select(item, F.col("_m.value").alias(value), F.col("_m.donor").alias("donor"), F.col("_m.via").alias("via"))


def grouped_writes(changes: DataFrame, values: list[str], most: int = SLICE) -> DataFrame:
    """Changes that write the same values as one write, in slices of `most` rows: (values, n_rows, n_writes)."""
    n = F.count("*")
    return changes.groupBy(*values).agg(n.alias("n_rows"), F.ceil(n / most).alias("n_writes"))


def name_guess(name: Column, rules: list[Rule], cuts: list[str]) -> Column:
    """The kind that a name alone suggests, without a shelf. For the order in which pages are read, never to be stored."""
    unknown = F.lit(None).cast("string")
    return classify(name, unknown, unknown, rules, cuts)["kind"]


def looked_up(items: DataFrame, dimension: DataFrame, key: str, label: str, fallback: Column) -> DataFrame:
    """Items with the label of their key; the fallback where the dimension lacks it or the label is null."""
    names = dimension.select(key, F.col(label).alias("_label"))
    return items.join(names, key, "left").withColumn(label, F.coalesce("_label", fallback)).drop("_label")


def with_hand_columns(computed: DataFrame, by_hand: DataFrame, key: str) -> DataFrame:
    """Computed rows with the columns kept by hand, which survive that the computed ones are made anew."""
    return computed.join(by_hand.dropDuplicates([key]), key, "left")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, html) of a folder of saved pages, packed (.html.gz) or not; the file's name up to its ending is the page."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.html*")
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.html(?:\.gz)?$", 1).alias("page"), F.col("value").alias("html"))


def write_report(report: DataFrame, root: str, stamp: str) -> None:
    """A run's report (one row) under its stamp, as `latest`, and as one more row of the history."""
    report.write.mode("overwrite").json(f"{root}/runs/{stamp}")
    report.write.mode("overwrite").json(f"{root}/latest")
    report.withColumn("stamp", F.lit(stamp)).write.mode("append").json(f"{root}/history")


def failure_report(spark: SparkSession, store: str, error: BaseException, problems: int = 1) -> DataFrame:
    """The report of a run that broke off: FAIL, so that `latest` never shows an earlier night's success."""
    return spark.createDataFrame([(store, "FAIL", problems, f"{type(error).__name__}: {error}")], "store string, verdict string, problems int, error string")
