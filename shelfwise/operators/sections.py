"""Sections of stores over runs: what was added and what vanished, what fell, what is published and what is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import plain


def top_kind(path: Column, store: Column, kinds: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The table of decided top sections ready for a left join, and the conditions: same store, same accent-free top key."""
    table = kinds.select(F.col("store").alias("_ks"), plain(F.trim("section")).alias("_kt"), F.col("kind").alias("_kind")).distinct()
    return table, [store == F.col("_ks"), plain(F.trim(F.substring_index(path, "/", 1))) == F.col("_kt")]


def section_changes(seen: DataFrame, runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """store, run, path, change (added, vanished), kind of the top section (undecided where no one decided), is_food.

    seen: store, run, path. runs: store, run, complete. kinds: store, section, kind. A store's first recorded run adds
    nothing. Vanished is what the last run that recorded anything saw and this one did not, and only a complete run can
    say so; a section may vanish again after it came back.
    """
    at = seen.select("store", "run", "path").distinct()
    recorded = at.select("store", "run").distinct().withColumn("_r", F.lit(True))
    known = runs.join(recorded, ["store", "run"], "left")
    earlier = Window.partitionBy("store").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("before", F.last(F.when(F.col("_r"), F.col("run")), ignorenulls=True).over(earlier)).filter("before is not null")
    first = at.groupBy("store", "path").agg(F.min("run").alias("run"))
    added = first.join(known.select("store", "run"), ["store", "run"]).select("store", "run", "path", F.lit("added").alias("change"))
    due = known.filter("complete").select("store", "run", "before").join(at.withColumnRenamed("run", "before"), ["store", "before"])
    vanished = due.join(at, ["store", "run", "path"], "left_anti").select("store", "run", "path", F.lit("vanished").alias("change"))
    changes = added.unionByName(vanished)
    table, same = top_kind(F.col("path"), F.col("store"), kinds)
    kind = F.coalesce("_kind", F.lit("undecided"))
    return changes.join(table, same, "left").select("store", "run", "path", "change", kind.alias("kind"), kind.isin("food", "mixed").alias("is_food"))


def section_warnings(loads: DataFrame, section_drop: float = 0.2, total_drop: float = 0.1, least: int = 50) -> DataFrame:
    """store, run, section (null: the whole store), was, now, warning (fell, missing) against the store's previous run.

    loads: store, run, label, collected. Sections are known by their label without accents, case and outer spaces, as
    two ways of reading a store may spell it differently; labels that are the same then count together. A section below
    `least` before is too small to warn of.
    """
    by_key = loads.groupBy("store", "run", plain(F.trim("label")).alias("section")).agg(F.sum("collected").alias("n"))
    runs = by_key.groupBy("store", "run").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("store").orderBy("run")
    runs = runs.withColumn("was", F.lag("total").over(order)).withColumn("next", F.lead("run").over(order))
    whole = runs.filter((F.col("was") > 0) & (F.col("total") < F.col("was") * (1 - total_drop))).select("store", "run", F.lit(None).cast("string").alias("section"), "was", F.col("total").alias("now"), F.lit("fell").alias("warning"))
    before = by_key.join(runs.filter("next is not null").select("store", "run", "next"), ["store", "run"]).filter(F.col("n") >= least).select("store", F.col("next").alias("run"), "section", F.col("n").alias("was"))
    met = before.join(by_key.withColumnRenamed("n", "now"), ["store", "run", "section"], "left")
    warning = F.when(F.col("now").isNull(), "missing").when(F.col("now") < F.col("was") * (1 - section_drop), "fell")
    return whole.unionByName(met.withColumn("warning", warning).filter("warning is not null").select("store", "run", "section", "was", "now", "warning"))


def audited_paths(addresses: DataFrame, url: str, known: DataFrame) -> DataFrame:
    """path, depth, n_pages, known of every section path that addresses publish, at every depth; queries and ends dropped.

    known: slug, the top sections that have been decided. Paths below an unknown top are unknown with it.
    """
    path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://[^/?#]+/([^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = addresses.select(F.explode(F.transform(parts, lambda p, i: F.struct(F.array_join(F.slice(parts, 1, i + 1), "/").alias("path"), (i + 1).alias("depth")))).alias("s"))
    counted = paths.groupBy("s.path", "s.depth").agg(F.count("*").alias("n_pages"))
    return counted.join(known.select(F.col("slug").alias("_slug")).distinct().withColumn("_known", F.lit(True)), F.substring_index("path", "/", 1) == F.col("_slug"), "left").select("path", "depth", "n_pages", F.coalesce("_known", F.lit(False)).alias("known"))


def coverage(published: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key, published, held, gap of every department asked for; an unread count (null) has no gap, a negative gap is fine.

    published: key and published. held: a row per item held, with key.
    """
    counted = held.groupBy(key).agg(F.count("*").alias("held"))
    return published.join(counted, key, "left").select(key, "published", F.coalesce("held", F.lit(0)).alias("held"), (F.col("published") - F.coalesce("held", F.lit(0))).alias("gap"))


def flags_allow(stored: Column, hiding: list[str]) -> Column:
    """Whether a group with these stored flags (a JSON list) is shown: not with a hiding flag, nor where they cannot be read."""
    flags = F.from_json(stored, "array<string>")
    return F.when(stored.isNull() | (stored == ""), True).otherwise(F.coalesce(~F.arrays_overlap(F.array_compact(flags), F.array(*(F.lit(f) for f in hiding))), F.lit(False)))


def groups_shown(groups: DataFrame, least_stores: int, hiding: list[str]) -> DataFrame:
    """Adds shown and own_brand_shown. groups: stores_compared, own_brand_priced, others (the remainder group), flags."""
    shown = (F.col("stores_compared") >= least_stores) & ~F.coalesce(F.col("others"), F.lit(False)) & flags_allow(F.col("flags"), hiding)
    return groups.withColumn("shown", shown).withColumn("own_brand_shown", shown & (F.col("own_brand_priced") >= least_stores))
