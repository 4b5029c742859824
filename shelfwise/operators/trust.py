"""Whether the size of each load is believed, from what earlier loads were believed: a fold over a source's loads in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of the believed entries below which a load looks cut off, the equal loads after which a new
# level is accepted, and what counts as equal (entries, or a share of them).
SHRINK = 0.95
RUNS = 3
DRIFT, DRIFT_SHARE = 50, 0.005


def load_trust(loads: DataFrame, key: str, order: str, entries: str, files: str, error: str | None = None, suspicion: str | None = None) -> DataFrame:
    """Each load with trusted, why, and the level (entries, files) that it was compared with.

    A load that cannot be read or lists no file is never believed. Otherwise it is doubted if it has fewer files than the
    last believed load or under SHRINK of its entries, or for the reason in the suspicion column. Doubt expires: the load
    that completes RUNS in a row with about the same figures, none of them believed, is accepted, and its figures are what
    the next load is compared with. why is null for a plain believed load, else unreadable, no files, fewer files, shrunk,
    suspicion, or accepted.

    A source's loads are one array, in order; a nightly source has hundreds. Null entries or files count as 0; loads of equal
    order are taken by entries. Rows keep their key, order, entries and files.
    """
    load = F.struct(F.col(order).alias("at"), F.coalesce(entries, F.lit(0)).cast("long").alias("entries"), F.coalesce(files, F.lit(0)).cast("long").alias("files"), (F.col(error).isNotNull() if error else F.lit(False)).alias("failed"), (F.col(suspicion).isNotNull() if suspicion else F.lit(False)).alias("suspect"))
    level = "struct<entries: bigint, files: bigint>"
    verdict = f"struct<at: {loads.schema[order].dataType.simpleString()}, entries: bigint, files: bigint, trusted: boolean, why: string, was: {level}>"
    start = F.struct(F.lit(None).cast(level).alias("base"), F.array().cast(f"array<{verdict}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        figures = F.struct(x["entries"].alias("entries"), x["files"].alias("files"))
        doubt = F.when(x["failed"], "unreadable").when(x["files"] == 0, "no files").when(x["files"] < s["base"]["files"], "fewer files").when(x["entries"] < s["base"]["entries"] * SHRINK, "shrunk").when(x["suspect"], "suspicion")

        def judged(why: Column) -> Column:
            accepted = why.isNotNull() & ~why.isin("unreadable", "no files") & (1 + _alike(s["out"], x) >= RUNS)
            trusted = why.isNull() | accepted
            row = F.struct(x["at"].alias("at"), x["entries"].alias("entries"), x["files"].alias("files"), trusted.alias("trusted"), F.when(accepted, "accepted").otherwise(why).alias("why"), s["base"].alias("was"))
            return F.struct(F.when(trusted, figures).otherwise(s["base"]).alias("base"), F.concat(s["out"], F.array(row)).alias("out"))

        return F.get(F.transform(F.array(doubt), judged), 0)

    folded = loads.groupBy(key).agg(F.sort_array(F.collect_list(load)).alias("loads"))
    rows = folded.select(key, F.explode(F.aggregate("loads", start, step, lambda s: s["out"])).alias("r"))
    return rows.select(key, F.col("r.at").alias(order), F.col("r.entries").alias(entries), F.col("r.files").alias(files), "r.trusted", "r.why", F.col("r.was.entries").alias("was_entries"), F.col("r.was.files").alias("was_files"))


def _alike(out: Column, x: Column) -> Column:
    """How many of the RUNS - 1 loads before this one, newest first, were not believed and look like it, without a gap."""
    one = lambda k: F.try_element_at(out, F.lit(-k))
    like = lambda o: F.coalesce(~o["trusted"] & (o["files"] == x["files"]) & (F.abs(o["entries"] - x["entries"]) <= F.greatest(F.lit(DRIFT), x["entries"] * DRIFT_SHARE)), F.lit(False))
    count = F.lit(0)
    for k in range(RUNS - 1, 0, -1):
        count = F.when(like(one(k)), 1 + count).otherwise(0)
    return count
