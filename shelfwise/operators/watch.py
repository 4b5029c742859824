"""Watching loads and catalogues, and merges with rules of their own. Every report is an aggregate or a case, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.measures import cents, meaningful_shortfall

# Shares and counts from which a report speaks.
UNKNOWN_AVAILABILITY = 0.05
PROMOTIONS_SEEN, PROMOTIONS_UNKNOWN, PROMOTIONS_MOST = 500, 0.5, 0.7
GONE_TRIED, GONE_SHARE = 20, 0.8
LOG_DAYS = 90


def units_present(rows: DataFrame, kind: str, declared: str, unit: str, comparable: Column) -> DataFrame:
    """(kind, units): the declared unit, or where a kind may be sold in either, those of kg and l that a comparable row has."""
    either = F.coalesce(~F.col(declared).isin("kg", "l", "un"), F.lit(True))
    found = F.array_sort(F.collect_set(F.when(either & comparable & F.col(unit).isin("kg", "l"), F.col(unit))))
    return rows.groupBy(kind).agg(F.max(declared).alias("_d"), found.alias("_u"), F.max(either).alias("_e")).select(kind, F.when(F.col("_e"), F.col("_u")).otherwise(F.array("_d")).alias("units"))


def missing_verdict(page: Column, list_read: Column, listed: Column) -> Column:
    """What is said of a product the walk missed: its page decides where it is gone or unavailable, then the list, if it was read."""
    return F.when(page.isin("gone", "unavailable"), page).when(list_read & ~listed, "unlisted").otherwise(page)


def unknown_availability(read: Column, unknown: Column, most: float = UNKNOWN_AVAILABILITY) -> Column:
    """Share of the products read without a sign of whether they are for sale, where it is above the limit; else null."""
    return F.when((read > 0) & (unknown / read > most), unknown / read)


def promotion_warning(seen: Column, on: Column, off: Column, unknown: Column) -> Column:
    """'unknown', 'none' or 'too many', the first that holds; null if all is well or too few were seen."""
    return F.when(seen < PROMOTIONS_SEEN, None).when(unknown / seen > PROMOTIONS_UNKNOWN, "unknown").when(on == 0, "none").when(on / (on + off) > PROMOTIONS_MOST, "too many")


def size_changes(sizes: DataFrame, store: str, run: str, total: str) -> DataFrame:
    """Each run's total with the one before it of the same store, the change in percent and whether it shrank."""
    before = F.lag(total).over(Window.partitionBy(store).orderBy(run))
    percent = F.when(F.col("previous_total") != 0, 100 * (F.col(total) - F.col("previous_total")) / F.col("previous_total"))
    return sizes.withColumn("previous_total", before).withColumn("percent", percent).withColumn("shrank", F.coalesce(F.col(total) < F.col("previous_total"), F.lit(False)))


def section_problems(sections: DataFrame, run: str) -> DataFrame:
    """Counts by run of what needs a decision. sections: kind, depth, state (undecided, added, vanished)."""
    kind, state = F.col("kind"), F.col("state")
    return sections.groupBy(run).agg(
        F.count_if(state == "undecided").alias("undecided"),
        F.count_if((state == "added") & kind.isin("food", "mixed")).alias("worth_deciding"),
        F.count_if((state == "vanished") & (F.col("depth") == 1) & (kind == "food")).alias("gone_food"),
    )


def reconcile(reported: DataFrame, saved: DataFrame, parents: DataFrame, key: str, unique: list[str], parent: str) -> DataFrame:
    """By key: rows reported and rows saved, duplicates of what should be unique, and rows without a parent.

    Duplicates are counted as rows beyond the first, by partial counts, so a hot key is no single task's work.
    """
    copies = saved.groupBy(key, *unique).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("saved"), F.sum(F.col("n") - 1).alias("duplicates"))
    orphans = saved.join(parents.select(parent).distinct(), parent, "left_anti").groupBy(key).agg(F.count("*").alias("orphans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = reported.join(copies, key, "full").join(orphans, key, "left").select(key, *(zero(c) for c in ("reported", "saved", "duplicates", "orphans")))
    return out.withColumn("ok", (F.col("reported") == F.col("saved")) & (F.col("duplicates") == 0) & (F.col("orphans") == 0))


def take_in_answers(answers: DataFrame, row: str, day: str, answer: str, size: Column, known: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Answers to a review: statistics by day (taken, refused by reason), and rows on which taken answers disagree."""
    problem = F.when(size > most, "too long").when(~F.coalesce(F.col(answer).isin(known), F.lit(False)), "unknown answer").when(F.col(row).isNull(), "no row")
    judged = answers.withColumn("problem", problem)
    days = judged.groupBy(day).agg(F.count_if(F.col("problem").isNull()).alias("taken"), *(F.count_if(F.col("problem") == p).alias(p.replace(" ", "_")) for p in ("too long", "unknown answer", "no row")))
    split = judged.filter("problem is null").groupBy(row).agg(F.count("*").alias("answers"), F.min(answer).alias("lowest"), F.max(answer).alias("highest")).filter("lowest <> highest").select(row, "answers")
    return days, split


def report_problem(kind: Column, group: Column, store: Column, reason: Column, comment: Column, stores: list[str], reasons: list[str], most: int) -> Column:
    """The first thing wrong with a report: comparison, store, reason or comment; null if it is fine."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return F.when(bad(kind.rlike("^[a-z0-9-]{1,60}$") & group.rlike("^[a-z0-9~-]{1,120}$")), "comparison").when(F.coalesce(store, F.lit("")).isin("", *stores) == F.lit(False), "store").when(bad(reason.isin(reasons)), "reason").when(F.length(F.trim(comment)) > most, "comment")


def moved_with(changes: DataFrame, dates: DataFrame, key: str, changed: str, moved: str, nights: int = 1) -> DataFrame:
    """Changes with `signalled`: whether the key's date moved on the same day or at most so many nights later.

    Days fall into stretches of nights + 1, so the dates that can serve a change are in its own stretch, on its day or
    later, or in the next one, early enough: the latest of the one and the earliest of the other decide. A key has at
    most two rows a stretch, whatever its dates and nights, and meets its changes in an equi-join.
    """
    stretch = lambda day: F.floor(F.unix_date(F.col(day).cast("date")) / (nights + 1))
    at, none = stretch(moved), F.lit(None).cast("date")
    own = F.struct(at.alias("_stretch"), F.col(moved).cast("date").alias("_here"), none.alias("_next"))
    served = F.struct((at - 1).alias("_stretch"), none.alias("_here"), F.col(moved).cast("date").alias("_next"))
    reach = dates.filter(F.col(moved).isNotNull()).select(key, F.explode(F.array(own, served)).alias("_s")).groupBy(key, "_s._stretch").agg(F.max("_s._here").alias("_here"), F.min("_s._next").alias("_next"))
    joined = changes.withColumn("_stretch", stretch(changed)).join(reach, [key, "_stretch"], "left")
    with_it = (F.col("_here") >= F.col(changed)) | (F.col("_next") <= F.date_add(F.col(changed), nights))
    return joined.withColumn("signalled", F.coalesce(with_it, F.lit(False))).select(key, changed, *(c for c in changes.columns if c not in (key, changed)), "signalled")


def logs_to_prune(name: Column, modified: Column, now: Column, kept: str, days: int = LOG_DAYS) -> Column:
    """Whether a log is older than the days that are kept and not of the prefix that stays for good."""
    return ~name.startswith(kept) & (F.datediff(now, modified) > days)


def truncated_walk(complete: Column, failed: Column, published: Column, delivered: Column) -> Column:
    """Whether a complete walk missed part of what was published: a department failed, or the gap is more than noise."""
    gap = published - delivered
    return F.coalesce(complete & ((failed > 0) | ((published > 0) & (gap > 0) & meaningful_shortfall(gap, published))), F.lit(False))


def confirms_absences(complete: Column, frozen: Column) -> Column:
    return complete & ~frozen


def gone_brake(tried: Column, gone: Column) -> Column:
    """Whether so many of the pages tried are gone that the store is doubted rather than its products."""
    return (tried >= GONE_TRIED) & (gone / tried > GONE_SHARE)


def promotion_turn(price: Column, regular: Column, promotion: Column, price_before: Column, regular_before: Column, promotion_before: Column) -> Column:
    """'ended' where the price returns to the regular price of before, 'started' where it leaves the price of before; else null."""
    on, was = F.coalesce(promotion, F.lit(False)), F.coalesce(promotion_before, F.lit(False))
    moved = ~cents(price_before).eqNullSafe(cents(price))
    ended = was & ~on & (cents(price) == cents(regular_before)) & moved
    started = ~was & on & (cents(regular) == cents(price_before)) & moved
    return F.when(ended, "ended").when(started, "started")


def identity_swaps(before: DataFrame, now: DataFrame, key: str, code: str, name: str, similar: Column) -> DataFrame:
    """Rows whose id is the same while both have a valid number, another one, and names that are not similar.

    similar may use before_name and name. Returns key, before_code, code, before_name, name.
    """
    old = before.select(key, F.col(code).alias("before_code"), F.col(name).alias("before_name"))
    return now.select(key, code, name).join(old, key).filter((F.col(code) != F.col("before_code")) & ~similar).select(key, "before_code", code, "before_name", name)


def archive_swaps(catalogue: DataFrame, swaps: DataFrame, key: str, on: Column) -> DataFrame:
    """The catalogue with the old row of each swap under id~retired-date, delisted as replaced."""
    hit = catalogue.join(swaps.select(key, F.lit(True).alias("_swap")).distinct(), key, "left")
    retired = F.concat(F.col(key).cast("string"), F.lit("~retired-"), F.date_format(on, "yyyy-MM-dd"))
    gone = F.col("_swap").isNotNull()
    return hit.select(*(c for c in catalogue.columns if c not in (key, "delisted", "reason")), F.when(gone, retired).otherwise(F.col(key).cast("string")).alias(key), F.when(gone, on).otherwise(F.col("delisted")).alias("delisted"), F.when(gone, "replaced").otherwise(F.col("reason")).alias("reason"))


def revalidate(decisions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open decisions (a, b, verdict) held against today's members (id, live, successor), and the members to match anew.

    A member with a live successor hands its decision on, with the smaller id as a; if the successors have one already
    the decision is retired as superseded. A decision with a member that is missing or delisted is retired, and its
    live member is matched anew. Returns a, b, verdict, state (kept, repointed, retired), reason; and id.
    """
    live = members.filter("live").select(F.col("id").alias("successor"), F.lit(True).alias("ok"))
    known = members.join(live, "successor", "left").select("id", "live", F.when(F.col("ok"), F.col("successor")).alias("next"))
    side = lambda s: known.select(F.col("id").alias(s), F.col("live").alias(f"live_{s}"), F.col("next").alias(f"next_{s}"), F.lit(True).alias(f"has_{s}"))
    d = decisions.join(side("a"), "a", "left").join(side("b"), "b", "left")
    to_a, to_b = F.coalesce("next_a", "a"), F.coalesce("next_b", "b")
    d = d.withColumn("moves", F.col("next_a").isNotNull() | F.col("next_b").isNotNull()).withColumn("to_a", F.least(to_a, to_b)).withColumn("to_b", F.greatest(to_a, to_b))
    taken = decisions.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.lit(True).alias("taken")).distinct()
    d = d.join(taken, ["to_a", "to_b"], "left")
    missing = F.col("has_a").isNull() | F.col("has_b").isNull()
    delisted = ~F.coalesce(F.col("live_a") & F.col("live_b"), F.lit(False))
    reason = F.when(F.col("moves") & F.col("taken"), "superseded").when(F.col("moves"), None).when(missing, "missing").when(delisted, "delisted")
    state = F.when(reason.isNotNull(), "retired").when(F.col("moves"), "repointed").otherwise("kept")
    moved = state == "repointed"
    out = d.select(F.when(moved, F.col("to_a")).otherwise(F.col("a")).alias("a"), F.when(moved, F.col("to_b")).otherwise(F.col("b")).alias("b"), "verdict", state.alias("state"), reason.alias("reason"), "live_a", "live_b")
    gone = out.filter("reason in ('missing', 'delisted')")
    again = gone.filter("live_a").select(F.col("a").alias("id")).union(gone.filter("live_b").select(F.col("b").alias("id"))).distinct()
    return out.drop("live_a", "live_b"), again


def enrichment_queue(pairs: DataFrame, read: DataFrame, least: float, n: int) -> DataFrame:
    """Distinct products of the n best pairs of at least that score that were not read yet: id, best score."""
    best = pairs.filter(F.col("score") >= least).orderBy(F.col("score").desc(), "a", "b").limit(n)
    ids = best.select(F.col("a").alias("id"), "score").union(best.select(F.col("b"), "score")).groupBy("id").agg(F.max("score").alias("score"))
    return ids.join(read.select("id"), "id", "left_anti")


def barcode_queue(members: DataFrame, flagged: DataFrame, today: Column, n: int = 300, retry: int = 30) -> DataFrame:
    """Members of flagged groups without a number that were never read, or not for `retry` days; the n first by group and id."""
    due = F.col("gtin").isNull() & (F.col("read_at").isNull() | (F.datediff(today, F.col("read_at")) > retry))
    return members.filter(due).join(flagged.select("component").distinct(), "component", "left_semi").orderBy("component", "id").limit(n).select("component", "id")


def merge_with_rules(stored: DataFrame, seen: DataFrame, key: str, counter: str, keep_count: str, unit: str, fill: list[str]) -> DataFrame:
    """Upsert of checks: the counter grows by one with each sighting, `fill` columns are only filled where null, and a
    stored count (unit un) stays where the page says no size. Rows that were not seen stay as they are."""
    new = seen.select(key, F.lit(True).alias("_seen"), F.col(keep_count).alias("_size"), F.col(unit).alias("_unit"), *(F.col(c).alias(f"_{c}") for c in fill))
    both = stored.join(new, key, "full")
    hit = F.col("_seen").isNotNull()
    keeps = hit & F.col("_size").isNull() & (F.col(unit) == "un")
    pick = lambda old, fresh: F.when(hit & ~F.coalesce(keeps, F.lit(False)), F.col(fresh)).otherwise(F.col(old)).alias(old)
    return both.select(key, (F.coalesce(counter, F.lit(0)) + hit.cast("int")).alias(counter), pick(keep_count, "_size"), pick(unit, "_unit"), *(F.coalesce(c, f"_{c}").alias(c) for c in fill))


def retracted(stored: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    """What a nightly recomputation changes: rows whose value is another now or is no longer supported (null)."""
    new = recomputed.select(key, F.col(value).alias("now"))
    return stored.join(new, key, "left").filter(~F.col(value).eqNullSafe(F.col("now"))).select(key, F.col(value).alias("was"), "now")


def clear_placeholders(price: Column, least: float = 0.01) -> Column:
    """Prices from 0 to `least` are placeholders and become null."""
    return F.when((price > 0) & (price <= least), None).otherwise(price)
