"""What a load's counts allow: storm brakes and walk health, absences either way, corroborated sizes, merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least sample, shares above which a load is not believed, and the range of out-of-stock shares.
LEAST = 500
LIMITS = {"dead": 0.10, "non_food": 0.05, "swapped": 0.02, "lost": 0.10, "churn": 0.30, "missing": 0.10, "malformed": 0.05, "uncategorised": 0.05}
UNAVAILABLE = (0.01, 0.40)
SIZE_DRIFT, PRICE_RATIO = 0.01, 1.5


def gates(loads: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Adds reasons, the gates that a load does not pass, and may_confirm, whether absences may be acted on.

    Columns of loads: complete, attempted, dead, non_food, compared, swapped, lost, changed, turnover, unchanged,
    availability_changed, live, missing, tiles, kept, malformed, uncategorised, unavailable, failed (departments),
    published, delivered. A null count passes its gate. Shares of fewer than LEAST rows are not judged, nor, but for
    non-food, those of an incomplete load. Promotions that end or begin (turnover) are no price changes.
    """
    most = LIMITS | (limits or {})
    over = lambda part, whole, key: F.col("complete") & (F.col(whole) >= LEAST) & (F.try_divide(F.col(part), F.col(whole)) > most[key])
    moved = F.greatest(F.col("changed") - F.coalesce("turnover", F.lit(0)), F.lit(0))
    base = moved + F.col("unchanged") + F.coalesce("availability_changed", F.lit(0))
    marked = F.try_divide(F.col("unavailable"), F.col("kept"))
    gap = F.col("published") - F.col("delivered")
    tests = {
        "dead-pages": over("dead", "attempted", "dead"),
        "non-food": (F.col("attempted") > 0) & (F.try_divide(F.col("non_food"), F.col("attempted")) > most["non_food"]),
        "barcode-swaps": over("swapped", "compared", "swapped"),
        "barcode-losses": over("lost", "compared", "lost"),
        "price-churn": F.col("complete") & (base >= LEAST) & (F.try_divide(moved, base) > most["churn"]),
        "failed-department": F.col("complete") & (F.col("failed") > 0),
        "truncated": F.col("complete") & (F.col("published") > 0) & (gap > 5) & (gap > 0.01 * F.col("published")),
        "under-collected": over("missing", "live", "missing"),
        "tile-yield": over("malformed", "tiles", "malformed"),
        "empty-categories": over("uncategorised", "kept", "uncategorised"),
        "unavailable-share": F.col("complete") & (F.col("kept") > 0) & ((marked < UNAVAILABLE[0]) | (marked > UNAVAILABLE[1])),
    }
    freezing = [n for n in tests if n != "unavailable-share"]
    out = loads.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()))))
    frozen = F.arrays_overlap("reasons", F.array(*(F.lit(n) for n in freezing)))
    return out.withColumn("may_confirm", F.coalesce(F.col("complete"), F.lit(False)) & ~frozen)


def unheld(published: DataFrame, held: list[DataFrame], key: str) -> DataFrame:
    """Published ids that no table holds: distinct ids, one anti-join a table."""
    out = published.select(key).filter(F.col(key).isNotNull()).distinct()
    for table in held:
        out = out.join(table.select(key), key, "left_anti")
    return out


def unpublished(held: DataFrame, published: DataFrame, key: str, most: float = 0.05) -> DataFrame:
    """(key, believed): held ids that the published list lacks; not believed, any of them, where they are more than a share."""
    lacking = held.select(key).distinct().join(published.select(key), key, "left_anti")
    share = held.select(key).distinct().join(published.select(key).distinct().withColumn("_p", F.lit(1)), key, "left").agg((F.count_if(F.col("_p").isNull()) <= most * F.count("*")).alias("believed"))
    return lacking.crossJoin(share)


def corroboration(size: Column, unit: Column, here: Column, there: Column) -> Column:
    """Why another store's product no longer vouches for a size, the first reason that holds; null while it does.

    here and there: structs of code, price, size, unit, delisted (null: not in the catalogue).
    """
    ratio = F.try_divide(F.greatest(here["price"], there["price"]), F.least(here["price"], there["price"]))
    both = here["price"].isNotNull() & there["price"].isNotNull()
    return (
        F.when(here["code"].isNull(), "code unknown here")
        .when(there.isNull() | there["delisted"], "no longer on sale")
        .when(~there["code"].eqNullSafe(here["code"]), "another code")
        .when(~there["unit"].eqNullSafe(unit) | there["size"].isNull() | (F.abs(there["size"] - size) > SIZE_DRIFT * size), "another size")
        .when(both & (ratio > PRICE_RATIO), "another price")
    )


def merged_by_label(results: DataFrame, label: str, order: str, item: str, counts: list[str]) -> DataFrame:
    """One row a label: its items in the order of their results, and counts added; a count is null only if it always is.

    Results are (label, order, item, counts); the counts of a result stand in one of its rows, the others are null. A label's
    items are one array, as a report lists them.
    """
    items = F.transform(F.sort_array(F.collect_list(F.when(F.col(item).isNotNull(), F.struct(order, item)))), lambda x: x[item])
    return results.groupBy(label).agg(items.alias("items"), *(F.sum(c).alias(c) for c in counts))


def group_order(groups: DataFrame, rules: DataFrame, sub_kind: str = "sub_kind", labels: str = "labels") -> DataFrame:
    """Adds _rule (the place of the group's sub-kind in its rule table, 998 for one it lacks, 999 for none), n_labels and
    label_text: sorted by these three, groups are in the order of the page."""
    joined = groups.join(rules.select(F.col(sub_kind), F.col("order").alias("_order")), sub_kind, "left")
    rule = F.when(F.col(sub_kind).isNull(), 999).otherwise(F.coalesce("_order", F.lit(998)))
    return joined.withColumn("rule", rule).withColumn("n_labels", F.size(labels)).withColumn("label_text", F.array_join(labels, ",")).drop("_order")
