"""How sure a kind is, what verified decisions say of today's, and what to review next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.shown import days_between


def certainty_levels(items: DataFrame, item: str, store: str, code: str) -> DataFrame:
    """Adds level (high, review, none) and why to items with kind, step (head, cut, shelf) and reviewed.

    A reviewed decision stands. Otherwise the kinds that other stores give the same code decide: one where there is
    none here, or another one, asks for review; a head word is enough by itself; a cut word or a shelf needs the same
    kind elsewhere, found there by a head word or in review. Kinds are named in sorted order.

    A code's peers are its different (store, kind, firm), so what meets an item grows with stores and kinds and not
    with the rows of a code. Null codes have no peers.
    """
    firm = F.coalesce(F.col("reviewed"), F.lit(False)) | F.coalesce(F.col("step") == "head", F.lit(False))
    peers = items.filter(F.col(code).isNotNull()).select(F.col(code).alias("_code"), F.struct(F.col(store).alias("store"), "kind", firm.alias("firm")).alias("p")).distinct().groupBy("_code").agg(F.collect_list("p").alias("_peers"))
    joined = items.join(peers, F.col(code) == F.col("_code"), "left")
    others = F.filter(F.coalesce("_peers", F.array().cast(peers.schema["_peers"].dataType)), lambda p: p["store"] != F.col(store))
    joined = joined.withColumn("_others", others)
    joined = joined.withColumn("_kinds", F.array_sort(F.array_distinct(F.filter(F.transform("_others", lambda p: p["kind"]), lambda k: k.isNotNull()))))
    differs = F.filter("_kinds", lambda k: k != F.col("kind"))
    confirmed = F.exists("_others", lambda p: p["firm"] & (p["kind"] == F.col("kind")))
    how = F.when(F.col("step") == "cut", "a cut word").otherwise("the shelf")
    kind, reviewed = F.col("kind"), F.coalesce(F.col("reviewed"), F.lit(False))
    say = lambda level, why: F.struct(level.alias("level"), why.alias("why"))
    said = (
        F.when(reviewed, say(F.when(kind.isNull(), "none").otherwise("high"), F.lit("decided in review")))
        .when(kind.isNull() & (F.size("_kinds") > 0), say(F.lit("review"), F.concat(F.lit("no kind here, but the same code is "), F.array_join("_kinds", " / "), F.lit(" elsewhere"))))
        .when(kind.isNull(), say(F.lit("none"), F.lit("no kind")))
        .when(F.size(differs) > 0, say(F.lit("review"), F.concat(F.lit("the same code is "), F.array_join(differs, " / "), F.lit(" at another store"))))
        .when(F.col("step") == "head", say(F.lit("high"), F.lit("decided by the head word")))
        .when(F.coalesce(confirmed, F.lit(False)), say(F.lit("high"), F.concat(F.lit("decided by "), how, F.lit(", confirmed by code"))))
        .otherwise(say(F.lit("review"), F.concat(F.lit("decided by "), how, F.lit(", unconfirmed"))))
    )
    return joined.withColumn("_said", said).select(*items.columns, "_said.level", "_said.why")


def gold_broken(now: DataFrame, gold: list[DataFrame], keys: list[str]) -> DataFrame:
    """Verified items whose kind is another today: keys, verified, now (null: no kind). Items that are gone are not checked.

    now and every gold table: keys and kind. An item in several gold tables is checked against each of them.
    """
    verified = None
    for g in gold:
        rows = g.select(*keys, F.col("kind").alias("verified"))
        verified = rows if verified is None else verified.unionByName(rows)
    joined = verified.distinct().join(now.select(*keys, F.col("kind").alias("now")), keys)
    return joined.filter(~F.col("verified").eqNullSafe(F.col("now")))


def review_batches(levels: DataFrame, batch: list[str], n: int, hidden: DataFrame | None = None) -> DataFrame:
    """The n largest batches of items in need of review: place, n_items and the batch columns; ties by these columns.

    levels: level, kind, step and the columns of batch; no kind is shown as '-', no step as 'barcode'. hidden: kinds
    that are not reviewed. n is the feature's limit; the places are those of the n rows that are left.
    """
    due = levels.filter("level = 'review'")
    if hidden is not None:
        due = due.join(hidden.select("kind").distinct(), "kind", "left_anti")
    due = due.withColumns({"kind": F.coalesce("kind", F.lit("-")), "step": F.coalesce("step", F.lit("barcode"))})
    top = due.groupBy(*batch).agg(F.count("*").alias("n_items")).orderBy(F.col("n_items").desc(), *batch).limit(n)
    order = F.struct((-F.col("n_items")).alias("_n"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in batch))
    listed = top.agg(F.array_sort(F.collect_list(order)).alias("l")).select(F.posexplode("l").alias("at", "b"))
    return listed.select((F.col("at") + 1).alias("place"), (-F.col("b._n")).alias("n_items"), *(F.col(f"b.{c}").alias(c) for c in batch))


def rereads(rows: DataFrame, key: str, today: Column, this_round: int, per_day: int, seed: str, rest_days: int = 2) -> DataFrame:
    """Draws per_day rows to be read again, none twice before all others had their turn: key, round, new_round.

    rows: key, read_on, reread_round. Rows read rest_days ago or longer may be drawn. Those not yet drawn in this round
    come first; where these are too few and no other row still waits for its turn, a new round begins for the rest.
    The order is a seeded hash, so a repeated draw is the same.
    """
    known = rows.filter(F.col("read_on").isNotNull())
    able = days_between(F.col("read_on"), today) >= rest_days
    turn = F.col("reread_round") < this_round
    waits = known.agg(F.coalesce(F.bool_or(turn & ~able), F.lit(False)).alias("_waits"))
    chosen = known.filter(able).crossJoin(F.broadcast(waits)).filter(turn | ~F.col("_waits"))  # one row
    drawn = chosen.withColumn("new_round", ~turn).orderBy("new_round", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(per_day)
    return drawn.select(key, (F.lit(this_round) + F.col("new_round").cast("int")).alias("round"), "new_round")
