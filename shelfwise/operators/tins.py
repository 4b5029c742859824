"""Tins compared like with like: weights placed from other stores' labels, and rows of tins on one weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import tins

#: Columns whose equality makes two wanting tins, or two donors, the same for placing.
WANTED = ["full", "drained", "size"]


def placed_weights(items: DataFrame, item: str, store: str, keys: dict[str, str]) -> DataFrame:
    """Weights that tins lack, from another store's label that states both: item, full, drained, source (how:store).

    items: item, store, full, drained, size and the key columns. keys: how -> column, in order of precedence (barcode
    before same product). Within a key the donor that settles it with the least store, full and drained weight wins; a
    null key meets nothing. Items that nothing settles are left out; weights an item has stay as they are.

    Donors and wanting items are made distinct by key, store and weights before they meet, so the join grows with the
    different weights of a key and not with its rows; a key that a third of all tins share is a few classes.
    """
    found = None
    for rank, (how, key) in enumerate(keys.items()):
        known = items.filter(F.col(key).isNotNull())
        donors = known.filter(F.col("full").isNotNull() & F.col("drained").isNotNull()).select(F.col(key).alias("_key"), F.col(store).alias("_store"), F.col("full").alias("_full"), F.col("drained").alias("_drained")).distinct()
        wanting = known.filter(F.col("full").isNull() | F.col("drained").isNull()).select(F.col(key).alias("_key"), store, *WANTED)
        met = wanting.distinct().join(donors, "_key").filter(F.col(store) != F.col("_store"))
        settled = met.withColumn("p", tins.placed(F.col("full"), F.col("drained"), F.col("size"), F.col("_full"), F.col("_drained"))).filter("p is not null")
        best = settled.groupBy("_key", store, *WANTED).agg(F.min(F.struct(F.lit(rank).alias("rank"), "_store", "_full", "_drained", "p", F.concat(F.lit(f"{how}:"), F.col("_store").cast("string")).alias("source"))).alias("b"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in WANTED]
        rows = known.withColumn("_key", F.col(key)).alias("l").join(best.alias("b"), (F.col("l._key") == F.col("b._key")) & (F.col(f"l.{store}") == F.col(f"b.{store}")) & same[0] & same[1] & same[2])
        rows = rows.select(F.col(f"l.{item}").alias(item), F.col("b.b").alias("b"))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy(item).agg(F.min("b").alias("b"))
    return best.select(item, "b.p.full", "b.p.drained", "b.source")


def tin_rows(rows: DataFrame, row: list[str], tin: Column, labels: dict[str, str]) -> DataFrame:
    """Every row's tins on one weight: adds basis, compared (the size to compare by), sits_out and note.

    rows: the columns of row, unit, size, full, drained, full_source, drained_source. Tins sold by weight vote: the
    drained weight if every tin has it, else the full one if every tin has it, else what more have (drained on a tie); a
    tin without either counts both ways and stays at its size. A tin without the row's weight sits out, with the weight
    it has. Other products stay as they are; a row without tins has no basis. labels: names of stores in notes.

    The votes are counts per row joined back, so a row of any length is no single task's window.
    """
    is_tin = F.coalesce(tin & (F.col("unit") == "kg"), F.lit(False))
    marked = rows.withColumn("_tin", is_tin).withColumn("_open", F.col("full").isNull() & F.col("drained").isNull())
    has = lambda c: F.count_if(F.col("_open") | F.col(c).isNotNull())
    votes = marked.filter("_tin").groupBy(*row).agg(F.count("*").alias("n"), has("drained").alias("d"), has("full").alias("f"))
    basis = F.when(F.col("d") == F.col("n"), "drained").when(F.col("f") == F.col("n"), "full").when(F.col("d") >= F.col("f"), "drained").otherwise("full")
    joined = marked.join(votes.select(*row, basis.alias("basis")), row, "left")
    drained = F.col("basis") == "drained"
    weight = F.when(drained, F.col("drained")).otherwise(F.col("full"))
    source = F.when(drained, F.col("drained_source")).otherwise(F.col("full_source"))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.substring_index(source, ":", -1)) if labels else F.lit(None).cast("string")
    votes_here = F.col("_tin") & ~F.col("_open")
    out = joined.withColumns(
        {
            "compared": F.when(votes_here, weight).otherwise(F.col("size")),
            "sits_out": F.when(votes_here & weight.isNull(), F.when(drained, "full").otherwise("drained")),
            "note": F.when(votes_here & weight.isNotNull(), tins.weight_note(F.col("basis"), source, F.coalesce(name, F.substring_index(source, ":", -1)))),
        }
    )
    return out.drop("_tin", "_open")
