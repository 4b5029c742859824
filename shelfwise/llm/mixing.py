"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_RUN, SPACES, pick, stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Cells per source in which repetitions are decided; a cell's rows are what one task has to sort.
CELLS = 4096
SEED = 20251


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    text, ends = F.coalesce(text, F.lit("")), list(SPACES)
    edge = lambda at: F.substring(text, at, 1).isin(ends).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SPACE_RUN)) - edge(1) - edge(-1)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size) rows, one per source, that together share the sum of all sizes.

    Sharing by weight, clamping what exceeds max_epochs times a source's size and sharing the excess again ends
    where every unclamped source has the same amount per weight, the level. Sorted by cap per weight, the clamped
    sources come first, so running sums find the level in one pass. Adds weight and target.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = sources.withColumn("rank", rank)
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    all_rows = Window.partitionBy()
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (F.sum("source_size").over(all_rows) - clamped) / free).withColumn("place", F.row_number().over(order))
    settled = F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("place", "level"))).over(all_rows)
    table = table.withColumn("settled", settled["level"])
    target = F.least(F.col("cap").cast("double"), F.col("settled") * F.col("weight"))
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, cells: int = CELLS, order: bool = False) -> DataFrame:
    """How many words of each document the mix takes, so that each source's words come within a document of its target.

    A document is taken whole: floor(target / source size) times, and once more for the documents whose words,
    in seeded hash order, come first up to the rest. The order is decided in two steps so that no task holds a
    source: cells of the hash are summed before they are shuffled, and only a cell's own rows are sorted together.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Repeated rows count as many
    documents; equal rows are interchangeable. Empty input: empty result. Other columns are ignored.
    Returns doc_id, source, size, source_size, weight, target, copies, taken; with order also whole (copies every document
    of the source has), cell and draw (its place in the hash order).
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = stage(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), F.pmod(draw, F.lit(cells)).cast("int").alias("cell")), "mix-sizes")
    cell_sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cell_sums = cell_sums.select("source", "cell", F.coalesce(before, F.lit(0)).alias("cell_start"))
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cell_sums.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "cell", "cell_start", "source_size", "weight", "target", "whole", "rest")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.cell") == F.col("p.cell")))
    joined = joined.select("doc_id", "r.source", "size", "draw", "r.cell", "cell_start", "source_size", "weight", "target", "whole", "rest")
    within = Window.partitionBy("source", "cell").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("cell_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = (start + F.col("size") / 2 <= F.col("rest")).cast("long")
    copies = F.least(F.col("whole") + extra, F.lit(max_epochs)).cast("long")
    more = ["whole", "cell", "draw"] if order else []
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: all columns of the documents that it takes, and copies, how often each is taken (1 to max_epochs;
    it replaces a column of that name).

    A source's whole copies and the last document in its hash order that is taken once more are one row a source, which
    meets the documents; texts are not shuffled. Rows with equal id and text are taken alike. Otherwise as mix_sources().
    """
    seed = options.get("seed", SEED)
    cells = options.get("cells", CELLS)
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    order = F.struct(F.pmod(draw, F.lit(cells)).cast("int").alias("cell"), draw.alias("draw"))
    mixed = mix_sources(docs, id_col, text_col, source_col, order=True, **options)
    plan = mixed.groupBy("source").agg(F.min("whole").alias("_whole"), F.max(F.when(F.col("copies") > F.col("whole"), F.struct("cell", "draw"))).alias("_last")).withColumnRenamed("source", "_source")
    plan = stage(plan, "mix-plan")
    keys = pick(docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copies"))), doc_id=id_col, text=text_col, source=source_col, _row="_row")
    joined = keys.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("_whole") + F.coalesce((order <= F.col("_last")).cast("long"), F.lit(0))
    return joined.select("_row.*", copies.alias("copies")).filter("copies > 0")
