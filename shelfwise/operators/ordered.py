"""Places and running sums over a whole table without a task that holds it: ranges are counted, then rows are ranked in theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.resolve import checkpoint


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with the range of the whole order that each is in (_range); written, so that every reader sees the same ranges."""
    named = rows.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpoint(named.repartitionByRange(n, *_by(order)).withColumn("_range", F.spark_partition_id()))


def _by(order: list[Column]) -> list[Column]:
    return [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]


def places(rows: DataFrame, name: str, order: list[Column], total: str | None = None, running: str | None = None) -> DataFrame:
    """Adds name, the place (from 1) of each row in the whole order, and where a column total is given its running sum.

    order: expressions, ascending with nulls first; descending or nulls last is an expression too (-x, x is null), and the
    last one should be unique. A window over all rows would sort them in one task; here a task sorts a range, and only
    counts of ranges, as many as shuffle partitions, meet in one.
    """
    ranged = _ranges(rows, order)
    value = F.col(total) if total else F.lit(0)
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    # grouped by nothing: a row for each range, as many as there are shuffle partitions
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"), F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_sum"))
    w = Window.partitionBy("_range").orderBy(*_by(order))
    out = ranged.join(sums, "_range").withColumn(name, F.col("_before") + F.row_number().over(w))
    if total:
        out = out.withColumn(running or f"{total}_running", F.col("_sum") + F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_range", "_before", "_sum", *(f"_o{i}" for i in range(len(order))))
