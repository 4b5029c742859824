"""An exactly-once upsert target for streams: versioned folders of buckets, and a manifest that says which of them are current."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Buckets of a table. A merge rewrites the buckets that its rows fall in; their numbers are all that reaches the driver.
BUCKETS = 16


class VersionedTable:
    """Rows by key in a shared folder. A merge writes new files for the buckets it touches, then one manifest file that
    points at them; readers see the state before it or after it, and files of a merge that died are never pointed at.

    Every manifest row carries the id of its batch. A batch whose id is not above the last one is a repetition and
    changes nothing, which makes a stream that restarts in the middle of a batch exactly-once. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self.manifest = f"{self.folder}/manifest"
        # an empty first version, so that readers and the first merge find a manifest
        empty = spark.createDataFrame([], "version bigint, batch bigint, bucket int, path string")
        empty.coalesce(1).write.mode("append").json(self.manifest)

    def _entries(self) -> DataFrame:
        return self.spark.read.schema("version bigint, batch bigint, bucket int, path string").json(self.manifest)

    def last(self) -> tuple[int, int]:
        """(version, batch) of the newest merge; (0, -1) before the first."""
        row = self._entries().agg(F.max("version").alias("v"), F.max("batch").alias("b")).first()
        return (row.v or 0, -1 if row.b is None else row.b)

    def _paths(self) -> list[tuple[int, str]]:
        newest = self._entries().groupBy("bucket").agg(F.max(F.struct("version", "path")).alias("m")).select("bucket", "m.path")
        return [(r.bucket, r.path) for r in newest.orderBy("bucket").collect()]

    def read(self) -> DataFrame:
        """The current rows."""
        paths = [p for _, p in self._paths()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> bool:
        """Put rows in place of those with the same key (or what combine makes of both); false if the batch was there before.

        rows has one row a key. Stored rows of untouched buckets are neither read nor written.
        """
        version, seen = self.last()
        if batch <= seen:
            return False
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
            paths = [p for b, p in self._paths() if b in touched]
            new = dealt.drop("_bucket")
            if paths:
                stored = self.spark.read.schema(self.schema).parquet(*paths)
                new = combine(stored, new) if combine else stored.join(new.select(*self.key), self.key, "left_anti").unionByName(new)
            folder = f"{self.folder}/data/{version + 1}-{uuid.uuid4().hex}"
            new = new.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
            new.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)
        finally:
            dealt.unpersist()
        made = [(version + 1, batch, b, f"{folder}/_bucket={b}") for b in touched]
        self.spark.createDataFrame(made, "version bigint, batch bigint, bucket int, path string").coalesce(1).write.mode("append").json(self.manifest)
        return True


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def in_slices(writer: DataStreamWriter, save: Callable[[DataFrame, int], object], checkpoint: str, seconds: float | None = None, slices: int | None = None, poll: float = 0.05) -> StreamingQuery:
    """Save micro-batches until nothing is left, the deadline has passed or so many slices are saved.

    A run that stops leaves the rest to the next run over the same checkpoint, which begins with the batch that was not
    finished; save gets the batch's id, by which it can tell a repeated one. No slice is begun after the deadline.
    """
    until = None if seconds is None else time.monotonic() + seconds
    done = 0

    def over() -> bool:
        return (until is not None and time.monotonic() >= until) or (slices is not None and done >= slices)

    class Over(Exception):
        pass

    def one(rows: DataFrame, batch: int) -> None:
        nonlocal done
        if over():
            raise Over
        save(rows, batch)
        done += 1

    query = writer.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not over():
            raise
    return query
