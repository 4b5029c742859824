"""Product groups that change: decisions applied to the groups they touch, and groups trimmed to what one number proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.resolve import checkpoint, components

#: Folders that stored links are dealt to by their group; a change reads those of the groups it touches.
BUCKETS = 64


def _bucket(group: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")


def _pairs(links: DataFrame) -> DataFrame:
    """Distinct links with the smaller id first, without links of an item to itself."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def save_groups(links: DataFrame, folder: str, buckets: int = BUCKETS, mode: str = "error") -> None:
    """Write the groups (id, component) of links (a, b) and the links themselves, dealt to folders by their group."""
    links = checkpoint(_pairs(links))
    groups = checkpoint(components(links))
    groups.write.mode(mode).parquet(f"{folder}/groups")
    held = links.join(groups.select(F.col("id").alias("a"), "component"), "a")
    held.withColumn("bucket", _bucket(F.col("component"), buckets)).write.mode(mode).partitionBy("bucket").parquet(f"{folder}/links")


def apply_decisions(spark: SparkSession, folder: str, added: DataFrame, removed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The groups after links (a, b) came and went: (id, component, touched), component being the smallest id.

    A group is touched if an end of a changed link is its member. Only links in the folders of touched groups are read
    (their numbers, at most `buckets`, are all that reaches the driver), and only members of touched groups go
    through the component rounds; all other groups stay as they are stored. A removed link that is also added stays.
    Ends without a stored group count as groups of one; items that keep no link leave.
    """
    added, removed = _pairs(added), _pairs(removed)
    changed = added.union(removed)
    ends = checkpoint(changed.select(F.col("a").alias("id")).union(changed.select("b")).distinct())
    stored = spark.read.parquet(f"{folder}/groups")
    touched = checkpoint(stored.join(ends, "id", "left_semi").select("component").distinct())
    folders = sorted(r.bucket for r in touched.select(_bucket(F.col("component"), buckets).alias("bucket")).distinct().collect())
    held = spark.read.parquet(f"{folder}/links").filter(F.col("bucket").isin(folders)).join(touched, "component", "left_semi").select("a", "b")
    links = held.join(removed, ["a", "b"], "left_anti").union(added).distinct()
    fresh = components(checkpoint(links)).withColumn("touched", F.lit(True))
    return stored.join(touched, "component", "left_anti").select("id", "component", F.lit(False).alias("touched")).unionByName(fresh)


def trim_groups(members: DataFrame, links: DataFrame, refused: DataFrame) -> DataFrame:
    """Groups that hold a refused pair, cut down to the part that one trade item number proves.

    A number proves a part if two members or more have it and no other number has as many. Members with another number
    leave; the links among the rest are followed anew, and the part around the smallest member with the number
    stays if it has two members and no refused pair. What is cut off comes back in groups of its own.
    members: id, component, gtin; links and refused: a, b. Other groups stay as they are.
    Returns id, component, group (smallest id of its part), trimmed (the group was cut), core (the part that stays).
    """
    where = members.select("id", "component")
    inside = refused.join(where.select(F.col("id").alias("a"), "component"), "a").join(where.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").filter("component = other")
    bad = inside.select("component").distinct()
    suspects = checkpoint(members.join(bad, "component", "left_semi").select("id", "component", "gtin"))
    counts = suspects.filter("gtin is not null").groupBy("component", "gtin").agg(F.count("*").alias("n"), F.min("id").alias("anchor"))
    most = counts.groupBy("component").agg(F.max("n").alias("most"))
    top = counts.join(most, "component").filter("n = most and n >= 2").groupBy("component").agg(F.count("*").alias("ties"), F.min("gtin").alias("proof"), F.min("anchor").alias("anchor")).filter("ties = 1")
    kept = checkpoint(suspects.join(top, "component").filter("gtin is null or gtin = proof").select("id", "component", "anchor"))
    ids = kept.select("id")
    among = links.select("a", "b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    parts = components(among).withColumnRenamed("component", "part")
    parts = checkpoint(kept.join(parts, "id", "left").select("id", "component", "anchor", F.coalesce("part", "id").alias("part")))
    core = parts.filter("id = anchor").select("component", F.col("part").alias("core"))
    size = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    clash = inside.select("a", "b").join(parts.select(F.col("id").alias("a"), "part"), "a").join(parts.select(F.col("id").alias("b"), F.col("part").alias("other")), "b").filter("part = other").select("part").distinct()
    proven = core.join(size, (core.component == size.component) & (core.core == size.part)).filter("n >= 2").select(core.component, "core").join(clash.withColumnRenamed("part", "core"), "core", "left_anti")
    cut = suspects.join(proven, "component").join(parts.select("id", "part"), "id", "left")
    group = F.coalesce("part", "id")
    cut = cut.select("id", "component", group.alias("group"), F.lit(True).alias("trimmed"), (group == F.col("core")).alias("core"))
    whole = members.join(proven, "component", "left_anti").select("id", "component", F.col("component").alias("group"), F.lit(False).alias("trimmed"), F.lit(True).alias("core"))
    return whole.unionByName(cut)
