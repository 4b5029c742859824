"""Generic evaluation of rule tables: ordered first match, gated label sets, sections, certainty. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators.resolve import checkpoint


@dataclass(frozen=True)
class Rule:
    """A rule on plain lower-case names: any head word, a pattern that must match, one that must not, gates."""

    id: str
    heads: tuple[str, ...] = ()
    require: str | None = None
    exclude: str | None = None
    kinds: tuple[str, ...] = ()
    name_only: bool = False


#: Rule lists up to this length become one expression; longer tables are joined on their head words.
INLINE = 500


def _holds(rule: Rule, name: Column, kind: Column | None, head: Column | None) -> Column:
    ok = F.lit(True)
    if rule.heads:
        ok = ok & (head if head is not None else F.split(name, " ")[0]).isin(list(rule.heads))
    if rule.require:
        ok = ok & text.matches(name, rule.require)
    if rule.exclude:
        ok = ok & ~text.matches(name, rule.exclude)
    if rule.kinds and kind is not None:
        ok = ok & kind.isin(list(rule.kinds))
    return F.coalesce(ok, F.lit(False))


def first_match(rules: list[Rule], name: Column, kind: Column | None = None, head: Column | None = None, from_shelf: bool = False) -> Column:
    """Id of the first rule that holds; null if none does. A shelf cannot use rules that are for names only."""
    if len(rules) > INLINE:
        raise ValueError("join long rule tables on their head words with match_heads()")
    use = [r for r in rules if not (from_shelf and r.name_only)]
    return F.coalesce(*(F.when(_holds(r, name, kind, head), F.lit(r.id)) for r in use)) if use else F.lit(None).cast("string")


def label_set(rules: list[Rule], name: Column, kind: Column | None = None) -> Column:
    """Ids of all rules that hold, once each, in the order of the table."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(_holds(r, name, kind, None), F.lit(r.id)) for r in rules))))


def match_heads(items: DataFrame, rules: DataFrame, item: str, tokens: str, name: str) -> DataFrame:
    """First rule (by order) one of whose heads is among an item's tokens; rules: order, id, heads, require, exclude.

    For tables of any length: heads meet tokens in an equi-join; only then are patterns tried. The table is written, so
    that Spark sees how small it is and brings it to the names: a name is not moved, only the first rule of each item.
    """
    # an outer explode (null meets no head): before a plain one Spark would look for empty arrays as early as it can, below a shuffle
    words = items.select(item, F.col(name).alias("_name"), F.explode_outer(F.array_distinct(tokens)).alias("_head"))
    heads = checkpoint(rules.filter("id is not null").select(F.explode("heads").alias("_head"), "order", F.col("id").alias("rule"), text.ascii_patterns("require").alias("require"), text.ascii_patterns("exclude").alias("exclude")))
    holds = F.coalesce(F.rlike("_name", F.col("require")), F.lit(True)) & ~F.coalesce(F.rlike("_name", F.col("exclude")), F.lit(False))
    # the item comes out of the aggregate: a later join's "is not null" on the key itself would go below a shuffle of
    # the items, which the other side of that join then could not share
    first = words.join(heads, "_head").filter(holds).groupBy(item).agg(F.max(item).alias("_id"), F.min(F.struct("order", "rule")).alias("_first"))
    return first.select(F.col("_id").alias(item), F.col("_first.rule").alias("rule"))


def classify(name: Column, shelf_leaf: Column, shelf_parent: Column, rules: list[Rule], cuts: list[str]) -> Column:
    """struct<kind, step>: by the head word, else by the words up to the first cut word, else by shelf leaf, then parent."""
    by_head = first_match(rules, name)
    cut = F.regexp_replace(name, rf"\b(?:{'|'.join(cuts)})\b.*$", "") if cuts else name
    words = F.split(F.trim(cut), " ")
    later = F.get(F.filter(F.transform(words, lambda w: first_match([Rule(r.id, r.heads) for r in rules], name, head=w)), lambda k: k.isNotNull()), 0)
    leaf, parent = first_match(rules, shelf_leaf, from_shelf=True), first_match(rules, shelf_parent, from_shelf=True)
    step = F.when(by_head.isNotNull(), "head").when(later.isNotNull(), "words").when(leaf.isNotNull(), "shelf").when(parent.isNotNull(), "parent").otherwise("none")
    return F.struct(F.coalesce(by_head, later, leaf, parent).alias("kind"), step.alias("step"))


def section_verdict(path_keys: Column, kinds: dict[str, str], skips: list[tuple[str, ...]]) -> Column:
    """struct<kind, skip>: the top key's kind (unknown if undecided), and the first skip prefix that the path begins with."""
    pairs = [F.when(F.get(path_keys, 0) == k, F.lit(v)) for k, v in kinds.items()]
    kind = F.coalesce(*pairs, F.lit("unknown"))
    begins = lambda p: (F.slice(path_keys, 1, len(p)) == F.array(*(F.lit(x) for x in p)))
    skip = F.coalesce(*(F.when(begins(p), F.lit("/".join(p))) for p in skips)) if skips else F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), skip.alias("skip"))


def keep_decision(section: Column, classified: Column) -> Column:
    """struct<keep, reason>: unknown section, not food, skipped shelf, mixed section without a kind, or kept."""
    reason = F.when(section["kind"] == "unknown", "unknown-section").when(section["kind"] == "other", "not-wanted").when(section["skip"].isNotNull(), "skipped").when((section["kind"] == "mixed") & classified.isNull(), "unclassified")
    return F.struct(reason.isNull().alias("keep"), F.coalesce(reason, F.lit("kept")).alias("reason"))


def with_overrides(items: DataFrame, by_item: DataFrame, by_group: DataFrame, item: str, group: str, value: str) -> DataFrame:
    """An item's override beats its group's, which beats the rule; an override may be null and still counts.

    Tables: (item or group, value). Presence is a flag, so coalesce() alone would not do. Adds final and source.
    """
    a = by_item.select(F.col(item), F.col(value).alias("_a"), F.lit(True).alias("_has_a"))
    b = by_group.select(F.col(group), F.col(value).alias("_b"), F.lit(True).alias("_has_b"))
    out = items.join(a, item, "left").join(b, group, "left")
    final = F.when(F.col("_has_a"), F.col("_a")).when(F.col("_has_b"), F.col("_b")).otherwise(F.col(value))
    source = F.when(F.col("_has_a"), "item").when(F.col("_has_b"), "group").otherwise("rule")
    return out.withColumn("final", final).withColumn("source", source).drop("_a", "_b", "_has_a", "_has_b")


def labels_with(labels: Column, add: Column, remove: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_union(F.array_except(labels, F.coalesce(remove, empty)), F.coalesce(add, empty))


def certainty(items: DataFrame, item: str, store: str, code: str, kind: str) -> DataFrame:
    """high where all other stores' items of the same number have the same kind, review where one differs, else none."""
    peers = items.filter(F.col(code).isNotNull()).groupBy(code, store).agg(F.collect_set(kind).alias("own"))
    joined = items.join(peers.select(F.col(code).alias("_c"), F.col(store).alias("_s"), "own"), (F.col(code) == F.col("_c")) & (F.col(store) != F.col("_s")), "left")
    seen = joined.groupBy(item, kind).agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("peers"))
    state = F.when(F.size("peers") == 0, "none").when((F.size("peers") == 1) & (F.get("peers", 0) == F.col(kind)), "high").otherwise("review")
    return seen.select(item, state.alias("certainty"))


def tree_problems(categories: DataFrame, kinds: DataFrame) -> DataFrame:
    """Duplicate kinds, kinds in unknown categories, categories without kinds. categories: category; kinds: kind, category."""
    twice = kinds.groupBy("kind").count().filter("count > 1").select(F.lit("duplicate-kind").alias("problem"), F.col("kind").alias("what"))
    lost = kinds.join(categories, "category", "left_anti").select(F.lit("unknown-category").alias("problem"), F.col("kind").alias("what"))
    empty = categories.join(kinds, "category", "left_anti").select(F.lit("empty-category").alias("problem"), F.col("category").alias("what"))
    return twice.unionByName(lost).unionByName(empty)


def sample_cells(items: DataFrame, cell: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n items of each cell, in seeded hash order, the same on every run."""
    w = Window.partitionBy(*cell).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return items.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
