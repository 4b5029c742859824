"""Queries of language order, accent-blind groups and search, and of places over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import locale
from shelfwise.operators import ordered
from shelfwise.plans.catalog import table
from shelfwise.plans.queries import query


def _words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


_WORDS = r"w as (select word, count(*) as n from (select unnest(regexp_extract_all(text, '\p{L}+')) as word from documents) group by 1)"


@query(rf"""with {_WORDS} select word, length(word)::int as letters, row_number() over (partition by length(word) order by word collate pt, encode(word))::int as place from w""")
def words_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """O2: words of every length in Portuguese dictionary order, byte order among equals."""
    words = _words(spark, sf).withColumn("letters", F.length("word"))
    w = Window.partitionBy("letters").orderBy(locale.in_order(F.col("word")), F.col("word").cast("binary"))
    return words.select("word", "letters", F.row_number().over(w).alias("place"))


@query(rf"""with {_WORDS} select replace(strip_accents(lower(word)), 'ß', 'ss') as folded, count(*) as spellings, sum(n)::bigint as n from w group by 1""")
def words_blind(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings that differ in accents or case only, counted as one word."""
    words = _words(spark, sf).groupBy(locale.blind(F.col("word")).alias("k")).agg(F.count("*").alias("spellings"), F.sum("n").alias("n"), F.min(F.col("word")).alias("any"))
    # how the group is shown: the base letters of one of its spellings
    shown = F.replace(F.lower(F.translate("any", "áàâãäåéèêëíìîïóòôõöúùûüñçýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ", "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY")), F.lit("ß"), F.lit("ss"))
    return words.select(shown.alias("folded"), "spellings", "n")


@query("""select doc_id, contains(replace(strip_accents(lower(text)), 'ß', 'ss'), 'cion') as cion, contains(replace(strip_accents(lower(text)), 'ß', 'ss'), 'uber der') as uber, contains(replace(strip_accents(lower(text)), 'ß', 'ss'), 'ntnd') as plain from documents""")
def documents_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a term, accents and case apart; terms are written either way."""
    found = lambda term: locale.contains_blind(F.col("text"), F.lit(term))
    return table(spark, sf, "documents").select("doc_id", found("CIÓN").alias("cion"), found("über DER").alias("uber"), found("ntnd").alias("plain"))


@query("""select o_orderkey, row_number() over (order by (case when o_orderkey % 5 = 0 then null else o_totalprice end) desc nulls last, o_orderkey) as place, (sum(floor(o_totalprice * 100 + 0.5)::bigint) over (order by (case when o_orderkey % 5 = 0 then null else o_totalprice end) desc nulls last, o_orderkey rows unbounded preceding))::bigint as running from orders""")
def order_places(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every order by price, unknown prices last, and the running total, over ranges."""
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    made = ordered.places(o, "place", [F.col("v").isNull(), -F.col("v"), F.col("o_orderkey")], "cents", "running")
    return made.select("o_orderkey", "place", "running")
