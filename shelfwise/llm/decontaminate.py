"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import pick, stage, words_of

SHINGLE = 5
CONTAINMENT = 0.75


def _hashes(words: Column, n: Column) -> Column:
    """Distinct 64-bit hashes of the word shingles; a shorter text is one shingle; an empty text has none."""
    at = lambda i, j: F.get(words, i + j)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(at(i, j) for j in range(SHINGLE))))
    return F.array_distinct(F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words), F.lit("short")))).otherwise(F.array().cast("array<bigint>")))


def _texts(words: Column, n: Column) -> Column:
    """The shingles themselves, for exact verification."""
    many = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))
    return F.array_distinct(F.when(n >= SHINGLE, many).when(n > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>")))


def shingled(df: DataFrame) -> DataFrame:
    """Adds words, n_words and hashes, each in a projection of its own so that Catalyst computes them once."""
    df = df.withColumn("words", words_of(F.lower("text")))
    df = df.withColumn("n_words", F.when((F.size("words") == 1) & (F.get("words", 0) == ""), 0).otherwise(F.size("words")))
    return df.withColumn("hashes", _hashes(F.col("words"), F.col("n_words")))


def size_class(n: Column) -> Column:
    """Class k holds set sizes from 2^k to 2^(k+1) - 1 (0 too has class 0).

    Never null: for a nullable join key Catalyst pushes an IS NOT NULL filter below the projections of shingled(),
    with all of them inlined, so that every shingle would split the text anew.
    """
    return F.coalesce(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"), F.lit(0))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and a benchmark item of whose word shingles the document holds at least that share.

    Documents are partitioned by the size of their shingle set. An item of q shingles needs c = ceil(share * q) of
    them, so it is searched only in classes that can hold c; its MinHash signature is the q - c + 1 smallest
    shingle hashes. A document that holds c of the q shingles cannot miss all of the signature, so the search has
    recall 1 for any document length, unlike signatures of a fixed length on the side of the long documents.
    Shingle hashes of all documents are joined with the signatures (Spark broadcasts those while they are small, and
    shuffles both sides beyond). Documents with a hit are verified on the shingle texts: theirs are joined with the
    items' and counted by pair, so that neither a long text nor an item in many documents is one task's work.

    Words are runs of characters other than ASCII white space, lower-cased. Null and empty texts match nothing. A
    text of fewer than five words is one shingle. Repeated documents give one row per (doc_id, text); rows with the
    same (item_id) and text are one item; a second text of an item is an item of its own with that id. Null ids are
    kept as ids. Empty tables: empty result.
    Returns doc_id, text_key (two hashes of the text), item_id, n_item, n_shared, containment.
    """
    items = shingled(pick(benchmark, item_id=item_col, text=item_text_col).distinct()).filter("n_words > 0")
    items = stage(items.select("item_id", F.xxhash64("item_id", "text").alias("item"), "words", "n_words", "hashes"), "bench-items")
    q = F.size("hashes")
    items = items.withColumn("need", F.ceil(q * containment - 1e-9).cast("int"))
    signed = items.select("need", F.explode_outer(F.slice(F.array_sort("hashes"), 1, q - F.col("need") + 1)).alias("hash")).groupBy("hash").agg(F.min("need").alias("need"))
    wanted = items.select("item_id", "item", "need", F.explode_outer(_texts(F.col("words"), F.col("n_words"))).alias("shingle"))
    wanted = wanted.withColumn("n_item", F.count("*").over(Window.partitionBy("item")))

    keyed = pick(docs, doc_id=id_col, text=text_col).withColumn("k1", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn("k2", F.coalesce(F.xxhash64(F.lit(7), "text"), F.lit(0)))
    probes = shingled(keyed).select("k1", "k2", size_class(F.size("hashes")).alias("class"), F.explode_outer("hashes").alias("hash"))
    hit = stage(probes.join(stage(signed, "bench-signatures"), "hash").filter("need < shiftleft(2L, class)").select("k1", "k2").distinct(), "bench-hits")
    found = keyed.join(hit, ["k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    own = shingled(found).select("doc_id", "k1", "k2", F.explode_outer(_texts(F.col("words"), F.col("n_words"))).alias("shingle"))
    pairs = own.join(stage(wanted, "bench-shingles"), "shingle").groupBy("doc_id", "k1", "k2", "item_id", "item").agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("need").alias("need"))
    return pairs.filter("n_shared >= need").select("doc_id", F.array("k1", "k2").alias("text_key"), "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a benchmark item; being a matter of the text alone, it holds for all its copies."""
    text_col = options.get("text_col", "text")
    bad = stage(contaminated(docs, benchmark, **options).select(F.get("text_key", 0).alias("_bad1"), F.get("text_key", 1).alias("_bad2")).distinct(), "bench-found")
    text = F.col(f"`{text_col}`")
    return docs.join(bad, (F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("_bad1")) & (F.coalesce(F.xxhash64(F.lit(7), text), F.lit(0)) == F.col("_bad2")), "left_anti")
