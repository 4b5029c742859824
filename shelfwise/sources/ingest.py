"""Parsers of sitemaps, product pages and listing tiles as columns, and readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Named character references that pages and sitemaps use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&euro;": "€"}
TILE = "id string, name string, price double, brand string, category string, availability string"


def decode_entities(text: Column) -> Column:
    for a, b in ENTITIES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def sitemap_files(xml: Column) -> Column:
    """Addresses of the product sitemaps in a sitemap index."""
    return F.filter(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: u.rlike("(?i)product"))


def sitemap_entries(files: DataFrame, file: str, xml: str) -> DataFrame:
    """(file, loc, lastmod): entries of sitemaps; a date that cannot be read is null."""
    block = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    rows = files.select(F.col(file).alias("file"), block.alias("_b"))
    loc = decode_entities(F.regexp_extract("_b", r"<loc>\s*([^<\s]*)\s*</loc>", 1))
    date = F.regexp_extract("_b", r"<lastmod>\s*(\d{4}-\d{2}-\d{2})[^<]*</lastmod>", 1)
    return rows.select("file", loc.alias("loc"), date.try_cast("date").alias("lastmod"))


def sitemap_summary(entries: DataFrame, product: Column, samples: int = 5) -> DataFrame:
    """Entries, products and unparseable addresses of each file, with the first few of the latter."""
    bad = entries.withColumn("_bad", F.when(product.isNull() | (product == ""), F.col("loc")))
    w = Window.partitionBy("file").orderBy(F.col("_bad").asc_nulls_last())
    ranked = bad.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy("file").agg(F.count("*").alias("n_entries"), F.count_if(F.col("_bad").isNull()).alias("n_products"), F.count("_bad").alias("n_unparseable"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= samples, F.col("_bad")))).alias("samples"))


def json_ld(html: Column, kind: str = "Product") -> Column:
    """JSON-LD blocks of that @type as strings; blocks that are not JSON are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(blocks, lambda b: F.coalesce(F.get_json_object(b, "$['@type']") == kind, F.lit(False)))


def product_page(html: Column) -> Column:
    """struct<name, brand, price, gtin, availability, category> of a product page's JSON-LD; null where there is none."""
    block = F.get(json_ld(html), 0)
    field = lambda p: F.get_json_object(block, p)
    price = F.coalesce(field("$.offers.price"), field("$.offers[0].price")).try_cast("double")
    return F.when(block.isNotNull(), F.struct(decode_entities(field("$.name")).alias("name"), F.coalesce(field("$.brand.name"), field("$.brand")).alias("brand"), price.alias("price"), F.coalesce(field("$.gtin13"), field("$.gtin14"), field("$.gtin")).alias("gtin"), F.coalesce(field("$.offers.availability"), field("$.offers[0].availability")).alias("availability"), field("$.category").alias("category")))


def page_status(status: Column, html: Column) -> Column:
    """alive, unavailable, gone or unreachable."""
    page = product_page(html)
    return F.when(status.isin(404, 410), "gone").when(status.isNull() | (status >= 400), "unreachable").when(page.isNull(), "gone").when(page["price"].isNull() | F.coalesce(page["availability"].rlike("(?i)outofstock|soldout|discontinued"), F.lit(False)), "unavailable").otherwise("alive")


def is_blocked(status: Column, body: Column) -> Column:
    return (status == 474) | ((status == 403) & F.lower(body).rlike("captcha|denied|blocked|forbidden"))


def tiles(pages: DataFrame, key: str, html: str, attribute: str = "data-product") -> DataFrame:
    """Listing tiles, first of an id: (key, place, id, name, price, brand, category, availability, malformed)."""
    raw = F.regexp_extract_all(F.col(html), F.lit(rf"{attribute}='([^']*)'|{attribute}=\"([^\"]*)\""), F.lit(0))
    rows = pages.select(key, F.posexplode(raw).alias("place", "_raw"))
    text = decode_entities(F.regexp_replace("_raw", rf"^{attribute}=.|.$", ""))
    parsed = rows.withColumn("t", F.from_json(text, TILE, {"mode": "PERMISSIVE"}))
    out = parsed.select(key, "place", "t.*", F.col("t.id").isNull().alias("malformed"))
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("place"))
    return out.withColumn("_first", first).filter("malformed or _first = 1").drop("_first")


def tile_accounts(found: DataFrame, key: str) -> DataFrame:
    """Tiles seen, malformed, unpriced, without category, marked unavailable, of each page."""
    return found.groupBy(key).agg(F.count("*").alias("seen"), F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed") & F.col("price").isNull()).alias("unpriced"), F.count_if(~F.col("malformed") & F.col("category").isNull()).alias("without_category"), F.count_if(F.coalesce(F.lower("availability").rlike("outofstock|indispon"), F.lit(False))).alias("unavailable"))


def result_count(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, r"(\d[\d.\s]*)\s*(?:resultados|produtos|results)", 1), r"[.\s]", "").try_cast("int")


def first_wins(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of several walks; of equal keys the row of the earliest walk stays."""
    tagged = [f.withColumn("_walk", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    order = [F.col("_walk"), *[F.col(c) for c in frames[0].columns if c not in key]]
    return out.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_walk", "_rank")


def product_id(url: Column) -> Column:
    """Last number of three digits or more before .html or the end of the path."""
    return F.nullif(F.regexp_extract(url, r"[-/_](\d{3,})(?:\.html)?/?(?:[?#].*)?$", 1), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path_segments(url: Column) -> Column:
    """Decoded, non-empty parts of an address's path."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def label_from_slug(slug: Column, minor: tuple[str, ...] = ("de", "da", "do", "e", "com", "sem")) -> Column:
    """Words of a slug with capitals, minor words without."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w, i: F.when((i > 0) & w.isin(list(minor)), w).otherwise(F.initcap(w))), " ")


def request_stats(requests: DataFrame) -> DataFrame:
    """Requests, failures, bytes and mean time of each host. requests: url, status, bytes, millis."""
    return requests.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("requests"), F.count_if((F.col("status") >= 400) | F.col("status").isNull()).alias("failed"), F.sum("bytes").alias("bytes"), F.avg("millis").alias("mean_millis"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that cannot be read are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter("_bad is null").drop("_bad")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Wipe and rebuild a derived table."""
    df.write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, root: str, day: str) -> str:
    """A copy of a table as a partition of its own, for later diffs."""
    df.write.mode("overwrite").parquet(path := f"{root}/day={day}")
    return path


def search(items: DataFrame, tokens: str, term: Column, unit_price: str) -> DataFrame:
    """Items with all words of a term, cheapest per unit first, unknown unit prices last."""
    from shelfwise.functions.text import matches_term

    return items.filter(matches_term(F.col(tokens), term)).orderBy(F.col(unit_price).asc_nulls_last())
