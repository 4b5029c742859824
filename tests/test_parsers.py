"""Element trees, selectors, the three page parsers and the tile reader on small pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import elements, parsers

PAGE = """<!DOCTYPE html><div id=top class="a b"><p>one<p class="c">two <b>bold</b> &amp; more</p><ul><li>x<li data-k='v "q"'>y</ul>
<script>var t = "</p><div class='c'>";</script><br><img src="i.png"/></div></section><div class="c"><span>last"""


def texts(selector):
    return [e.text().strip() for e in elements.select(elements.elements(PAGE), selector)]


def test_selectors_on_untidy_markup():
    assert texts("p") == ["one", "two bold & more"] and texts(".c") == ["two bold & more", "last"]
    assert texts("#top .c b") == ["bold"] and texts("div.c span") == ["last"] and texts("ul .c") == [] and texts("div.a.b li[data-k]") == ["y"]
    assert [e.attrs["src"] for e in elements.select(elements.elements(PAGE), "img[src=i.png]")] == ["i.png"]
    assert next(elements.select(elements.elements(PAGE), "p.c")).text(frozenset({"b"})) == "two  & more"
    assert elements.elements("") == [] and len(elements.elements("<div>" * 5000)) == 5000
    with pytest.raises(ValueError, match="selector"):
        list(elements.select(elements.elements(PAGE), "p>b"))


@pytest.mark.parametrize(
    ("text", "end"),
    [("{}", 1), ("{a{b}c}", 6), ("{&quot;}&quot;}", 14), ("{&quot;\\&quot;}&quot;}", 21), ("{&quot;{&quot;", -1), ("{", -1), ("{&quot;\\\\&quot;}x}", 15), ("{'}'}", 2)],
)
def test_closing_braces(text, end):
    assert elements.closing_brace(text, 0) == end


def test_a_long_broken_payload_takes_linear_time():
    assert elements.closing_brace("{" + "&quot;a\\n&quot;:{}," * 60000, 0) == -1


def test_tiles_are_accounted_for():
    tile = lambda body: f"<i data-gtm-info='{body}'></i>"
    item = '{"items":[{"item_id":%s,"item_name":"%s","price":%s}]}'
    enc = lambda s: s.replace("&", "&amp;").replace('"', "&quot;")
    page = "<a href='/p/a-1.html'>x</a><a href=\"/p/b-2.html?z\">" + "".join(tile(enc(item % x)) for x in [('"1"', "it's {", 1.5), ('"1"', "again", 2), ('"3"', "lost", 1), ('"2"', "", 1), ("2", "n", "null"), ("2", "ok", 3)]) + tile("{oops}") + tile("nothing")
    got = [(t[1], t[2], t[3], t[4]) for t in elements.read_tiles(page.replace("it's", "it&#39;s"), "data-gtm-info")]
    assert got == [("ok", "1", "it's {", 1.5), ("repeated", "1", "again", 2.0), ("unlinked", "3", "lost", 1.0), ("incomplete", "2", "", 1.0), ("incomplete", "2", "n", None), ("ok", "2", "ok", 3.0), ("malformed", None, None, None)]


def test_parsers_tell_what_they_could_not_read(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Vinho &amp; Cia","offers":%s}</script>'
    box = '<div class="ct-pdp--prices"><span class="pwc-tile--price-primary">%s</span><span class="pwc-tile--price-secondary">%s</span></div>'
    pages = [(1, ld % '{"price":"3.99"}' + box % ("3,99€", "5,32€/lt")), (2, ld % "{}"), (3, "<p>none"), (4, None), (5, ""), (6, ld % '{"price":0,"availability":"InStock"}')]
    frame = spark.createDataFrame(pages, "id int, html string")
    today = F.to_date(F.lit("2024-06-01"))
    a = {r.id: r for r in parsers.parsed_pages(frame, "continente", "id", "html", today).collect()}
    assert {k: r.state for k, r in a.items()} == {1: "read", 2: "no price", 3: "no product", 4: "no product", 5: "no product", 6: "read"}
    assert (a[1].name, a[1].brand, a[1].price, a[1].size, a[1].unit, a[1].availability, a[1].shown_unit_price) == ("Vinho & Cia", "Continente", 3.99, 0.75, "l", "unknown", 5.32)
    assert (a[6].price, a[6].availability, a[6].sign) == (None, "not_for_sale", "no sellable price shown") and a[2].name is None
    c = spark.createDataFrame([(1, ld % '[{"price":2,"availability":"schema.org/SoldOut","priceValidUntil":"2024-05-31T10:00"}]'), (2, ld % '{"priceValidUntil":"2024-05-30"}')], "id int, html string")
    c = {r.id: r for r in parsers.parsed_pages(c, "auchan", "id", "html", today).collect()}
    assert (c[1].price, c[1].availability, c[1].promotion_ends) == (2.0, "not_for_sale", datetime.date(2024, 5, 31)) and (c[2].state, c[2].on_promotion) == ("read", False)
    b = spark.createDataFrame([(1, ld % "{}" + '<div class="prices"><b class="price">1.234,50 €</b></div>'), (2, ld % "{}" + '<div class="prices"><b class="price">null/Kg</b></div>')], "id int, html string")
    b = {r.id: r for r in parsers.parsed_pages(b, "pingodoce", "id", "html", today).collect()}
    assert b[1].price == 1234.5 and b[2].state == "no price"
    assert parsers.parsed_pages(frame.limit(0), "auchan", "id", "html", today).collect() == []


def test_made_pages_are_read_by_all_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from shelfwise.plans import parsing

    spark.range(40).selectExpr("id as p_partkey", "'x' as p_name").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    spark.range(500).selectExpr("id as page_id", "'<p>' as html").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    around = parsing._around(spark, f"file://{tmp_path}")
    assert around.count() == 40
    assert around.withColumn("t", F.spark_partition_id()).select("t").distinct().count() >= spark.sparkContext.defaultParallelism
