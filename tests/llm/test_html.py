from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import html

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four&nbsp;five<ul><li>six<li>seven</ul><script>x('</p>')</script><form>mail</form><section class='comments'><p>nice</p></section></article><aside>side</aside><footer>&copy;</footer>"


def text_of(page: str) -> str:
    return "\n".join(b[0] for b in html.text_blocks(html.parse(page)))


def extracted(spark, rows) -> dict:
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host", "2 as row", "3 as blocks")
    return {r.page_id: r for r in html.extract_main_text(docs).collect()}


def test_rules_read_only_the_article():
    assert text_of(PAGE) == "A & B\none two three\nfour five\nsix\nseven"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout no-sidebar"><main><article><p>Body.', "Body."), ('<body class="x"><div class="has-sidebar"><article><p>Body.', "Body."), ('<div class="with-menu"><p>Body.', "Body."), ('<div class="page-content no-comments"><p>Body.', "Body."), ('<div class="sidebar-wrapper"><article><p>Body.', "Body."),
        ("<main><h1>Title</h1><article><p>Body.", "Title\nBody."), ("<main><header><h1>Title</h1></header><article><p>Body.", "Title\nBody."), ("<header><h1>Site</h1></header><article><p>Body.", "Body."), ("<h1>Site</h1><article><h1>Title</h1><p>Body.", "Title\nBody."), ("<nav><h1>Menu</h1></nav><main><h1>T</h1><p>b", "T\nb"),
        ('<article><div class="article-header"><h1>T</h1></div><div class="form-of-government"><p>King</p></div>', "T\nKing"), ('<article><p>a</p><article class="reply"><p>nice</p></article><article class="widget">x</article><article class="comment-body">y</article></article>', "a"),
        ('<article class="post has-sidebar"><p>a</p><div id="comment-12">x</div><div class="ad-300x250">y</div><div class="site-footer">z</div><p role="banner">b</p><div class="cookie_notice">c</div>', "a"), ('<article><p>a</p></article><section class="comments"><article class="c1"><p>nice</p></article></section>', "a"), ('<div class="side-bar">x</div><div class="social-history">y</div>', "y"),
    ],
)
def test_names_mark_parts_and_not_layouts(page, text):
    assert text_of(page) == text


def test_pages_of_template_only_are_empty_and_titles_depend_on_the_count(spark):
    words = lambda i: " ".join(f"w{(i * 7919 + j * 104729) % 9973}" for j in range(30))
    rows = [(i, "http://a.example/x", f"<h1>The Site</h1><article><p>{words(i)}</p></article><article><p>Get our app</p></article>") for i in range(12)] + [(20, "http://b.example/x", "<h1>The Site</h1><article><p>alone</p></article>")]
    rows += [(30, "http://a.example/y", "<h1>The Site</h1><article><p>Get our app</p></article>")]
    out = extracted(spark, rows)
    assert all(out[i].text == words(i) for i in range(12)) and out[20].text == "The Site\nalone" and (out[30].text, out[30].n_chars) == ("", 0)


@pytest.mark.parametrize(("page", "text"), [('<div class="x>secret</div>', "secret"), ("<p>a<b", "a"), ("<p>1 < 2</p>", "1 < 2"), ("<div title='a>b'>c</div>", "c"), ("<p>a</p></p></div>b", "a\nb"), ("", "")])
def test_broken_markup(page, text):
    assert text_of(page) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/\"'= abpdiv!-&;", max_size=60))
def test_any_text_parses(page):
    assert isinstance(text_of(page), str)


def pages_of(n, wrap):
    words = lambda k, i: " ".join(f"w{(i * 7919 + j * 104729 + k) % 9973}" for j in range(30))
    return [(i, f"http://a.example/{i}", wrap(f"<p>{words(1, i)}</p><p>same paragraph in many articles</p><p>{words(2, i)}</p>", i)) for i in range(n)]


BOX = "<div><span>Read our new terms</span><ul><li>one</li><li>two</li></ul></div>"


@pytest.mark.parametrize("wrap", [lambda a, i: f"{BOX}<div>{a}</div>", lambda a, i: f"<article>{a}{BOX}</article>"], ids=["no article", "inside the article"])
def test_recurring_subtrees_go_without_any_marking_class(spark, wrap):
    rows = pages_of(12, wrap)
    out = extracted(spark, rows)
    plain = extracted(spark, [(i, f"http://h{i}.example/", h) for i, _, h in rows])  # a host each: nothing recurs
    for i, _, _ in rows:
        assert "terms" in plain[i].text and "terms" not in out[i].text and "two" not in out[i].text
        assert out[i].text.count("\n") == (2 if "<article>" in rows[0][2] else 1 if "same paragraph" not in out[i].text else 2)


def test_copies_of_a_page_vote_once_and_lose_nothing(spark):
    page = f"<div><div>{BOX}</div><div><p>some article with words of its own in it</p></div></div>"
    out = extracted(spark, [(i, "http://a.example/x", page) for i in range(40)])
    assert {r.text for r in out.values()} == {"Read our new terms\none\ntwo\nsome article with words of its own in it"}


def test_templates_equal_a_count_by_hand(spark):
    rows = pages_of(30, lambda a, i: f"<div>variant {i % 3} of the box</div><div>box {i}</div><div>rare {i % 10}</div><div>{a}</div>")
    counts, votes = defaultdict(lambda: (set(), set())), (set(), set())
    for _, _, page in rows:
        blocks = html.text_blocks(html.parse(page))
        v = html.page_votes(blocks)
        for k in (0, 1):
            votes[k].add(v[k])
            for _, units, _ in blocks:
                for u in units:
                    counts[u][k].add(v[k])
    share = max(4, 0.01 * min(map(len, votes)))
    template = {u for u, c in counts.items() if min(map(len, c)) >= share}
    out = extracted(spark, rows)
    for i, _, page in rows:
        kept = [t for t, units, prose in html.text_blocks(html.parse(page)) if not template & set(units)]
        text = [t for t in out[i].text.split("\n") if t != "same paragraph in many articles"]
        assert text == [t for t in kept if t != "same paragraph in many articles"]
        assert not any("variant" in t for t in text) and any(t == f"box {i}" for t in text) and any("rare" in t for t in text)


def test_ids_nulls_empty_pages_and_repeats(spark):
    big = 2**53 + 1
    rows = [(big, "http://a.example", "<p>x"), (big - 1, None, "<p>y"), (None, "::", None), (7, "http://a.example", ""), (8, "http://a.example", "<p>" + "long text " * 200_000)]
    out = extracted(spark, rows)
    assert (out[big].text, out[big - 1].text, out[None].text, out[7].text) == ("x", "y", "", "") and out[8].n_chars == 1_999_999
    assert html.extract_main_text(spark.createDataFrame(rows + rows, "page_id long, url string, html string")).count() == 10
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/pages.parquet").exists(), reason="needs the driver's pages")
def test_same_text_whether_or_not_the_article_is_marked(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    div = pages.selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div>'), '</article>', '</div>') as html")
    assert not html.extract_main_text(pages).select("page_id", "text").exceptAll(html.extract_main_text(div).select("page_id", "text")).count()
