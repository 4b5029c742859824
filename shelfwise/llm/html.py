"""Main-text extraction from HTML: site templates found by element subtrees that recur on a host, and rules for boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import pick, stage

#: A subtree is template if so many pages of its host with different main text have it, and this share of all such pages.
MIN_PAGES = 4
MIN_SHARE = 0.01
#: The share for a single paragraph, heading or list item, which different articles may well have in common.
PROSE_SHARE = 0.5

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object embed canvas audio video form button select option input textarea label nav footer aside menu dialog title noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html td th tr tbody thead tfoot caption legend summary figcaption dd dt li".split())
#: An open element of the second kind ends where one of the first begins, up to the enclosing container.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",))}
#: Blocks of running text; on their own they are template only where they stand outside the article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption summary legend hr address".split())
# Words of class, id and role that mark what is not main text; words that say a layout has such a part or
# not; words for the box around such a part; what may follow of an article's own parts; and of an article element itself.
MARKS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|sidebar|aside|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|respond|reply|replies|discussion|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|popup|modal|overlay|widget|pagination|pager|toolbar|skip|complementary|contentinfo|dialog|form"
)
SAYS_ONLY = frozenset("has have with no not without hide hides hidden show shows".split())
BOX_WORD = re.compile(r"\d[\dx]*|[a-z]|box|list|bar|block|container|wrapper|wrap|inner|outer|area|section|left|right|top|bottom|center|slot|unit|links?|items?|content|body|panel|group|row|col|column|buttons?|icons?|posts|articles|stories|text|title|main|primary|secondary|author|meta|date|thread|message|toggle|open|closed|fixed|sticky|small|large|desktop|mobile|cta|note|notes|media|label|this|card|cards|grid|strip|image|img|inline|feed|zone|space|holder|placement|count|actions?|tools|heading|thumb")
OWN_HEADER = frozenset("article entry post story content section chapter".split())
ARTICLE_MARKS = re.compile(r"comments?|reply|replies|respond|widget|teaser|related|promo\w*|ads?|advert\w*|sponsor\w*|sidebar|recommend\w*")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_mark(name: str, words: re.Pattern = MARKS) -> bool:
    """Whether one class, id or role marks its element: a mark in it that only words for boxes follow.

    "site-footer", "comment-list" and "ad-300x250" do. A layout that has or lacks a part ("has-sidebar", "no-comments") does
    not, nor does a longer name that begins alike ("form-of-government"), nor the header of an article ("entry-header").
    """
    parts = [p for p in re.split(r"[-_]+", name.lower().replace("side-bar", "sidebar")) if p]
    for i, part in enumerate(parts):
        if words.fullmatch(part) and all(BOX_WORD.fullmatch(p) or words.fullmatch(p) for p in parts[i + 1 :]):
            return not (i and (parts[i - 1] in SAYS_ONLY or (part == "header" and parts[i - 1] in OWN_HEADER)))
    return False


class Node:
    """An element: its tag, whether it is boilerplate by its element or attributes, by its names only, and its children."""

    __slots__ = ("children", "marked", "named", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.named, self.marked = tag, [], False, tag in UNSEEN
        if attributes and not self.marked:
            words = ARTICLE_MARKS if tag == "article" else MARKS
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or (name == "style" and HIDDEN.search(value)):
                    self.marked, self.named = True, False
                    return
                if name in ("class", "id", "role") and tag not in ("html", "body", "main") and any(is_mark(v, words) for v in value.split()):
                    self.marked = self.named = True


def parse(html: str) -> Node:
    """The element tree of a page; unbalanced, implied and unknown tags are settled, comments are dropped."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the second kind has an unclosed quote
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(m[0])
            continue
        tag = tag.lower()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        elif tag in IMPLIED:
            before, stops = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in before:
                    del stack[k:]
                    break
                if stack[k].tag in stops:
                    break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            stop = end.start() if end else n
            node.children.append(html[at:stop])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of each unmarked element's subtree by node: its tag, its children's hashes and texts; none without text.

    Works from the leaves up without recursion, as pages may nest to any depth.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.marked]
    out: dict[int, int] = {}
    for node in reversed(order):
        parts = [" ".join(unescape(c).split()) if isinstance(c, str) else str(out.get(id(c), "")) for c in node.children]
        if any(parts):
            out[id(node)] = xxhash.xxh3_64_intdigest("\x1f".join([node.tag, *parts]).encode("utf-8", "replace")) - (1 << 63)
    return out


def _content(root: Node) -> list[Node]:
    """Where the main text is: the unmarked articles (or else main elements), or else the whole page; and top headings.

    Where all of these stand inside elements that only their names mark, those names tell nothing and are passed. Top
    headings (h1) outside the articles come along in page order, but for a page header's: the title of a page often
    stands before its article. Where an article has a heading of its own, others are left out.
    """
    for passed in (False, True):
        for tag in ("article", "main"):
            found: list[Node] = []
            todo = [(root, True, False)]
            while todo:
                node, titles, in_main = todo.pop()
                if node.marked and not (passed and node.named and node.tag != "article"):
                    continue
                if node.tag == tag or (node.tag == "h1" and titles):
                    found.append(node)
                    continue
                in_main = in_main or node.tag == "main"
                titles = in_main or (titles and node.tag != "header")
                todo += [(c, titles, in_main) for c in reversed(node.children) if isinstance(c, Node)]
            bodies = [node for node in found if node.tag == tag]
            if bodies:
                return bodies if any(_holds(node, "h1") for node in bodies) else found
    return [root]


def _holds(top: Node, tag: str) -> bool:
    """Whether an unmarked element of that tag is below."""
    todo = [top]
    while todo:
        node = todo.pop()
        if node.tag == tag and node is not top:
            return True
        todo += [c for c in node.children if isinstance(c, Node) and not c.marked]
    return False


def text_blocks(root: Node) -> list[tuple[str, list[int], list[int]]]:
    """The blocks that no rule leaves out, in page order, white space inside as one space: text, and the hashes of the
    subtrees they are in that may be template: containers, and prose elements outside article and main."""
    blocks: list[tuple[str, list[int], list[int]]] = []
    parts: list[str] = []
    inside: list[tuple[int, bool]] = []
    def flush() -> None:
        if block := " ".join(unescape("".join(parts)).split()):
            blocks.append((block, [h for h, prose in inside if not prose], [h for h, prose in inside if prose]))
        parts.clear()

    content = _content(root)
    whole = content == [root]
    names = {at: h for top in content for at, h in subtree_hashes(top).items()}
    # where there are several, an article or a title as a whole may be template, under the stricter share of prose
    tops = {id(top) for top in content} if len(content) > 1 else set()
    todo: list = list(reversed(content))
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # the end of a block element
            flush()
            if node[0]:
                inside.pop()
        elif isinstance(node, str):
            parts.append(node)
        elif node.tag == "br":
            parts.append(" ")
        elif node.marked or (whole and node.tag == "header"):
            if node.tag in BLOCKS:
                flush()
        elif node.tag in BLOCKS:
            flush()
            top = id(node) in tops
            prose = top or node.tag in PROSE
            named = id(node) in names and (top or (node.tag not in ("html", "body") and node not in content[:1] and (whole or not prose)))
            if named:
                inside.append((names[id(node)], prose))
            todo.append((named,))
            todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    flush()
    return blocks


def page_votes(blocks: list[tuple[str, list[int], list[int]]]) -> tuple[int, int]:
    """Two min-hashes of the three-word shingles of a page's blocks: near copies of a page mostly share both."""
    words = " ".join(b[0] for b in blocks).split()
    hashed = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    low = min(hashed)
    other = min(h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for h in hashed)
    return low - (1 << 63), other - (1 << 63)


def host_of(url: str) -> str:
    """Host of an address, lower-case, without user, port and credentials; empty if there is none."""
    return (re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "") or ["", ""])[1].lower()


def site_templates(marks: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(host, subtree) of subtrees that at least min_pages different pages and that share of their host's pages have.

    marks: host, v1, v2 (votes of a page) and its subtrees (array of subtree, prose). Pages of equal votes are copies
    and count once; of the two counts of votes the smaller holds. Rows are made distinct before they are counted, so a
    host or a subtree with a third of all pages is no single task's work.
    """
    votes = lambda: F.least(F.countDistinct("v1"), F.countDistinct("v2"))
    seen = marks.select("host", "v1", "v2", F.explode("subtrees").alias("s")).select("host", "v1", "v2", "s.subtree", "s.prose")
    often = seen.groupBy("host", "subtree", "prose").agg(votes().alias("n")).filter(F.col("n") >= min_pages)
    total = marks.groupBy("host").agg(votes().alias("n_pages"))
    share = F.when(F.col("prose"), prose_share).otherwise(min_share)
    return often.join(total, "host").filter(F.col("n") >= F.col("n_pages") * share).select("host", "subtree").distinct()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """Main text of whole pages: elements that mark themselves as no main text are left out by rule, then the site's templates.

    1. A page is parsed once. Its blocks, read from its article (or main) elements where there are any, are written
       with the hashes of the element subtrees they are in. What the rules leave out needs no count.
    2. Subtrees are counted per host in pages of different text: copies and near copies of a page vote once, so what an
       article shares with its own copies is no template, however often it is copied.
    3. Blocks in a recurring subtree are deleted, inside articles too. There single paragraphs, headings and items are
       no subtree of their own, as different articles may quote the same; titles outside and articles as a whole go where
       half of the pages have them. A page all of whose blocks recur has no text of its own.

    Null html gives an empty text; null and malformed urls are one host without name; repeated rows stay; other
    columns are ignored; empty table: empty. Returns page_id, url, text, n_chars.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    unit = pa.list_(pa.struct([("text", pa.string()), ("subtrees", pa.list_(pa.int64()))]))
    mark = pa.list_(pa.struct([("subtree", pa.int64()), ("prose", pa.bool_())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            found = [text_blocks(parse(h)) if h else [] for h in b.column(2).to_pylist()]
            votes = [page_votes(x) if x else (None, None) for x in found]
            hosts = [host_of(u) if u else "" for u in b.column(1).to_pylist()]
            blocks = [[{"text": t, "subtrees": c + p} for t, c, p in x] for x in found]
            subtrees = [[{"subtree": s, "prose": False} for s in {s for _, c, _ in x for s in c}] + [{"subtree": s, "prose": True} for s in {s for _, _, p in x for s in p}] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(b)), pa.int64()), b.column(0), b.column(1), pa.array(hosts), *(pa.array(v, pa.int64()) for v in (list(zip(*votes, strict=True)) or [[], []])), pa.array(subtrees, mark), pa.array(blocks, unit)], ["row", "page_id", "url", "host", "v1", "v2", "subtrees", "blocks"])
            row += len(b)

    kind = rows.schema["page_id"].dataType.simpleString()
    made = stage(rows.mapInArrow(read, f"row bigint, page_id {kind}, url string, host string, v1 bigint, v2 bigint, subtrees array<struct<subtree: bigint, prose: boolean>>, blocks array<struct<text: string, subtrees: array<bigint>>>"), "html-blocks", "zstd")
    template = stage(site_templates(made, min_pages, min_share, prose_share), "html-template")
    listed = made.select("row", "host", F.explode("subtrees.subtree").alias("subtree")).join(template, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("template"))
    able = F.size("subtrees") > 0  # other pages cannot lose a block and need no join
    columns = made.select("row", "page_id", "url", "blocks", able.alias("able"))
    joined = columns.filter("able").join(listed, "row", "left").unionByName(columns.filter("not able").withColumn("template", F.lit(None).cast("array<bigint>")))
    own = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["subtrees"], F.col("template")), F.lit(False)))
    text = F.array_join(own["text"], "\n")
    out = joined.select("page_id", "url", text.alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
