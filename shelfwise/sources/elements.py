"""Values of page elements by rule tables: a small element tree and selectors inside tasks, one row of raw values a page."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: elements without an end, elements whose end may be left out before the next of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "section", "article"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def text(self, without: frozenset[str] = frozenset()) -> str:
        """All text below, in order; own children of the tags in without left out."""
        out, stack = [], [(self, True)]
        while stack:
            node, top = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend((c, False) for c in reversed(node.children) if isinstance(c, str) or not (top and c.tag in without))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.at = self.root
        self.all: list[Element] = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_NEXT.get(self.at.tag, ()) or (self.at.tag == "p" and tag in CLOSED_BY_NEXT["p"]):
            self.at = self.at.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        self.all.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def elements(page: str) -> list[Element]:
    """The elements of a page in document order; end tags without a start are passed over, open elements end with the page."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.all


PART = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[#.][A-Za-z0-9_-]+|\[[^\]]+\])*)")
PIECE = re.compile(r"#([A-Za-z0-9_-]+)|\.([A-Za-z0-9_-]+)|\[([a-z-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


@lru_cache(256)
def _compound(part: str) -> tuple[str | None, tuple[tuple[str, str, str], ...]]:
    m = PART.fullmatch(part)
    if not m:
        raise ValueError(f"selector {part!r}")
    tests = [("id", i, "") if i else ("class", c, "") if c else ("attr", a, v) for i, c, a, v in PIECE.findall(m[2])]
    return (m[1] if m[1] != "*" else None), tuple(tests)


def _fits(e: Element, part: str) -> bool:
    tag, tests = _compound(part)
    if tag and e.tag != tag:
        return False
    for kind, name, value in tests:
        if kind == "id" and e.attrs.get("id") != name or kind == "class" and name not in e.attrs.get("class", "").split() or kind == "attr" and (name not in e.attrs or value and e.attrs[name] != value):
            return False
    return True


def select(found: list[Element], selector: str) -> Iterator[Element]:
    """Elements that a selector of tag, #id, .class and [attr=value] parts fits; parts apart by a space are ancestors."""
    *above, last = selector.split()
    for e in found:
        if _fits(e, last):
            up, k = e.parent, len(above) - 1
            while up is not None and k >= 0:
                k -= _fits(up, above[k])
                up = up.parent
            if k < 0:
                yield e


@dataclass(frozen=True)
class Rule:
    """How a field is read: from the page's JSON-LD block of a type (path), from the first element that a selector fits
    (its text, an attribute, or whether there is one), or from the first match of a pattern in the raw page (group 1)."""

    name: str
    path: str | None = None
    selector: str | None = None
    take: str = "text"
    without: tuple[str, ...] = ()
    pattern: str | None = None


def json_ld(found: list[Element], kind: str) -> dict | None:
    """The first JSON-LD object of that @type; blocks that cannot be read are passed over, lists and graphs opened."""
    for e in select(found, "script[type=application/ld+json]"):
        try:
            value = json.loads(e.text())
        except ValueError:
            continue
        queue = [value]
        while queue:
            v = queue.pop(0)
            if isinstance(v, list):
                queue = [*v, *queue]
            elif isinstance(v, dict):
                if v.get("@type") == kind:
                    return v
                queue = [*(v.get("@graph") or []), *queue] if isinstance(v.get("@graph"), list) else queue
    return None


def _at(value, path: str):
    for step in path.split("."):
        if isinstance(value, list):
            value = value[0] if value else None
        value = value.get(step) if isinstance(value, dict) else None
    return value


def read_fields(page: str, rules: tuple[Rule, ...], kind: str = "Product") -> dict[str, str | None]:
    """Raw values of one page by the rules; missing ones are null. found tells whether there is a block of that type."""
    tree = elements(page)
    block = json_ld(tree, kind)
    out: dict[str, str | None] = {"found": None if block is None else "true"}
    for r in rules:
        value = None
        if r.path:
            got = _at(block, r.path)
            value = None if got is None or isinstance(got, (dict, list)) else json.dumps(got) if isinstance(got, (bool, int, float)) else str(got)
        elif r.selector:
            e = next(select(tree, r.selector), None)
            if e is not None:
                value = "true" if r.take == "exists" else e.text(frozenset(r.without)).strip() if r.take == "text" else e.attrs.get(r.take)
        elif r.pattern and (m := re.search(r.pattern, page)):
            value = m[1]
        out[r.name] = value
    return out


def page_values(pages: DataFrame, key: str, html: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, v: map of the rules' raw values) of every page; a null page has no values. A page is parsed once for all rules."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                values = [list(read_fields(t, rules).items()) if t is not None else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.map_(pa.string(), pa.string()))], ["key", "v"])

    return rows.mapInArrow(run, f"key {kind}, v map<string, string>").withColumnRenamed("key", key)


# -- tiles whose data is JSON in an attribute ----------------------------------------------------------------------------

QUOTE = "&quot;"


def closing_brace(s: str, start: int) -> int:
    """Where the brace that opens at start closes, or -1. Braces in strings do not count; the quotes of strings are
    character references, and a backslash in a string hides the character after it."""
    depth, inside, i, n = 0, False, start, len(s)
    ahead: dict[str, int] = {}

    def following(mark: str) -> int:
        at = ahead.get(mark, -1)
        if at < i:
            at = s.find(mark, i)
            ahead[mark] = at = n if at < 0 else at
        return at

    while i < n:
        if inside:
            quote, back = following(QUOTE), following("\\")
            if back < quote:
                i = back + 2
            else:
                inside, i = False, quote + len(QUOTE)
            continue
        i = min(following("{"), following("}"), following(QUOTE))
        if i >= n:
            return -1
        if s[i] == "{":
            depth += 1
        elif s[i] == "}":
            depth -= 1
            if depth == 0:
                return i
        else:
            inside, i = True, i + len(QUOTE) - 1
        i += 1
    return -1


def payloads(page: str, attribute: str) -> tuple[list[str], bool]:
    """The JSON objects that the attribute holds, entities decoded, and whether the page ends inside one."""
    mark, out, i = f"{attribute}=", [], 0
    while (at := page.find(mark, i)) >= 0:
        start = at + len(mark) + 1
        if page[start - 1 : start] not in ("'", '"') or page[start : start + 1] != "{":
            i = at + len(mark)
            continue
        end = closing_brace(page, start)
        if end < 0:
            return out, True
        out.append(entities.unescape(page[start : end + 1]))
        i = end + 1
    return out, False


ADDRESS = re.compile(r"""href=["']([^"']*?-(\d+)\.html[^"']*)["']""")
TILE = "place int, state string, id string, name string, price double, brand string, category string, url string"


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def read_tiles(page: str, attribute: str) -> list[tuple]:
    """A page's tiles, and what became of each: ok, malformed, several (a list of the whole page), incomplete, repeated
    (an id that was there before) or unlinked (no address of its id). The end of a broken page is malformed."""
    urls: dict[str, str] = {}
    for m in ADDRESS.finditer(page):
        urls.setdefault(m[2], m[1])
    found, broken = payloads(page, attribute)
    out, seen = [], set()
    for place, raw in enumerate(found):
        try:
            items = json.loads(raw).get("items")
        except ValueError:
            out.append((place, "malformed", *(None,) * 6))
            continue
        if not isinstance(items, list) or len(items) != 1 or not isinstance(items[0], dict):
            out.append((place, "several", *(None,) * 6))
            continue
        item = items[0]
        id_, name, price = item.get("item_id"), item.get("item_name"), item.get("price")
        category = "/".join(x for x in (item.get("item_category2"), item.get("item_category")) if x)
        state = "incomplete" if not id_ or not name or price is None else "repeated" if id_ in seen else "unlinked" if not urls.get(str(id_)) else "ok"
        if state == "ok":
            seen.add(id_)
        out.append((place, state, id_ and str(id_), name and str(name), _number(price), item.get("item_brand"), category, urls.get(str(id_))))
    if broken:
        out.append((len(found), "malformed", *(None,) * 6))
    return out


def embedded_tiles(pages: DataFrame, key: str, html: str, attribute: str = "data-gtm-info") -> DataFrame:
    """Every tile of every page with its state; a null page has none."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    names = [c.split()[0] for c in TILE.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                made = [(i, t) for i, page in enumerate(part.column(1).to_pylist()) if page is not None for t in read_tiles(page, attribute)]
                owner = part.column(0).take(pa.array([i for i, _ in made], pa.int64()))
                columns = list(zip(*(t for _, t in made), strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["key", *names])

    return rows.mapInArrow(run, f"key {kind}, {TILE}").withColumnRenamed("key", key)
