"""Names and brands as comparable text: Column -> Column, all inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters of western European languages and their base letters, in the same order.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüñçýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
#: A size, or a multipack's, and the words of packing, as a name states them.
SIZE_TOKEN = r"\b\d+(?:[.,]\d+)?\s*(?:x\s*\d+(?:[.,]\d+)?\s*)?(?:kg|g|gr|grs|l|lt|ml|cl)\b"
PACK_TOKEN = r"\b(?:pack|emb|embalagem|un|uni|unidades?)\b\.?"


#: Where a word of ASCII letters, digits and underscores begins or ends. Java's \\b counts every letter of Unicode.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is found: word edges (\\b) by ASCII letters only, and a dot is anything but a line feed.

    The letters of plain text that have no base letter (as in "undß") are no part of a word, as in patterns of RE2.
    """
    return F.rlike(text, F.lit(ascii_pattern(pattern)))


def ascii_patterns(pattern: Column | str) -> Column:
    """A column of patterns for rlike(), as matches() has them; made once in the table that holds them, not once a row."""
    return F.concat(F.lit("(?d)"), F.replace(pattern, F.lit(r"\b"), F.lit(EDGE)))


#: A word edge (or another escape, which stays) and what it begins, where that shows: a digit, a letter, or words to choose from.
_BEGINS = re.compile(r"\\[^b]|\\b(?=(?:(?P<one>\\d|[0-9A-Za-z_])|\((?:\?:)?(?P<words>(?:[0-9A-Za-z_]{2,}\??\|)*[0-9A-Za-z_]{2,}\??)\))(?![?*{]))|\\b", re.ASCII)


def ascii_pattern(pattern: str) -> str:
    return "(?d)" + _BEGINS.sub(_edge, pattern)


def _edge(m: re.Match) -> str:
    """An edge; the letters that may follow it are looked for first, as most places of a text have none of them."""
    if m[0] != r"\b":
        return m[0]
    first = m["one"] or "".join(sorted({w[0] for w in (m["words"] or "").split("|") if w}))
    return rf"(?=[{first}])(?<![0-9A-Za-z_])" if first else EDGE


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def plain(text: Column) -> Column:
    """Accent-free and lower-case; the form in which names are compared."""
    return F.lower(strip_accents(text))


def fold_plural(token: Column) -> Column:
    """Portuguese plural endings to the singular; a plain s falls from words of four letters or more."""
    n = F.length(token)
    cut = lambda k, end: F.concat(F.substring(token, F.lit(1), n - k), F.lit(end))
    return (
        F.when(token.endswith("oes") & (n >= 5), cut(3, "ao")).when(token.endswith("aes") & (n >= 4), cut(3, "ao")).when(token.endswith("ais") & (n >= 5), cut(3, "al")).when(token.endswith("s") & (n >= 4), cut(1, "")).otherwise(token)
    )


def normalize_brand(brand: Column) -> Column:
    """Letters and digits only; null stays null."""
    return F.regexp_replace(plain(brand), "[^a-z0-9]", "")


def normalize_name(name: Column) -> Column:
    """Without sizes, pack words and punctuation, single spaces."""
    text = F.regexp_replace(plain(name), ascii_pattern(SIZE_TOKEN), " ")
    text = F.regexp_replace(text, ascii_pattern(PACK_TOKEN), " ")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def name_tokens(name: Column) -> Column:
    """Distinct words of two letters or more, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(normalize_name(name), " "), lambda t: F.length(t) > 1))


def product_tokens(name: Column, house_labels: Column | None = None) -> Column:
    """Plural-folded name tokens without a store's own labels."""
    tokens = F.transform(name_tokens(name), fold_plural)
    return F.array_distinct(F.array_except(tokens, house_labels) if house_labels is not None else tokens)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def matches_term(tokens: Column, term: Column) -> Column:
    """Whether all plural-folded words of a search term are among the tokens."""
    return F.size(F.array_except(product_tokens(term), tokens)) == 0


def stem(word: Column) -> Column:
    """Final s, then final o or a, dropped; for comparing words of group names."""
    return F.regexp_replace(F.regexp_replace(plain(word), "s$", ""), "[oa]$", "")


def is_house_brand(brand: Column, labels: list[str]) -> Column:
    """Empty, or begins with one of the store's labels."""
    b = normalize_brand(F.coalesce(brand, F.lit("")))
    return F.coalesce((b == "") | F.exists(F.array(*(F.lit(x) for x in labels)), b.startswith), F.lit(False)) if labels else b == ""


def qualifier_mismatch(a: Column, b: Column, qualifiers: list[tuple[str, str]]) -> Column:
    """The first of the ordered (name, pattern) qualifiers that exactly one of two names has; null if none."""
    found = [F.when(plain(a).rlike(p) != plain(b).rlike(p), F.lit(n)) for n, p in qualifiers]
    return F.coalesce(*found)


def clean_comment(text: Column, most: int = 500) -> Column:
    """Control characters as spaces, trimmed, at most so many characters; null if nothing is left."""
    out = F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " ")), 1, most)
    return F.when(out == "", None).otherwise(out)


def visitor_key(address: Column, day: Column) -> Column:
    """A day's pseudonym of an address."""
    return F.sha2(F.concat_ws("|", address, day.cast("string")), 256)


def section_key(name: Column) -> Column:
    """A section's name as a key: plain, words joined by hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(plain(name), "[^a-z0-9]+", " ")), " +", "-")


def path_keys(path: Column, separator: str = ">") -> Column:
    """Keys of a category path's levels, empty levels dropped."""
    return F.filter(F.transform(F.split(path, separator), section_key), lambda k: k != "")


def slug(*parts: Column) -> Column:
    """Parts joined by ~, nulls left out."""
    return F.concat_ws("~", *parts)
