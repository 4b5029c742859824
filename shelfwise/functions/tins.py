"""The two weights of a tin, with its liquid and drained, as names and labels of stores state them (in kg)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.measures import bound, same_weight
from shelfwise.functions.text import plain

# How names and labels write two weights. Names are plain (no accents, lower case) when they are read.
NO_LIQUID = r"^\s*(tomate frito|molho|polpa|passata|ketchup)\b"
AFTER_BRACKET = r"(?:(\d+)\s*[x×]\s*)?(\d+(?:[.,]\d+)?)\s*\(\s*(\d+(?:[.,]\d+)?)\s*(?:kg|gr?s?|g)?\s*\)\s*(kg|gr?s?|g)\b"
BEFORE_WEIGHT = r"\(\s*(\d{2,}(?:[.,]\d+)?)\s*(?:kg|gr?s?|g)?\s*\)\s*(\d+(?:[.,]\d+)?)\s*(kg|gr?s?|g)\b"
BOTH_UNITS = r"(\d+(?:[.,]\d+)?)\s*(kg|grs?|gr|g)\s*\(\s*(\d+(?:[.,]\d+)?)\s*(kg|grs?|gr|g)\s*\)"
PACK_LABEL = r"emb\.\s*(?:(\d+)\s*[x×]\s*)?([\d,]+)\s*(kg|gr|g)\b"
NET_LABEL = r"peso escorri[dg]o\s*:?\s*(?:(\d+)\s*[x×]\s*)?([\d,]+)\s*(kg|gr|g)\b"
DRAINED_BLOCK = r"^([\d.,]+)\s*(kg|quilogramas?|gramas?|gr|g)?\b"
SIZE_LINE = r"^(?:(\d+)\s*[x×]\s*)?([\d.,]+)\s*(kg|g|gr)\b"
#: Least drained weight of a tin, and how much larger than it a full weight must be.
LEAST = 0.005
CLEARLY = 1.03

WEIGHTS = "struct<full: double, drained: double>"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _count(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(1.0))


def _kg(amount: Column, unit: Column) -> Column:
    """Grams unless the unit begins with k or is a word for kilograms."""
    return F.when(unit.rlike("^(k|quilo)"), amount).otherwise(amount / 1000)


def _pair(full: Column, drained: Column) -> Column:
    return F.struct(F.round(full, 4).alias("full"), F.round(drained, 4).alias("drained"))


def name_weights(name: Column) -> Column:
    """struct<full, drained> of a name that gives both ("840 (480)g", "(85)120g", "115g (72g)", "3x75(65)g"); else null.

    The larger is the full weight. A bracket larger than what stands before it, each with its own unit, is a pack's
    total and no pair; what has no liquid (sauce, pulp) has no drained weight.
    """

    def read(flat: Column) -> Column:
        at = lambda pattern, i: F.regexp_extract(flat, pattern, i)
        made = lambda n, a, b, unit: F.struct(n.alias("n"), _number(a).alias("a"), _number(b).alias("b"), unit.alias("unit"))
        both = made(F.lit(1.0), at(BOTH_UNITS, 1), at(BOTH_UNITS, 3), at(BOTH_UNITS, 2))
        alike = at(BOTH_UNITS, 2).startswith("k") == at(BOTH_UNITS, 4).startswith("k")
        return (
            F.when(flat.rlike(NO_LIQUID), F.lit(None))
            .when(flat.rlike(AFTER_BRACKET), made(_count(at(AFTER_BRACKET, 1)), at(AFTER_BRACKET, 2), at(AFTER_BRACKET, 3), at(AFTER_BRACKET, 4)))
            .when(flat.rlike(BEFORE_WEIGHT), made(F.lit(1.0), at(BEFORE_WEIGHT, 1), at(BEFORE_WEIGHT, 2), at(BEFORE_WEIGHT, 3)))
            .when(flat.rlike(BOTH_UNITS) & alike & (_number(at(BOTH_UNITS, 3)) < _number(at(BOTH_UNITS, 1))), both)
        )

    def weigh(p: Column) -> Column:
        full, drained = (p["n"] * _kg(f(p["a"], p["b"]), p["unit"]) for f in (F.greatest, F.least))
        return F.when((drained > 0) & (drained < full), _pair(full, drained))

    return bound(bound(plain(name), read), weigh)


def label_weights(label: Column) -> Column:
    """struct<full, drained> of a label that gives pack and drained weight ("emb. 3 x 150 gr (peso escorrido 3 x 140 gr)").

    A drained weight without a number of packs has the pack's. Null unless both are there and the drained one is no larger.
    """

    def read(text: Column) -> Column:
        at = lambda pattern, i: F.regexp_extract(text, pattern, i)
        found = F.struct(_count(at(PACK_LABEL, 1)).alias("count"), _kg(_number(at(PACK_LABEL, 2)), at(PACK_LABEL, 3)).alias("full"), at(NET_LABEL, 1).try_cast("double").alias("net_count"), _kg(_number(at(NET_LABEL, 2)), at(NET_LABEL, 3)).alias("net"))
        return bound(found, lambda f: F.struct((f["count"] * f["full"]).alias("full"), (F.coalesce(f["net_count"], f["count"]) * f["net"]).alias("drained")))

    def weigh(p: Column) -> Column:
        full, drained = p["full"], p["drained"]
        return F.when((full > 0) & (drained > 0) & (drained <= full * 1.001), _pair(full, drained))

    return bound(bound(F.lower(label), read), weigh)


def _drained_in(block: Column) -> Column:
    at = lambda i: F.regexp_extract(block, DRAINED_BLOCK, i)
    return bound(_kg(_number(at(1)), at(2)), lambda weight: F.when(weight >= LEAST, weight))


def block_weights(size_line: Column, drained_block: Column) -> Column:
    """struct<full, drained> of a page with a block for the drained weight ("210 g", "250.0 Grama", "720"), null without one.

    The size line is the full weight only where it is clearly larger. The block of a pack states one tin where the line
    does so too.
    """

    def read(p: Column) -> Column:
        at = lambda i: F.regexp_extract(p["line"], SIZE_LINE, i)
        return F.struct(_count(at(1)).alias("count"), _kg(_number(at(2)), at(3)).alias("line"), p["each"].alias("each"))

    def weigh(p: Column) -> Column:
        count, each = p["count"], p["each"]
        total = count * p["line"]
        drained = F.when((count > 1) & F.coalesce(each * count <= total * CLEARLY, F.lit(False)), each * count).otherwise(each)
        return F.when(each.isNotNull(), _pair(F.when(total >= drained * CLEARLY, total), drained))

    each = _drained_in(F.lower(F.trim(drained_block)))
    return bound(bound(F.struct(F.lower(F.trim(F.coalesce(size_line, F.lit("")))).alias("line"), each.alias("each")), read), weigh)


def listed_weights(named: Column, drained_text: Column) -> Column:
    """struct<full, drained> of a page that lists the drained weight; the full one is the name's where clearly larger.

    named: parse_size() of the name.
    """
    in_kg = bound(named, lambda n: F.when(n["unit"] == "kg", n["total"]))
    return bound(
        F.struct(_drained_in(F.lower(F.trim(drained_text))).alias("drained"), in_kg.alias("named")),
        lambda p: F.when(p["drained"].isNotNull(), _pair(F.when(p["named"] >= p["drained"] * CLEARLY, p["named"]), p["drained"])),
    )


def placed(full: Column, drained: Column, size: Column, donor_full: Column, donor_drained: Column) -> Column:
    """struct<full, drained>: a missing weight placed from a donor that labels both; null where that settles nothing.

    What is known must equal one of the donor's (same_weight()), the other is then the missing one. Without any labelled
    weight the size shown must equal exactly one of the donor's, or both where these are the same.
    """
    made = lambda f, d: F.struct(f.cast("double").alias("full"), d.cast("double").alias("drained"))
    like_full, like_drained = same_weight(size, donor_full), same_weight(size, donor_drained)
    by_size = F.when(same_weight(donor_full, donor_drained), F.when(like_full, made(size, size))).when(like_drained & ~like_full, made(donor_full, size)).when(like_full & ~like_drained, made(size, donor_drained))
    one = F.when(drained.isNotNull(), F.when(same_weight(drained, donor_drained), made(donor_full, drained))).when(full.isNotNull(), F.when(same_weight(full, donor_full), made(full, donor_drained)))
    return F.when(full.isNotNull() & drained.isNotNull(), None).when(full.isNotNull() | drained.isNotNull(), one).otherwise(by_size)


def weight_note(basis: Column, source: Column, store_label: Column) -> Column:
    """What is said of a weight that is not from the product's own page or name; null for those. source: how[:store]."""
    what = F.when(basis == "drained", "Peso escorrido").otherwise("Peso total")
    how = F.substring_index(source, ":", 1)
    # The notes' wording.
    return (
        F.when(how == "barcode", F.concat(what, F.lit(" do rótulo do mesmo produto (mesmo código de barras) no "), store_label, F.lit("; a loja não o indica.")))
        .when(how == "same-product", F.concat(what, F.lit(" do rótulo do mesmo produto no "), store_label, F.lit("; a loja não o indica.")))
        .when(how == "reviewed", F.concat(what, F.lit(" estimado por nós e verificado; a loja não o indica.")))
    )
