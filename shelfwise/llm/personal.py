"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import pick


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes spans, what every text with one holds, and its score.

    Patterns take runs possessively, and start only where a run starts, so that a long run is read once.
    A kind that is not fixed reports only spans whose score, with the words nearby, reaches THRESHOLD.
    """

    name: str
    pattern: str
    hint: str
    score: float
    words: str
    fixed: bool = True


#: Code points on either side of a span in which context words count, what they add, and the score that is reported.
CONTEXT = 40
BOOST = 0.4
THRESHOLD = 0.6
#: Positions are running sums over the matches of a text, taken in blocks so that a text of n matches copies n * BLOCK sums.
BLOCK = 256

# The patterns of the kinds, their hints, scores and context words (English, French, German, Spanish).
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6, "e-?mail|mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.4, "ip|address|host|server|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.6, "card|credit|visa|mastercard|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "tel|phone|call|fax|mobile|telefon|telefono|appel"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z][0-9]", 0.8, "iban|account|konto|compte|cuenta|bank", False),
    Kind("line", r"\(?0[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}", "0[0-9]", 0.3, "tel|phone|call|fax|mobile|telefon|telefono", False),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def share(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + share(i)) % 10 == 0


def mod_97(number: Column) -> Column:
    """Whether an account number (A-Z and digits, no spaces) passes the check of ISO 13616."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(c <= "9", rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _in_byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def confirmed(kind: str, found: Column) -> Column:
    """Whether a proposed span of that kind passes its check."""
    digits = _digits(found)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), _in_byte)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        number = F.replace(found, F.lit(" "), F.lit(""))
        return F.when(F.length(number).between(15, 34), mod_97(number)).otherwise(False)
    if kind == "line":
        return F.length(digits).between(8, 13)
    return F.lit(True)


def _running(steps: str) -> tuple[Column, Column]:
    """Sums of an array's blocks, and (from those, as column sums) the sum of what comes before each element."""
    starts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
    add = lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x))
    sums = F.transform(starts, lambda a: F.aggregate(F.slice(steps, a, BLOCK), F.lit(0).cast("long"), lambda total, x: total + x))
    offsets = F.aggregate(f"{steps}_sums", F.array(F.lit(0).cast("long")), add)
    inner = F.zip_with(starts, F.slice(offsets, 1, F.size(f"{steps}_sums")), lambda a, o: F.slice(F.aggregate(F.slice(steps, a, BLOCK), F.array(o), add), F.lit(1), F.least(F.lit(BLOCK), F.size(steps) - a + 1)))
    return sums, F.flatten(inner)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's spans of personal data over its whole text, by kind in the order of KINDS, then start.

    A pattern's matches are leftmost and do not overlap; those that fail their check (Luhn, mod 97, parts of an address,
    number of digits) are dropped. A span scores its kind's score, more by BOOST (1 at most) where one of the kind's
    words is within CONTEXT code points on its side of the neighbouring matches. The first four kinds are reported at
    any score, the others from THRESHOLD on: account numbers, and national telephone numbers with a word for them.
    The text between two matches gives a match its place, so nothing is searched twice and nothing is shuffled.

    Null text: empty, no spans. Repeated rows give repeated rows; null ids stay; other columns are ignored; empty table:
    empty.
    Returns doc_id, spans (array of kind, start, end in code points with end exclusive, score).
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")
    found = []
    for k in KINDS:
        here = F.col("text").rlike(k.hint) if len(k.hint) > 1 else F.contains("text", F.lit(k.hint))
        found += [
            F.when(here, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(empty).alias(f"{k.name}_hits"),
            F.when(here, F.split("text", k.pattern, -1)).otherwise(empty).alias(f"{k.name}_gaps"),
        ]
    rows = rows.select("doc_id", *found)
    names = [k.name for k in KINDS]
    kept = ["doc_id", *(f"{k}_{x}" for k in names for x in ("hits", "gaps"))]
    any_hits = {k: F.size(f"{k}_hits") > 0 for k in names}
    longs = F.array().cast("array<bigint>")
    steps = [F.when(any_hits[k], F.zip_with(f"{k}_hits", F.slice(f"{k}_gaps", 1, F.size(f"{k}_hits")), lambda h, g: (F.length(h) + F.length(g)).cast("long"))).otherwise(longs).alias(f"{k}_steps") for k in names]
    rows = rows.select(*kept, *steps)
    kept += [f"{k}_steps" for k in names]
    rows = rows.select(*kept, *(F.when(any_hits[k], _running(f"{k}_steps")[0]).otherwise(longs).alias(f"{k}_steps_sums") for k in names))
    return rows.select("doc_id", F.concat(*(_spans(k) for k in KINDS)).alias("spans"))


def _spans(kind: Kind) -> Column:
    """The reported spans of a kind, from the columns that personal_data() made."""
    hits, gaps, n = f"{kind.name}_hits", f"{kind.name}_gaps", F.size(f"{kind.name}_hits")
    places = F.arrays_zip(F.col(hits).alias("hit"), F.slice(gaps, 1, n).alias("left"), F.slice(gaps, 2, n).alias("right"), _running(f"{kind.name}_steps")[1].alias("at"))
    word = f"(?i)(?<![A-Za-z])(?:{kind.words})(?![A-Za-z])"

    def span(p: Column) -> Column:
        left, right = F.right(p["left"], F.lit(CONTEXT)), F.left(p["right"], F.lit(CONTEXT))
        near = left.rlike(word) | right.rlike(word)
        start = p["at"] + F.length(p["left"])
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0))
        fits = confirmed(kind.name, p["hit"])
        if kind.name == "line":  # the rest of a longer number
            fits = fits & ~left.rlike(r"[+0-9][\x20().-]*$") & ~right.rlike("^[0-9]")
        return F.when(fits, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(p["hit"])).alias("end"), score.alias("score")))

    made = F.filter(F.transform(places, span), lambda s: s.isNotNull() & (F.lit(kind.fixed) | (s["score"] >= THRESHOLD)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<kind: string, start: bigint, end: bigint, score: double>>"))


def personal_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the fixed kinds' spans and the list of all spans, of personal_data() rows."""
    fixed = [k.name for k in KINDS if k.fixed]
    show = lambda kept: F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in fixed), F.sha2(show(F.filter("spans", lambda s: s["kind"].isin(fixed))), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))
