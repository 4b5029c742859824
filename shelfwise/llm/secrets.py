"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_RUN, held_out, pick, sliced

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Candidates of the models: runs of key characters of at least this length. Shorter ones carry too little evidence.
#: Plain numbers are none.
CANDIDATE = re.compile(r"(?![0-9]+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}")
#: The training sample of ordinary words: of so many documents, so many words each.
SAMPLE_DOCS = 2000
SAMPLE_WORDS = 60
#: Longest word that is collected of the sample.
WORD_CHARS = 200
#: Weight of a shorter context in the chains, in characters seen; share of labelled ordinary identifiers that may score
#: above the thresholds; least log-likelihood ratio per character; and what is added to a threshold.
MIXING = 100
FALSE_ALARMS = 0.001
LEAST_RATIO = 0.8
MARGIN = 0.2
#: Thresholds are taken by length: from each of these on.
LENGTHS = (16, 20, 28)

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
INDEX = {c: i for i, c in enumerate(ALPHABET)}
#: Words from which ordinary identifiers are made for training.
ORDINARY = """account action active address admin agent alpha amount apple archive article asset author average backup balance
base batch block board branch bridge buffer build button cache call camera channel chapter check child class client clock
cloud code collection color column command comment common config connection content context control copy count country create
current custom data date default delete delivery design detail device direct display document domain download draft driver edit
element email empty enable engine entry error event example export factor feature field file filter final first folder format
forward frame function garden general global group handler header height history home image import index input instance
interface internal invoice item join journal kernel label language large layer layout length level library license limit link
list local location logger machine manager map market master match member memory message method minute mobile model module
month mother name native network node normal notice number object office option order output owner package page parent part
partition password path pattern payment people picture point policy position price primary private process product profile
project property public quality query queue random range record region release remote report request resource response result
return river road root route sample school score screen search section select sender sequence server service session setting
shadow share signal simple single size source space special stage standard start state station status storage store stream
street string student style subject summer support switch system table target task template test text thread time title total
track train transfer tree type union unit update upload user value vector vendor version video view volume water window winter
work worker world write year""".split()


#: Kinds of random strings, by the characters that they draw from.
POOLS = {
    "hex": "0123456789abcdef", "base62": ALPHABET[:62], "base64": ALPHABET[:64], "upper and digits": ALPHABET[26:62], "lower and digits": ALPHABET[:26] + ALPHABET[52:62], "letters": ALPHABET[:52], "lower": ALPHABET[:26], "upper": ALPHABET[26:52],
}


def labelled_samples(seed: int = 11, n: int = 40000, words: tuple[str, ...] = ()) -> tuple[dict[str, list[str]], list[str]]:
    """Random strings by kind, n together, and n ordinary identifiers: words in the usual spellings and runs of words.
    With words of a corpus, half of the identifiers are made of those."""
    rng = random.Random(seed)
    positive = {kind: ["".join(rng.choices(pool, k=rng.randint(16, 64))) for _ in range(n // len(POOLS))] for kind, pool in POOLS.items()}
    negative = []
    for i in range(n):
        # as many words as reach a length, so that all lengths have their share; one long word may do
        vocabulary, length, some = words if words and i % 2 else ORDINARY, rng.randint(8, 56), []
        while sum(map(len, some)) < length:
            some.append(rng.choice(vocabulary))
        style, number = rng.randrange(6), str(rng.choice((rng.randrange(10), rng.randrange(1000), rng.randint(1990, 2040), rng.randrange(10**6))))
        word = "_".join(some) if style == 0 else "-".join(some) if style == 1 else "/".join(some) if style == 2 else "".join(w.title() for w in some) if style == 3 else "_".join(some).upper() if style == 4 else rng.choice(("".join(some), "".join(some).upper()))
        sep = rng.choice(("", "_", "-", "/"))
        negative.append(rng.choice((word + sep + number, number + sep + word, word, word, word + sep + number + sep + rng.choice(ORDINARY))))
    mixed = [s for s in negative if len(s) >= 8]
    rng.shuffle(mixed)  # halves of it are alike
    return positive, mixed


def _codes(s: str) -> np.ndarray:
    codes = np.fromiter((INDEX.get(c, -1) for c in s), np.int64, len(s))
    return codes[codes >= 0]


def _markov(samples: list[str], order: int) -> np.ndarray:
    """Log-probabilities of a character after the one or two before it, mixed with those of shorter contexts; the last
    code is the start."""
    k = len(ALPHABET)
    counts = np.zeros((k + 1, k + 1, k))
    for s in samples:
        c = np.concatenate(([k, k], _codes(s)))
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    pairs = counts.sum(axis=0)
    two = (pairs + MIXING * one) / (pairs.sum(axis=1, keepdims=True) + MIXING)
    if order == 1:
        return np.log(two).astype(np.float32)
    return np.log((counts + MIXING * two[None]) / (counts.sum(axis=2, keepdims=True) + MIXING)).astype(np.float32)


class RandomnessModel:
    """A chain for each kind of random strings against one of ordinary identifiers, and the thresholds that labelled samples ask for.

    A string is held against the kind that explains it best. Each kind and length has a threshold of its own, so that
    what few identifiers look like (hexadecimal) need not pass what other kinds must. Half of the identifiers train the
    chain, the other half gives the thresholds.
    """

    def __init__(self, positive: dict[str, list[str]], negative: list[str], false_alarms: float = FALSE_ALARMS):
        self.random = np.stack([_markov(samples, 1) for samples in positive.values()])
        self.ordinary = _markov(negative[::2], 2)
        held = [(len(s), *self.ratio(s)) for s in negative[1::2] if CANDIDATE.fullmatch(s)]
        self.thresholds = np.full((len(LENGTHS), len(positive)), LEAST_RATIO)
        for i, (least, most) in enumerate(zip(LENGTHS, (*LENGTHS[1:], float("inf")), strict=True)):
            alike = [(kind, ratio) for length, kind, ratio in held if least <= length < most]
            allowed = int(false_alarms * len(alike) / len(positive))
            for k in range(len(positive)):
                scores = sorted((ratio for kind, ratio in alike if kind == k), reverse=True)
                if len(scores) > allowed:
                    self.thresholds[i, k] = max(LEAST_RATIO, scores[allowed] + MARGIN)

    def ratio(self, s: str) -> tuple[int, float]:
        """The kind of random strings that fits best, and the mean log-likelihood ratio of the string's characters."""
        c = np.concatenate(([len(ALPHABET)] * 2, _codes(s)))
        if len(c) == 2:
            return 0, -np.inf
        fits = self.random[:, c[1:-1], c[2:]].sum(axis=1)
        k = int(fits.argmax())
        return k, float(fits[k] - self.ordinary[c[:-2], c[1:-1], c[2:]].sum()) / (len(c) - 2)

    def __call__(self, s: str) -> bool:
        k, ratio = self.ratio(s)
        return ratio > self.thresholds[max(0, bisect_right(LENGTHS, len(s)) - 1), k]


@lru_cache(1)
def default_model() -> RandomnessModel:
    return RandomnessModel(*labelled_samples())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> RandomnessModel:
    """The model with words of the corpus among its ordinary identifiers: sample_words consecutive words of each of the
    sample_docs documents that come first in hash order, none of them held out. Words that a pattern finds or that hold
    a digit are left out, and so are long ones that only one of the documents has. An empty corpus gives the default model."""
    rows = pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    words = F.split("text", SPACE_RUN)
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("words") - sample_words, F.lit(0)) + 1) + 1
    chosen = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id").distinct().orderBy("h", "doc_id").limit(sample_docs)
    drawn = rows.join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", words.alias("words")).select(F.transform(F.slice("words", at.cast("int"), sample_words), lambda w: F.left(w, F.lit(WORD_CHARS))).alias("words"))
    # an id may have several rows: as many as ids are enough, in an order of their own
    got = drawn.orderBy(F.xxhash64("words"), "words").limit(sample_docs).collect()
    parts = [{p for w in r.words for p in re.findall(r"[A-Za-z]+", w) if 3 <= len(p) <= 40 and not re.search("[0-9]", w)} for r in got]
    seen = Counter(p for some in parts for p in some)
    plain = {p for p, n in seen.items() if n > 1 or len(p) < LENGTHS[0]}  # a long one in one document only may be a key
    return RandomnessModel(*labelled_samples(words=tuple(sorted(plain)))) if plain else default_model()


def spans(text: str, model: RandomnessModel) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, sorted. Spans of the models leave the patterns' spans alone."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = [(m.start(), m.end()) for m in LONG_RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    base = list(found)
    for a, b in runs:
        for m in CANDIDATE.finditer(text, a, b):
            if not any(s < m.end() and m.start() < e for s, _, e in base) and model(m[0]):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomnessModel | None = None) -> DataFrame:
    """Every document's secret spans (kind, start, end in code points, end exclusive) over its whole text.

    Fixed patterns give assignments, access keys and hexadecimal strings, leftmost and non-overlapping within a
    kind. A run of key characters that no pattern touches is a secret where the chain of random strings explains it
    better than that of ordinary identifiers, by more than labelled ordinary identifiers held out of training.
    Null text: empty, no spans. Repeated rows give repeated rows; ids of any value and null ids stay as they are; other
    columns are ignored; empty table: empty. A text of any length is scanned as a whole.
    """
    model = model or default_model()
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t, model) if t else [] for part in sliced(b.column(1)) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], kind_of)], ["doc_id", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", model: RandomnessModel | None = None) -> DataFrame:
    """The documents with every secret replaced by the mask (of an assignment only its value); null stays null.

    All columns and rows are kept as they are otherwise; n_chars, where there is one, follows the new text.
    """
    model = model or default_model()

    def clean(text: str) -> str:
        out, at = [], 0
        for start, kind, end in spans(text, model):
            if kind == 0:
                start = ASSIGN.match(text, start).start(2)
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mask]
            at = end
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else clean(t) for t in part.to_pylist()], pa.string()) for part in sliced(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))
    return out.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns and text_col != "n_chars" else out


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the patterns' spans and the list of all spans, of scan_secrets() rows."""
    show = lambda kept: F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"), count("random").alias("n_random"))


def sha256_hex(text: str) -> str:
    """As secret_digests() writes it; for tests."""
    return hashlib.sha256(text.encode()).hexdigest()
