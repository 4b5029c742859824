"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links form."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACES, byte_view, chunks, pick, stage

SHINGLE = 5
#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Longest extension of a prefix: shared tokens that may be asked for.
MATCHES = 4
#: What verifying a candidate costs, in postings read.
VERIFY = 8.0
#: Share of the hash range whose tokens are counted over all texts to rule out sets that cannot link to any other. Results
#: do not depend on it: more of the range costs counting, less of it leaves more sets for the join.
COUNTED = 0.33
CHUNK = 1 << 20
#: Sets and tokens of a block in which members of a family are compared.
BLOCK, BLOCK_TOKENS = 256, 500_000

_RANDOM = np.random.default_rng(4711)
BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
BASE = 0x5851F42D4C957F2D
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) and the text it is in."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = ~IS_SPACE[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    inside = offsets[1:-1][offsets[1:-1] < len(data)]
    first[inside] |= inner[inside]
    last = np.empty_like(inner)
    last[:-1] = inner[:-1] & (~inner[1:] | first[1:])
    last[-1] = inner[-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.cumsum(BYTE[data] * up[: len(data)])
        before = np.where(start > 0, total[start - 1], 0).astype(np.uint64)
        h = (total[end] - before) * down[start]
    return _mix(h), np.searchsorted(offsets, start, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their text; a text of fewer words is one shingle."""
    words, text = word_hashes(data, offsets)
    owner, out, n = [], [], len(words)
    per_text = np.bincount(text, minlength=len(offsets) - 1)
    with np.errstate(over="ignore"):
        for k in range(1, size + 1):
            if n < k:
                break
            at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :]) if k == size else np.flatnonzero((per_text[text] == k) & np.concatenate(([True], text[1:] != text[:-1])))
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = (h + words[at + j]) * np.uint64(pow(BASE, 3, 1 << 64) | 1)
                h ^= h >> np.uint64(29)
            out.append(_mix(h))
            owner.append(text[at])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, owner = np.concatenate(out), np.concatenate(owner)
    bits = np.uint64(64 - max(1, len(offsets) - 1).bit_length())
    order = np.argsort(owner.astype(np.uint64) << bits | h >> (np.uint64(64) - bits))  # one key of text and hash
    if not (h[order][1:] >= h[order][:-1])[owner[order][1:] == owner[order][:-1]].all():
        order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], owner[new]


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of texts: first text, end, set sizes, starts of the sets, all hashes."""
    data, offsets = byte_view(column)
    for a, z in chunks(offsets, CHUNK):
        h, owner = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        n = np.bincount(owner, minlength=z - a)
        yield a, z, n, np.cumsum(n) - n, h


def _set_marks(h: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on order."""
    sums = np.zeros(len(n), np.uint64)
    if len(h):
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h ^ np.uint64(BASE)))))
            sums = total[start + n] - total[start]
    return _mix(sums + n.astype(np.uint64)).view(np.int64)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any set it links to."""
    return -(-n * PERCENT // 100)


def _summaries(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, n, set, row, low, tokens) of each text: set size; hash of the set, equal for equal sets; counted tokens.

    tokens are listed once for equal sets of a chunk; low is their number. row numbers the rows; unlike a hash it
    takes few bytes in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, row = np.uint64(int(COUNTED * 2**64)), TaskContext.get().partitionId() << 33
        for b in batches:
            for a, z, n, start, h in _sets(b.column(2)):
                mark = _set_marks(h, n, start)
                once = np.zeros(len(n), bool)
                once[np.unique(mark, return_index=True)[1]] = True
                below = h < edge
                upto = np.concatenate(([0], np.cumsum(below)))
                low = upto[start + n] - upto[start]
                size = np.where(once, low, 0)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(h[below & np.repeat(once, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(n), pa.array(mark), pa.array(np.arange(row, row + z - a)), pa.array(low), tokens], ["doc_id", "tag", "n", "set", "row", "low", "tokens"])
                row += z - a

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tag int, n bigint, set bigint, row bigint, low bigint, tokens array<bigint>")


def _shared_tokens(postings: DataFrame, label: str, counted: bool = True) -> DataFrame:
    """(token, class, and df if counted) of the (token, class) rows whose token another class has too.

    Counts are summed before the shuffle and written, so that the join of a token in very many sets can be split.
    """
    counts = [F.count("*").alias("df")] if counted else []
    often = postings.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), *counts).filter("low <> high").drop("low", "high")
    return postings.join(stage(often, label), "token")


def _can_link(n: str, s: str, n2: str, s2: str) -> str:
    """SQL: whether two sets can be similar enough, given how many tokens of each another set has too."""
    most = f"least({s}, {s2})"
    return f"100 * {most} >= {PERCENT} * ({n} + {n2} - {most})"


def _prefixes(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """Prefix tokens of each class that other classes have too, with the length its candidate cost asks for.

    All sets are in one order, by the number of sets with a token. Tokens that no other class has come first and need
    no row; where they fill the shortest prefix the class cannot link. shared: (class, token, df); sizes: (class, n).
    Returns token, class, n, s (tokens that other classes have too), level (shared tokens from which on the token is
    in the prefix), matches (chosen number of shared tokens).
    """
    grouped = shared.groupBy("class").agg(F.collect_set(F.struct("token", "df")).alias("tokens")).join(sizes, "class").select("class", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, sizes_, at = lists.flatten(), np.diff(lists.offsets.to_numpy()), 0
            token, df = (flat.field(k).to_numpy() for k in ("token", "df"))
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for mark, n, m in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), sizes_, strict=True):
                t, d = token[at : at + m], df[at : at + m]
                at += m
                order = np.lexsort((t, d))
                t, d, place = t[order], d[order], n - m + np.arange(m)
                need = int(least_overlap(n))
                shortest = n - need + 1
                if m < need:
                    continue
                cost = []
                for k in range(1, min(MATCHES, need) + 1):
                    read = float(d[place < shortest + k - 1].sum())
                    cost.append(read + VERIFY * read / k)
                best = int(np.argmin(cost)) + 1
                take = place < shortest + best - 1
                size = int(take.sum())
                level = np.maximum(1, place[take] - shortest + 2)
                for column, value in zip(out, (t[take], np.full(size, mark), np.full(size, n), np.full(size, m), level, np.full(size, best)), strict=True):
                    column.append(value)
            joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in joined], ["token", "class", "n", "s", "level", "matches"])

    return grouped.mapInArrow(run, "token bigint, class bigint, n bigint, s bigint, level bigint, matches bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets (class, tokens ascending) link."""
    both = pairs.join(sets.withColumnsRenamed({"class": "b", "tokens": "y"}), "b").join(sets.withColumnsRenamed({"class": "a", "tokens": "x"}), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, as matrix products over slices of their tokens."""
    tokens = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(t) for t in (*x, *y)])
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    place, row = np.unique(place[keep], return_inverse=True)[1], row[keep]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(x), len(y)), np.float64)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, z = np.searchsorted(place, [first, first + columns])
        m = np.zeros((len(x) + len(y), columns), np.float32)
        m[row[a:z], place[a:z] - first] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return np.rint(out).astype(np.int64)


def _linked_in_families(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different groups of a family. members: class, n, label (group), family.

    The members outside the family's largest group, dealt to blocks by hash, meet blocks of the whole family. A block
    holds some hundreds of sets and about a million tokens, so families of any size are many small tasks. Of a
    member's links to one group only one is kept.
    """
    groups = members.groupBy("family", "label").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    largest = groups.groupBy("family").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.sum("tokens").alias("tokens"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda m, t: F.ceil(F.greatest(m / BLOCK, t / BLOCK_TOKENS)).cast("int")
    plan = largest.join(groups.select("family", F.col("label").alias("_l"), F.col("m").alias("_m"), F.col("tokens").alias("_t")), (F.col("top.label") == F.col("_l")) & (largest["family"] == groups["family"]))
    plan = plan.select(largest["family"], F.col("top.label").alias("main"), blocks(F.col("m"), F.col("tokens")).alias("whole"), F.greatest(blocks(F.col("m") - F.col("_m"), F.col("tokens") - F.col("_t")), F.lit(1)).alias("apart"))
    held = members.join(plan, "family").join(sets, "class")
    deal = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.filter("label <> main").select("family", deal("apart", 1).alias("r"), every("whole").alias("c"), F.lit(0).alias("side"), "class", "label", "tokens")
    right = held.select("family", every("apart").alias("r"), deal("whole", 2).alias("c"), F.lit(1).alias("side"), "class", "label", "tokens")

    def run(t: pa.Table) -> pa.Table:
        side, label = t["side"].to_numpy(), t["label"].to_numpy()
        mark, tokens = t["class"].to_numpy(), t["tokens"].combine_chunks()
        lists = [v.values.to_numpy() for v in tokens]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(x) and len(y):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            common = overlaps([lists[i] for i in x], [lists[i] for i in y])
            i, j = np.nonzero((100 * common >= PERCENT * (n[x][:, None] + n[y] - common)) & (label[x][:, None] != label[y]))
            _, some = np.unique(np.stack((i, label[y[j]])), axis=1, return_index=True)
            a, b = mark[x[i[some]]], mark[y[j[some]]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).groupBy("family", "r", "c").applyInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of (a, b) edges; label is the smallest node of the component.

    Each round takes the smallest label around a node and then that label's own; tables are written between rounds.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")), "graph-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = stage(labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "graph-step")
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        jump = stage(jump, "graph-labels")
        changed = not jump.filter("label <> was").isEmpty()
        labels = jump.select("node", "label")
        if not changed:
            return labels


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that links connect: 5-word shingle sets with a Jaccard similarity of PERCENT % or more.

    1. Texts with equal sets are one class; only classes are joined.
    2. Tokens in the counted hash range are counted over all texts. A class with more tokens of its own than a link
       leaves room for is out; in a usual corpus that is most.
    3. All tokens of the other classes are counted among them. Each class gets a prefix in the common order (rarest
       first), lengthened where the sets behind its tokens make candidates dear; a prefix longer by k - 1 asks for k
       shared tokens.
    4. Candidates are verified in three rounds. First each class meets the class it shares most prefix tokens with
       among those that lead a token (the fewest tokens of their own): a group of copies becomes a star, not all its
       pairs. Classes that share enough prefix tokens with a leader are a family with it; the members that the star
       left apart are then held against their family in blocks, by one matrix product a block, of which only links
       to other groups come out. Last, pairs of different families with enough shared prefix tokens are verified. A
       pair inside a group cannot change it, so no link that matters is lost and no list is capped.

    Words are runs of bytes other than ASCII white space, A-Z as a-z. Null texts and texts without words have no
    shingles and stand alone. Rows with equal id and text are copies. A group with only null ids has a null id.
    Returns doc_id, tag (hash of the text), n (set size), class (of equal sets), component_id (smallest doc_id of the group).
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.hash("text").alias("tag"), "text")
    staged = stage(_summaries(rows), "jaccard-texts")
    texts = staged.drop("tokens")
    common = _shared_tokens(staged.select(F.col("row").alias("class"), F.explode("tokens").alias("token")), "jaccard-counted", counted=False).groupBy("class").agg(F.count("*").alias("s"))
    judged = texts.filter("n > 0").join(common.withColumnRenamed("class", "row"), "row", "left")
    judged = judged.groupBy("set").agg(F.min(F.struct("row", "doc_id", "tag")).alias("p"), F.max("n").alias("n"), F.max("low").alias("low"), F.max(F.coalesce("s", F.lit(0))).alias("s"))
    judged = stage(judged.select("set", F.col("p.row").alias("class"), "p.doc_id", "p.tag", "n", "low", "s"), "jaccard-classes")
    alive = judged.filter(f"low - s <= n - ceil(n * {PERCENT} / 100)")
    alive = stage(alive.select("class", "n", "doc_id", "tag"), "jaccard-alive")
    other = alive.groupBy("doc_id", "tag").agg(F.max("class").alias("class")).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    # a merge join at any size: what is kept grows with the documents, so it is no table to broadcast while it is small
    found = rows.join(other.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("class", "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, n, _, h in _sets(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists], ["class", "tokens"])

    sets = stage(found.mapInArrow(listed, "class bigint, tokens array<bigint>"), "jaccard-sets")
    shared = _shared_tokens(sets.select("class", F.explode("tokens").alias("token")), "jaccard-tokens")
    prefixes = stage(_prefixes(shared, alive.groupBy("class").agg(F.max("n").alias("n"))), "jaccard-prefixes")

    lead = F.struct((F.col("n") - F.col("s")).alias("own"), "n", "class", "s")
    head = prefixes.groupBy("token").agg(F.min(lead).alias("head"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("head.class").alias("b"), F.col("head.n").alias("n2"), F.col("head.s").alias("s2"))
    led = prefixes.join(head, "token").filter((F.col("class") != F.col("b")) & F.expr(_can_link("n", "s", "n2", "s2"))).groupBy(F.col("class").alias("a"), "b").count()
    led = stage(led, "jaccard-led")
    best = led.groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = stage(best, "jaccard-star")

    edges = stage(_verified(first, sets), "jaccard-edges")
    labels = components(edges)

    family = components(led.filter(F.col("count") >= MATCHES).select("a", "b")).select(F.col("node").alias("class"), F.col("label").alias("family"))
    named = prefixes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = stage(named.join(family, "class", "left").withColumn("family", F.coalesce("family", "class")), "jaccard-named")
    inner = stage(_linked_in_families(named.select("class", "n", "label", "family").distinct(), sets), "jaccard-edges")
    if not inner.isEmpty():
        edges = stage(edges.union(inner), "jaccard-edges")
        labels = components(edges)

    mains = named.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "n", "class", "family")).alias("head")).filter("low <> high").select("token", F.col("head.family").alias("main"))
    mains = stage(mains, "jaccard-mixed")
    current = named.drop("label").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    current = stage(current.join(mains, "token"), "jaccard-mixed")
    a, b = current.filter("family <> main").alias("a"), current.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.family") != F.col("b.family")) & (F.col("a.label") != F.col("b.label")) & F.expr(_can_link("a.n", "a.s", "b.n", "b.s")) & F.expr("greatest(a.level, b.level) <= least(a.matches, b.matches)"))
    met = met.select("a.token", F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b"), F.expr("least(a.matches, b.matches)").alias("need"))
    pairs = met.groupBy("a", "b").agg(F.countDistinct("token").alias("k"), F.max("need").alias("need")).filter("k >= need").select("a", "b")
    more = stage(_verified(pairs, sets), "jaccard-edges")
    if not more.isEmpty():
        labels = components(edges.union(more))
    named = judged.select("set", "class").join(labels.withColumnRenamed("node", "class"), "class", "left").select("set", "class", F.coalesce("label", "class").alias("label"))
    joined = texts.select("doc_id", "tag", "n", "set").join(named, "set", "left")
    smallest = joined.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    joined = joined.join(smallest, "label", "left")
    return joined.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each group: the smallest doc_id stays, of equal ids the smallest text hash.

    Texts without words are no group and all stay. Of rows with equal id and text one stays. All columns stay.
    """
    groups = stage(jaccard_groups(docs, id_col, text_col).filter("n > 0"), "jaccard-groups")
    stays = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("class")).alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tag"))).alias("p"))
    stays = stays.select("p.doc_id", "p.tag")
    twice = groups.groupBy("doc_id", "tag").count().filter("count > 1")
    out = groups.select("doc_id", "tag").distinct()
    gone = stage(out.exceptAll(stays), "jaccard-gone")
    key = docs.withColumn("_tag", F.hash(F.col(f"`{text_col}`")))

    def matches(other: DataFrame):
        other = other.select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag"))
        return other, F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_id")) & (F.col("_tag") == F.col("_gone_tag"))

    other, condition = matches(gone)
    kept = key.join(other.hint("merge"), condition, "left_anti")
    if not twice.isEmpty():
        other, condition = matches(twice)
        kept = kept.join(other, condition, "left_anti").unionByName(kept.join(other, condition, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.drop("_tag")
