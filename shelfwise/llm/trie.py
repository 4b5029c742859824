"""Conversation prefix trie: burst tries hold suffix containers under heads, and containers are swept into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import pick, stage

#: Turns below a head that one container may hold; a container beyond it is burst, unless it holds one sequence.
CONTAINER = 20_000
#: Conversation ids whose digits are joined before they meet the others of their sequence.
JOINED = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn: equal for equal role and text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def rebuilt_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share openings: the first h turns of c - c % group, then c's own after its first h.

    h is crc32 of c's digits modulo most. A conversation's turns are ordered by turn (null first), equal ones by their
    id. Null role and text are empty. Rows without a conversation id belong to no conversation and are left out. A
    conversation is one row of about 40 bytes a turn; its texts are not moved.
    Returns conv_id, ids (a turn id each), chars (code points of each turn's text).
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_id(role, text).alias("id"), F.length(text).alias("chars")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    own = stage(own.select("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("own")), "trie-conversations")
    heads = own.select(F.col("conv_id").alias("head_id"), F.slice("own", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left")
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    joined = joined.select("conv_id", F.concat(opening, F.slice("own", F.col("h") + 1, F.size("own"))).alias("all"))
    return joined.select("conv_id", F.transform("all", lambda t: t["id"]).alias("ids"), F.transform("all", lambda t: t["chars"]).alias("chars"))


def _streamed_digest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """sha256 of the comma-joined values of each key in order; a task streams its sorted rows and holds one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(v.encode())
                else:
                    state.update(b"," + v.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["key", "ends"])
            out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends"])

    ordered = rows.select(key, value, order).repartition(key).sortWithinPartitions(key, order)
    return ordered.select(key, value).mapInArrow(run, "key string, ends string")


def sequences(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns: copies are counted, not carried further.

    Ids of the conversations that are that sequence are joined in ranges of JOINED ids first, then streamed in order
    through one digest, so that a sequence with a large share of all conversations is never one value.
    Returns key, ids, chars, n, first (smallest conversation id), ends (digest of all of them).
    """
    keyed = stage(conversations.withColumn("key", F.md5(F.array_join("ids", ""))), "trie-rebuilt")
    distinct = keyed.groupBy("key", "ids", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    part = F.floor(F.col("conv_id") / JOINED).alias("part")
    joined = keyed.groupBy("key", part).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("value"))
    return distinct.join(_streamed_digest(joined, "key", "part", "value"), "key")


def _head(at: Column) -> Column:
    return F.md5(F.array_join(F.slice("ids", F.lit(1), at), ""))


def containers(items: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """Sequences dealt to containers: all of a container begin with the turns of its head, and are swept together.

    Shards start under the heads that the first turns make. A container with several sequences and more than limit
    turns below its head is burst: its sequences move under heads one turn further down, those of a container that is
    still too large two, then four and so on, so that rounds grow with the logarithm of the longest shared opening.
    As sequences differ, every container ends within the limit or with one sequence. Adds at (the head's depth), head.
    """
    moved = items.withColumn("at", F.least(F.lit(1), F.size("ids"))).withColumn("head", _head(F.col("at")))
    settled, jump = None, 1
    while True:
        sizes = moved.groupBy("head").agg((F.sum(F.size("ids") - F.col("at")) > limit).alias("large"), (F.count("*") > 1).alias("several"))
        marked = stage(moved.join(sizes, "head").withColumn("burst", F.col("large") & F.col("several")).drop("large", "several"), "trie-containers")
        done = marked.filter("not burst").drop("burst")
        settled = done if settled is None else settled.unionByName(done)
        rest = marked.filter("burst").drop("burst")
        if rest.isEmpty():
            return settled
        moved = rest.withColumn("at", F.least(F.col("at") + jump, F.size("ids"))).withColumn("head", _head(F.col("at")))
        jump *= 2


def _sweep(head: str, at: int, items: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(nodes below the head, the nodes from the root to the head with this container's part of them).

    Items are (ids, chars, n, first, ends) in the order of their ids. The stack holds the open nodes from the head
    down; a node closes, and adds itself to the one above, where an item no longer shares it.
    """
    # an open node: depth, chars of its turn, n, first, children, leaves, saved, ends, rows that wait for its first
    stack = [[at, 0, 0, None, 0, 0, 0, None, []]]
    nodes: list[tuple] = []

    def close() -> None:
        depth, chars, n, first, children, leaves, saved, ends, waiting = stack.pop()
        up = stack[-1]
        leaves, saved = leaves or 1, saved + (n - 1) * chars
        nodes.extend((x[0], x[1], first, *x[2:]) for x in waiting)
        up[2] += n
        up[3] = first if up[3] is None else min(up[3], first)
        up[4] += 1
        up[5] += leaves
        up[6] += saved
        up[8].append((first, depth, n, children, leaves, saved, ends or NO_ENDS))

    before: list = []
    for ids, chars, n, first, ends in items:
        shared = at
        while shared < len(before) and shared < len(ids) and before[shared] == ids[shared]:
            shared += 1
        while stack[-1][0] > shared:
            close()
        for d in range(shared, len(ids)):
            stack.append([d + 1, chars[d], 0, None, 0, 0, 0, None, []])
        top = stack[-1]
        top[2] += n
        top[3] = first if top[3] is None else min(top[3], first)
        top[7] = ends
        before = ids
    while len(stack) > 1:
        close()
    _, _, n, first, children, leaves, saved, ends, waiting = stack[0]
    nodes.extend((x[0], x[1], first, *x[2:]) for x in waiting)
    ids, chars = items[0][0], items[0][1]
    path, digest, up = [], hashlib.md5(), None
    for d in range(at + 1):
        if d:
            digest.update(ids[d - 1].encode())
        key = digest.copy().hexdigest()
        last = d == at
        path.append((head, key, up, d, chars[d - 1] if d else 0, n, first, children if last else 0, leaves, saved, ends if last else None))
        up = key
    return nodes, path


_NODE_NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_PATH_NAMES = ["head", "key", "up", "level", "chars", "n", "first", "children", "leaves", "saved", "ends"]
_PATH = "head string, key string, up string, level bigint, chars bigint, n bigint, first bigint, children bigint, leaves bigint, saved bigint, ends string"


def swept(dealt: DataFrame) -> DataFrame:
    """Containers, sorted, swept one after the other: rows of nodes (key null) and of the paths to the heads.

    A task holds one container and the rows that it gives, at most 20,000.
    """
    ordered = dealt.select("head", "ids", "at", "chars", "n", "first", "ends").repartition("head").sortWithinPartitions("head", "ids")
    types = [pa.string() if n == "ends_sha256" else pa.int64() for n in _NODE_NAMES] + [pa.string() if n in ("head", "key", "up", "ends") else pa.int64() for n in _PATH_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, path = [], []

        def batch() -> pa.RecordBatch:
            rows = [(*x, *(None,) * len(_PATH_NAMES)) for x in nodes] + [(*(None,) * len(_NODE_NAMES), *x) for x in path]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            nodes.clear()
            path.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_NODE_NAMES, *_PATH_NAMES])

        now, at, items = None, 0, []
        for b in batches:
            for k in range(0, b.num_rows, 500):
                for head, ids, depth, *rest in zip(*(c.to_pylist() for c in b.slice(k, 500).columns), strict=True):
                    if head != now:
                        if items:
                            for mine, got in zip((nodes, path), _sweep(now, at, items), strict=True):
                                mine.extend(got)
                        now, at, items = head, depth, []
                        if len(nodes) + len(path) >= 20_000:
                            yield batch()
                    items.append((ids, *rest))
        if items:
            for mine, got in zip((nodes, path), _sweep(now, at, items), strict=True):
                mine.extend(got)
        yield batch()

    return ordered.mapInArrow(run, f"{NODE}, {_PATH}")


def _head_nodes(paths: DataFrame) -> DataFrame:
    """Nodes from the root to the heads. Their counts add up over the containers below them.

    Each such node is owned by one container under it; what it adds of its own (a leaf, its saved tokens) is summed up
    along the owner's path, where it reaches every node above it once.
    """
    sums = paths.groupBy("key").agg(
        F.min("up").alias("up"), F.min("level").alias("level"), F.min("chars").alias("chars"), F.sum("n").alias("n"), F.min("first").alias("first"),
        F.sum("children").alias("inside"), F.max("ends").alias("ends"), F.min("head").alias("owner"),
    )
    fans = sums.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("below"))
    nodes = sums.join(fans, "key", "left").withColumn("children", F.col("inside") + F.coalesce("below", F.lit(0)))
    nodes = stage(nodes, "trie-heads")
    own = nodes.select(F.col("owner").alias("head"), "level", (F.col("children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("own"))
    down = Window.partitionBy("head").orderBy(F.col("level").desc())
    along = paths.join(own, ["head", "level"], "left").select("key", (F.col("leaves") + F.coalesce(F.sum("leaf").over(down), F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce(F.sum("own").over(down), F.lit(0))).alias("saved"))
    totals = along.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("up"), F.col("first").alias("parent_conv_id"))
    return nodes.join(totals, "key").join(parents, "up", "left").select(F.col("first").alias("conv_id"), F.col("level").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, chars) rows, as rebuilt_conversations() gives them; conv_id must be unique.

    Equal sequences count as many members as they have copies. Every sequence, even an empty one, is a member of the
    root. An empty table has no node. Groups of copies are counted before they meet, heads with many sequences are
    burst, and a container is bounded in turns; one conversation is one row.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = stage(swept(containers(sequences(conversations), limit)), "trie-swept")
    inner = rows.filter("key is null").select(*_NODE_NAMES)
    return inner.unionByName(_head_nodes(rows.filter("key is not null").select(*_PATH_NAMES)))
