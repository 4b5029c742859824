"""Exact substring dedup: sparse distributed prefix doubling over sampled positions of every text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import byte_view, pick, stage

THRESHOLD = 200
#: First rank: that of the 32 bytes at a sampled position.
GRAM = 32
SEGMENT = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
_RANDOM = np.random.default_rng(20250)
TABLES = _RANDOM.integers(0, 1 << 64, (2, 256), np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _double(h: np.ndarray, width: int, shift: int) -> np.ndarray:
    """Ranks of strings from the ranks of two parts, the second starting shift later (along the last axis)."""
    with np.errstate(over="ignore"):
        a = h[..., : h.shape[-1] - shift] * np.uint64(pow(int(MULTIPLIER), width, 1 << 64))
        a += h[..., shift:]
    return a


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the GRAM bytes at each position, by doubling."""
    h, width = TABLES[0][data], 1
    while width < GRAM:
        h, width = _double(h, width, width), 2 * width
    return h


def sampled(data: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled positions of a batch of texts: text, first window, number of windows, gram rank and two context ranks.

    Every string of threshold bytes (window) belongs to the position in it whose gram ranks lowest, the first of
    equals. That depends on the window's bytes alone, so equal windows belong to positions with equal grams, and only
    those are ever compared. A position's windows are consecutive; all their bytes are its context.
    """
    n, reach = len(data), threshold - GRAM + 1
    raw = data.tobytes()
    for a in range(0, max(0, n - threshold + 1), SEGMENT):
        part = data[a : a + SEGMENT + threshold - 1]
        windows = len(part) - threshold + 1
        gram = gram_ranks(part)
        with np.errstate(over="ignore"):
            key = (gram * MULTIPLIER) & ~PLACE | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        if reach > width:
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
        place = (key[:windows] & PLACE).astype(np.int64)
        inside = np.ones(windows, bool)
        first, last = np.searchsorted(offsets, [a + 1, a + len(part)], "left")
        for e in offsets[first : last + 1]:
            inside[max(0, e - threshold + 1 - a) : max(0, e - a)] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        own = place[at]
        begins = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
        count = np.diff(np.append(begins, len(at)))
        start = at[begins] + a
        text = np.searchsorted(offsets, start, "right") - 1
        digests = b"".join([hashlib.blake2b(raw[s : s + m], digest_size=16).digest() for s, m in zip(start.tolist(), (count + threshold - 1).tolist(), strict=True)])
        context = np.frombuffer(digests, np.int64).reshape(-1, 2)
        yield text, start - offsets[text], count, gram[own[begins]].view(np.int64), context[:, 0], context[:, 1]


#: Contexts that one task compares in memory; a gram with more of them is compared row by row in Spark.
GROUP = 20_000
BUFFER = 16_000


def _positions(rows: DataFrame, threshold: int) -> DataFrame:
    """sampled() of (doc_id, tag, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(2))
            for text, start, n, gram, c1, c2 in sampled(data, offsets, threshold):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, (start, n, gram, c1, c2))], ["doc_id", "tag", "start", "n", "gram", "c1", "c2"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tag int, start bigint, n bigint, gram bigint, c1 bigint, c2 bigint")


def window_ranks(contexts: list[bytes], counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent ranks of every window of every context, by doubling; one row a context, padded."""
    width = int(counts.max()) + threshold - 1
    raw = np.zeros((len(contexts), width), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(contexts), np.uint8)
    out = []
    for table in TABLES:
        h, done = table[raw], 1
        while 2 * done <= threshold:
            h, done = _double(h, done, done), 2 * done
        out.append(_double(h, done, threshold - done) if threshold > done else h)
    return out[0], out[1]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of true values in each row."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _with_text(rows: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """rows (doc_id, tag, text) with the columns of keyed, which has each (doc_id, tag) once."""
    other = keyed.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), how).drop("_id", "_tag")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Byte spans of strings of threshold bytes that start at two or more positions of the texts.

    Ranks of a string of doubled length are pairs of ranks at a growing offset. A suffix array of all bytes would sort
    a row for each; here only positions that sampled() picks are ranked in Spark, about one in threshold / 3 bytes, and
    every window of threshold bytes belongs to exactly one of them:
    1. positions are grouped by the rank of their first 32 bytes; those with a rank of their own are done;
    2. the rest is ranked again by its whole context. Equal contexts, longer than the threshold, repeat in full;
    3. of grams with unequal contexts, each distinct context is ranked at every offset around the position; windows
       that share their rank repeat. Contexts of one gram meet in one task; a gram with more than `group` distinct
       contexts is counted window by window with partial sums instead.
    Returns doc_id, tag (hash of the text; with doc_id it tells rows apart), start, end.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.hash("text").alias("tag"), "text")
    places = _positions(rows, threshold)
    grams = places.groupBy("gram").agg(F.count("*").alias("k"), F.min("c1").alias("low"), F.max("c1").alias("high")).filter("k > 1")
    grams = stage(grams.select("gram", (F.col("low") == F.col("high")).alias("same")), "substring-grams")
    shared = stage(places.join(grams, "gram"), "substring-positions")

    mixed = shared.filter("not same")
    contexts = mixed.groupBy("gram", "c1", "c2").agg((F.count("*") > 1).alias("many"), F.min(F.struct("doc_id", "tag", "start", "n")).alias("p")).select("gram", "c1", "c2", "many", "p.*")
    contexts = stage(contexts, "substring-contexts")
    whole = shared.filter("same").select("doc_id", "tag", "start", "n")
    equal = mixed.join(contexts.filter("many").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi").select("doc_id", "tag", "start", "n")
    spans = whole.unionByName(equal).select("doc_id", "tag", "start", (F.col("start") + F.col("n") + threshold - 1).alias("end"))

    large = contexts.groupBy("gram").count().filter(F.col("count") > group).select("gram", F.lit(True).alias("large"))
    listed = contexts.join(large, "gram", "left").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "start", "n", "many", F.coalesce("large", F.lit(False)).alias("large"))).alias("list"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(2))
            lists = b.column(3)
            owner = pa.array(np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy())))
            flat = lists.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            a = start + offsets[owner.to_numpy()]
            raw = data.tobytes()
            cut = [raw[x:y] for x, y in zip(a.tolist(), (a + n + threshold - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *(flat.field(k) for k in ("gram", "start", "n", "many", "large")), pa.array(cut, pa.binary())], ["doc_id", "tag", "gram", "start", "n", "many", "large", "bytes"])

    cut = _with_text(rows, listed).select("doc_id", "tag", "text", "list").mapInArrow(slices, f"doc_id {kind}, tag int, gram bigint, start bigint, n bigint, many boolean, large boolean, bytes binary")
    cut = stage(cut, "substring-bytes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            counts, many = t["n"].to_numpy(), t["many"].to_numpy()
            r1, r2 = window_ranks(t["bytes"].to_pylist(), counts, threshold)
            valid = np.arange(r1.shape[1]) < counts[:, None]
            w1, w2 = r1[valid], r2[valid]
            order = np.argsort(w1, kind="stable")
            same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
            twin = np.zeros(len(order), bool)
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            hit = np.zeros(valid.shape, bool)
            hit[valid] = twin
            hit[many] = False
            row, first, last = _runs(hit)
            at, start = pa.array(row), t["start"].to_numpy()[row]
            return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(at), t["tag"].combine_chunks().take(at), pa.array(start + first), pa.array(start + last + threshold)], ["doc_id", "tag", "start", "end"])

        def ready(end: bool) -> Iterator[pa.RecordBatch]:
            """Settle all complete grams; the last one may go on in the next batch."""
            if not held or (not end and sum(map(len, held)) < BUFFER):
                return
            t = pa.concat_tables(held)
            grams = t["gram"].to_numpy()
            stop = len(t) if end else int(np.searchsorted(grams, grams[-1]))
            held[:] = [t.slice(stop)] if stop < len(t) else []
            a = 0
            while a < stop:
                z = min(a + BUFFER, stop)
                if z < stop:
                    z = int(np.searchsorted(grams[:stop], grams[z]))
                    z = z if z > a else int(np.searchsorted(grams[:stop], grams[a], "right"))
                yield settle(t.slice(a, z - a))
                a = z

        for b in batches:
            if len(b):
                held.append(pa.Table.from_batches([b]))
                yield from ready(False)
        yield from ready(True)

    part = cut.filter("not large").drop("large").repartition("gram").sortWithinPartitions("gram")
    spans = spans.unionByName(part.mapInArrow(compare, f"doc_id {kind}, tag int, start bigint, end bigint"))
    if not large.isEmpty():

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, len(b), 1000):
                    t = b.slice(a, 1000)
                    counts = t.column("n").to_numpy()
                    r1, r2 = window_ranks(t.column("bytes").to_pylist(), counts, threshold)
                    row, i = np.nonzero(np.arange(r1.shape[1]) < counts[:, None])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([t.column("doc_id").take(at), t.column("tag").take(at), pa.array(t.column("start").to_numpy()[row] + i), t.column("many").take(at), pa.array(r1[row, i].view(np.int64)), pa.array(r2[row, i].view(np.int64))], ["doc_id", "tag", "start", "many", "w1", "w2"])

        windows = cut.filter("large").select("doc_id", "tag", "start", "n", "many", "bytes").mapInArrow(expand, f"doc_id {kind}, tag int, start bigint, many boolean, w1 bigint, w2 bigint")
        often = stage(windows.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "substring-windows")
        found = windows.filter("not many").join(often, ["w1", "w2"], "left_semi")
        spans = spans.unionByName(found.select("doc_id", "tag", "start", (F.col("start") + threshold).alias("end")))
    return spans


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans that cover the same bytes; adjoining spans are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    begins = np.concatenate(([True], s[1:] > e[:-1]))
    return s[begins], e[np.append(np.flatnonzero(begins)[1:] - 1, len(e) - 1)]


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text's UTF-8 bytes without those covered by a string of threshold bytes that starts elsewhere too.

    Matches never cross documents, may overlap, and are judged on the input. Null text: empty. Texts shorter than
    the threshold stay whole. Rows with equal id and text are documents of their own, so both lose their bytes.
    Other columns are ignored; empty table: empty. Memory follows one batch of texts, whatever a string's count.
    Returns doc_id, n_bytes, kept (binary), spans (array of removed [start, end) runs, maximal).
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.hash("text").alias("tag"), "text")
    spans = repeated_spans(docs, threshold, id_col, text_col).distinct()
    listed = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(1))
            raw, lists = data.tobytes(), b.column(2)
            flat = lists.flatten()
            starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            stops = np.cumsum(sizes)
            kept, removed = [], []
            for i, (o, z, k) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), sizes.tolist(), strict=True)):
                if not k:
                    kept.append(raw[o:z])
                    removed.append([])
                    continue
                s, e = merged(starts[stops[i] - k : stops[i]], ends[stops[i] - k : stops[i]])
                edges = [0, *np.stack((s, e), 1).reshape(-1).tolist(), z - o]
                kept.append(b"".join([raw[o + x : o + y] for x, y in zip(edges[::2], edges[1::2], strict=True)]))
                removed.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_text(rows, listed, "left").select("doc_id", "text", "list").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start: bigint, end: bigint>>")


def removal_digests(cleaned: DataFrame) -> DataFrame:
    """Counts and the digest of the kept bytes, of remove_repeats() rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
