"""Language identification: a byte convolutional network trained in numpy, applied to whole texts in batched windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import byte_view, chunks, held_out, pick, sliced

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The training sample: at most so many documents of a language, and so many crops of each.
PER_LANGUAGE = 400
CROPS = 5
#: Languages that are learned, the most frequent ones; it bounds the sample.
LANGUAGES = 256
#: Lowest score of a text whose language counts as known.
MIN_SCORE = 0.6
EPOCHS = 8
#: Windows in one numpy step; what a step needs stays in the processor's cache.
BATCH = 96


@dataclass
class ByteConvNet:
    """Embedding, filters of several widths in one matrix, max pooling over the window, softmax."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # (widest * EMBEDDING) x all filters; rows past a filter's width are zero
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under the widest filter at every position, one row each."""
        widest, flat = max(WIDTHS), windows.reshape(-1)
        e = np.take(self.embedding, np.concatenate((flat, np.zeros(widest - 1, flat.dtype))), axis=0)
        step = e.strides[0]
        return np.lib.stride_tricks.as_strided(e, (len(flat), widest * EMBEDDING), (step, e.strides[1]))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """By window (rows of WINDOW bytes) and language."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        valid = WINDOW - max(WIDTHS) + 1
        for a in range(0, len(windows), BATCH):
            part = windows[a : a + BATCH]
            z = np.dot(self._columns(part), self.filters).reshape(len(part), WINDOW, -1)[:, :valid]
            h = np.maximum(z.max(axis=1) + self.bias, 0)
            out[a : a + BATCH] = _log_softmax(h @ self.dense + self.dense_bias)
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts as windows, the last of each padded with zero bytes, and the text of each window."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    start = np.cumsum(n) - n
    windows = np.zeros((int(n.sum()), WINDOW), np.uint8)
    flat = windows.reshape(-1)
    shift = start * WINDOW - offsets[:-1]
    flat[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    return windows, owner


def train(samples: list[tuple[str, str]], seed: int = 5, epochs: int = EPOCHS) -> ByteConvNet:
    """Fit on (language, crop) pairs with Adam. Crops are also shown cut short, so that short texts are no surprise."""
    rng = np.random.default_rng(seed)
    languages = sorted({x for x, _ in samples}) or [UNDETERMINED]
    place = {x: i for i, x in enumerate(languages)}
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest * EMBEDDING, total), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    net = ByteConvNet(languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.2, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    texts, labels = [], []
    for language, crop in samples:
        raw = np.frombuffer(crop.encode("utf-8", "replace"), np.uint8)[:WINDOW]
        for size in (len(raw), int(len(raw) * rng.uniform(0.05, 0.5))):
            if size > 3:
                texts.append(np.pad(raw[:size], (0, WINDOW - size)))
                labels.append(place[language])
    if not texts or len(languages) < 2:
        return net
    x, y = np.stack(texts), np.array(labels)
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(np.float32)
    names = ("embedding", "filters", "bias", "dense", "dense_bias")
    m, v, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    valid = WINDOW - widest + 1
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), 4e-3 * 0.7**epoch
        for a in range(0, len(y), 64):
            some = order[a : a + 64]
            b = x[some]
            columns = np.ascontiguousarray(net._columns(b)).reshape(len(b), WINDOW, -1)
            z = (columns.reshape(-1, columns.shape[2]) @ net.filters).reshape(len(b), WINDOW, -1)[:, :valid]
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + net.bias
            h = np.maximum(pooled, 0)
            p = np.exp(_log_softmax(h @ net.dense + net.dense_bias))
            p[np.arange(len(b)), y[some]] -= 1
            p *= (weight[y[some]] / len(b))[:, None]
            dh = (p @ net.dense.T) * (pooled > 0)
            seen = columns[np.arange(len(b))[:, None], at]  # text x filter x column
            grads = {"dense": h.T @ p, "dense_bias": p.sum(0), "bias": dh.sum(0), "filters": np.einsum("bfc,bf->cf", seen, dh) * mask}
            under = (dh[:, :, None] * net.filters.T[None]).reshape(len(b), total, widest, EMBEDDING)
            de = np.zeros_like(net.embedding)
            padded = np.pad(b, ((0, 0), (0, widest)))
            for k in range(widest):
                np.add.at(de, padded[np.arange(len(b))[:, None], at + k].reshape(-1), under[:, :, k].reshape(-1, EMBEDDING))
            grads["embedding"] = de
            step += 1
            for n, g in grads.items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                setattr(net, n, (getattr(net, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, crops: int = CROPS, languages: int = LANGUAGES) -> ByteConvNet:
    """Train on crops of at most per_language documents of each of the most frequent languages, none of them held out.

    A language's documents are those whose id has the lowest hashes. Languages are counted first, so that each row can
    tell by its own hash whether it may be among them: only about twice the wanted rows are ranked and shuffled,
    however large the table. Collected are at most languages * per_language * crops short strings.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    bound = counts.select("lang", F.least(F.lit(1.0), 2.0 * per_language / F.col("n")).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(31), "doc_id"), 1)
    near = rows.select("doc_id", "lang", place.alias("place")).join(F.broadcast(bound), "lang").filter(F.col("place") <= F.col("share") * float(2**63))
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    length = F.length("text")
    crop = lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(length - WINDOW, F.lit(0)) + 1) + 1).cast("int"), F.lit(WINDOW))
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # at most languages * per_language ids
    got = got.select("lang", F.explode(F.array(*(crop(k) for k in range(crops)))).alias("crop")).distinct().orderBy("lang", "crop").collect()
    return train([(r.lang, r.crop) for r in got])


def classify(texts: pa.Array, net: ByteConvNet) -> tuple[list[str], np.ndarray]:
    """Language and score of every whole text: log-probabilities of its windows, weighted by their bytes, averaged."""
    names: list[str] = []
    scores = [np.zeros(0)]
    for part in sliced(texts):
        letters = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        data, offsets = byte_view(part)
        total = np.zeros((len(part), len(net.languages)))
        for a, z in chunks(offsets, 1 << 20):
            windows, owner = cut(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            held = (windows != 0).sum(axis=1)
            np.add.at(total, owner + a, net.log_probabilities(windows) * held[:, None])
        p = np.exp(_log_softmax(total / np.maximum(np.diff(offsets), 1)[:, None]))
        best = p.argmax(axis=1)
        names += [net.languages[k] if x else UNDETERMINED for k, x in zip(best, letters, strict=True)]
        scores.append(np.where(letters, np.clip(p[np.arange(len(part)), best], 0, 1), 0.0))
    return names, np.concatenate(scores)


def predict(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every whole text.

    A null text and one without any letter are `und` with score 0. Repeated rows stay; other columns are ignored;
    empty table: empty. Returns doc_id, lang_pred, score.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = classify(b.column(1), net)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """fit() and predict(). Returns doc_id, held_out, lang_pred, score."""
    net = fit(docs, id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, languages: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose predicted language has at least that score and, if given, is one of languages.

    lang becomes the prediction, whatever it was; undetermined texts go. All other columns stay.
    """
    net = fit(docs, id_col, text_col, lang_col)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        names, score = classify(texts, net)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    columns = [c for c in docs.columns]
    mark = next(f"_predicted{k}" for k in range(len(columns) + 1) if f"_predicted{k}" not in columns)
    # not deterministic to the optimizer, or it copies the call into the filter and every text meets the network twice
    seen = docs.withColumn(mark, predicted.asNondeterministic()(F.col(f"`{text_col}`")))
    kept = seen.filter((F.col(f"{mark}.score") >= min_score) & (F.col(f"{mark}.lang") != UNDETERMINED))
    kept = kept.filter(F.col(f"{mark}.lang").isin(*languages)) if languages else kept
    return kept.withColumn(lang_col, F.col(f"{mark}.lang")).select(*(F.col(f"`{c}`") for c in columns))
