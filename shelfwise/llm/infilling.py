"""Fill-in-middle transformation: a learned index from token ranks to byte offsets finds the cuts of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACES, byte_view, chunks, pick

#: What marks the parts in an output; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
SEED = 42
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Farthest that a segment's prediction may be from the true offset; residuals then fit a signed byte.
ERROR = 120
#: Bits after the point of a segment's slope, bytes a token.
POINT = 20
#: Bytes of texts that a task works on at once; a longer text is worked on alone.
CHUNK = 4 << 20
#: Points that a fit looks at first; it doubles as long as they stay on one segment.
LOOK = 256

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


class RankIndex:
    """Offsets by rank as straight segments and a signed byte each.

    A segment starts at a point and takes every following point as long as one slope stays within ERROR of all of
    them (the cone of possible slopes narrows with each point and the segment ends where it closes). A lookup finds
    the segment of a rank, predicts the offset along its slope and adds the stored residual, which makes it exact.
    """

    def __init__(self, offsets: np.ndarray):
        first, base, slope = [], [], []
        residual = np.empty(len(offsets), np.int8)
        a, n = 0, len(offsets)
        while a < n:
            end, rate = self._segment(offsets, a)
            fixed = int(round(rate * (1 << POINT)))
            guess = (np.arange(end - a, dtype=np.int64) * fixed) >> POINT
            residual[a:end] = offsets[a:end] - offsets[a] - guess
            first.append(a)
            base.append(offsets[a])
            slope.append(fixed)
            a = end
        self.first, self.base, self.slope = (np.array(x, np.int64) for x in (first, base, slope))
        self.residual = residual

    @staticmethod
    def _segment(offsets: np.ndarray, a: int) -> tuple[int, float]:
        """Where the segment that starts at point a ends, and its slope."""
        high, low, m, width, n = np.inf, -np.inf, a + 1, LOOK, len(offsets)
        while m < n:
            z = min(n, m + width)
            run = np.arange(m - a, z - a, dtype=np.float64)
            rise = offsets[m:z] - offsets[a]
            highs = np.minimum(np.minimum.accumulate((rise + ERROR) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - ERROR) / run), low)
            closed = np.flatnonzero(lows > highs)
            if closed.size:
                k = int(closed[0])
                if k:
                    high, low = highs[k - 1], lows[k - 1]
                m += k
                break
            high, low, m, width = highs[-1], lows[-1], z, width * 2
        return m, (high + low) / 2 if np.isfinite(high) else 0.0

    def __getitem__(self, rank: int) -> int:
        s = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.base[s]) + (int(self.slope[s]) * (rank - int(self.first[s])) >> POINT) + int(self.residual[rank])


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of texts end (bytes of the joined texts), and how many tokens come before each text.

    A token is white space and the word after it; white space at the end of a text is one of its own.
    """
    space = _IS_SPACE[data]
    ends = np.empty(len(data), bool)
    if len(data):
        ends[:-1] = ~space[:-1] & space[1:]
        ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    at = np.flatnonzero(ends) + 1
    return at, np.concatenate(([0], np.searchsorted(at, offsets[1:], "right")))


def _points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Every text once, cut into prefix, middle and suffix at token boundaries where a seeded draw says so.

    The first four groups of eight digits of sha256(seed:doc_id) are the draws h1 to h4. The cuts are the smaller and
    the larger of h1 and h2 modulo n + 1, in tokens, and a text is cut if h3 % 100 < rate. Output is suffix, prefix,
    middle (spm) if h4 % 100 < suffix_first, else prefix, suffix, middle (psm), each part after its mark. Offsets of all
    token boundaries of a text go into a RankIndex, which answers both cuts.

    Null and empty texts, and texts that hold a mark, stay plain: their output is the text (null: empty). A null id
    draws as an empty one. Repeated rows give repeated rows; other columns are ignored; empty table: empty. A text of any
    length is one value of one task, which needs about six times its bytes.
    Returns doc_id, n, form, prefix_chars, middle_chars (code points, null if plain), output, n_segments.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", "text", *draws)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(1))
            draw = [np.asarray(b.column(k)) for k in (2, 3, 4, 5)]
            for first, last in chunks(offsets, CHUNK):
                own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ends, before = token_ends(own, at)
                counts, forms, heads, middles, outputs, segments = [], [], [], [], [], []
                for k in range(last - first):
                    a, z, i = int(at[k]), int(at[k + 1]), first + k
                    text, n = own[a:z].tobytes(), int(before[k + 1] - before[k])
                    index = RankIndex(np.concatenate(([0], ends[before[k] : before[k + 1]] - a)))
                    counts.append(n)
                    segments.append(len(index.first))
                    if not n or draw[2][i] % 100 >= rate or any(m in text for m in MARKS):
                        forms.append("plain")
                        heads.append(None)
                        middles.append(None)
                        outputs.append(text)
                        continue
                    p, q = sorted((int(draw[0][i]) % (n + 1), int(draw[1][i]) % (n + 1)))
                    p, q = index[p], index[q]
                    heads.append(_points(own[a : a + p]))
                    middles.append(_points(own[a + p : a + q]))
                    if draw[3][i] % 100 < suffix_first:
                        forms.append("spm")
                        outputs.append(b"".join((MARKS[1], text[q:], MARKS[0], text[:p], MARKS[2], text[p:q])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((MARKS[0], text[:p], MARKS[1], text[q:], MARKS[2], text[p:q])))
                columns = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(segments, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"])

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, n_segments bigint")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No mark can begin inside a part and end outside of it, as none of
    them begins as it ends, so the first marks that are found are those that were set."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def infilling_digests(cut: DataFrame) -> DataFrame:
    """Digests of the outputs of fill_in_middle(), and of the texts restored from them."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return cut.select(*kept, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
