"""What the operators share: folders every executor can reach, byte views of Arrow text, small helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a new local one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='shelfwise-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files of the finished step
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by stage() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names, so that extra or clashing columns do no harm."""
    return df.select(*(F.col(f"`{have}`").alias(want) for want, have in columns.items()))


def words_of(text: Column) -> Column:
    """The words of a lower-cased text as an array (native); [''] where there is none."""
    return F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACE_RUN)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the offsets at which each starts (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if offsets is not None and n else np.zeros(n + 1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of at most that many bytes together; a longer text is a range of its own."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


def sliced(column: pa.Array, most: int = 512) -> Iterator[pa.Array]:
    """A column in slices of few texts, so that what is made of each is all that a task holds beside the batch."""
    for a in range(0, len(column), most):
        yield column.slice(a, most)
