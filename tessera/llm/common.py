"""What the corpus operators share: shared storage, text buffers and the ASCII lower case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows an Arrow batch may hold; texts are long, so batches stay small.
BATCH_ROWS = 1000
#: ASCII lower case of each byte; other bytes stay.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: True for the bytes that end a word: space, tab, line feed, vertical tab, form feed, return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, when all that read them has itself been written."""
    for df in tables:
        if path := getattr(df, "cut_at", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, as the texts in them are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is used where the text has no other letters, as it is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and each row's start (nulls are empty); one more start ends the last row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    starts = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal run of bytes that are not white space; rows end words), and how many words each row has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    word = ~IS_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = starts[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    begin = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    inner = inner[inner > 0]
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    cut_at = np.searchsorted(begin, starts)
    return begin, end, np.diff(cut_at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications), in place where possible."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``columns`` (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
