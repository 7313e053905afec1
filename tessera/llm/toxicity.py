"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its character n-grams (bytes, A-Z lower-cased, word boundaries included), hashed into a table of
embeddings; their average (with a fixed number of zero vectors) goes through a linear softmax. Embeddings and softmax are learned together, so an unseen
misspelling shares most n-gram vectors with the word that it hides. To score, the softmax is folded into the table: each
n-gram has one number, and a text's score is the mean of its n-grams' numbers through a sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import IS_SPACE, LOWER_BYTES, bytes_of, pieces, small_batches

#: Labelled documents that the model is fitted on at most, in order of a hash of their id, and bytes of their texts; a longer text than a sixteenth of these is not fitted on.
TRAIN_ROWS, TRAIN_BYTES = 4000, 48 << 20
#: N-gram lengths in bytes, rows of the table as a power of two, numbers a row.
GRAMS, BITS, WIDTH = (3, 4, 5, 6), 18, 8
EPOCHS, RATE, SEED = 7, 0.3, 7
#: Zero vectors that count in every average, so that a text of a few words is not judged by one n-gram; documents that an n-gram must be in; a common factor of all averages.
PADDING, LEAST_DOCS, SCALE = 300, 4, 100.0
#: Bytes that are hashed at a time.
PIECE, TRAIN_PIECE = 1 << 18, 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # a number for each n-gram
    bias: float


def _clean(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space made spaces; a space before and after each row, and eight at the end."""
    rows = len(starts) - 1
    out = np.full(len(data) + 2 * rows + 8, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, np.diff(starts))
    out[at] = np.where(IS_SPACE[data], 32, LOWER_BYTES[data])
    return out, starts + 2 * np.arange(rows + 1)


def grams(clean: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the places from ``begin`` to ``end`` where one starts that has no space inside, and their table rows."""
    wide = np.ndarray((end - begin,), "<u8", clean, begin, (1,))
    gap = np.cumsum(clean[begin : end + 8] == 32, dtype=np.int32)
    for k, n in enumerate(GRAMS):
        # no space at places 1 to n - 2
        at = np.flatnonzero(gap[n - 2 : n - 2 + end - begin] == gap[: end - begin])
        part = wide[at] & np.uint64((1 << 8 * n) - 1)
        yield at, (((part + np.uint64(k)) * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def _bags(clean: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' distinct known table rows one after the other, their shares of the row's average, where each row's begin, and which are known."""
    parts, mask = [], (1 << BITS) - 1
    docs_with = np.zeros(1 << BITS, np.int32)
    for i, j in pieces(starts, TRAIN_PIECE):
        keys = []
        for p in range(int(starts[i]), int(starts[j]), PIECE):
            for at, rows in grams(clean, p, min(int(starts[j]), p + PIECE)):
                keys.append((np.searchsorted(starts[i : j + 1], at + p, side="right") - 1) << BITS | rows)
        found, many = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        owner, rows = found >> BITS, (found & mask).astype(np.int32)
        factor = SCALE / (PADDING + np.bincount(owner, many, j - i))
        docs_with += np.bincount(rows, minlength=1 << BITS).astype(np.int32)
        parts.append((rows, (many * factor[owner]).astype(np.float32), np.bincount(owner, minlength=j - i)))
    known = docs_with >= LEAST_DOCS
    for k, (rows, share, sizes) in enumerate(parts):
        keep = known[rows]
        parts[k] = rows[keep], share[keep], np.diff(np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(sizes)]])
    begin = np.cumsum(np.concatenate([[0], *(sizes for _, _, sizes in parts)]))
    found, shares = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.float32)
    at = 0
    for rows, share, _ in parts:
        found[at : at + len(rows)], shares[at : at + len(rows)] = rows, share
        at += len(rows)
    return found, shares, begin, known


def fit(texts: list[str] | pa.ChunkedArray, toxic: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Learns table and softmax by stochastic gradient descent over documents in a seeded order.

    N-grams of fewer than ``LEAST_DOCS`` documents keep a zero vector. Without both labels the model is a constant.
    """
    y = np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    found, share, begin, known = _bags(*_clean(*bytes_of(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    vectors[~known] = 0
    out, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            rows, x = found[begin[i] : begin[i + 1]], share[begin[i] : begin[i + 1]]
            mean = x @ vectors[rows]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= 0.02 * step * np.outer(mean, p)
            bias -= 0.1 * step * p
            vectors[rows] -= (step * x)[:, None] * back
    vectors[~known] = 0
    return Model((SCALE * (vectors @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def score(column: pa.Array, model: Model) -> np.ndarray:
    """A number from 0 to 1 for each text, higher for toxic ones; an empty or null text has the bias alone."""
    clean, starts = _clean(*bytes_of(column))
    total, many = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1, np.int64)
    for p in range(0, int(starts[-1]), PIECE):
        end = min(int(starts[-1]), p + PIECE)
        first, last = np.searchsorted(starts, p, side="right") - 1, np.searchsorted(starts, end, side="left")
        edge = np.clip(starts[first : last + 1] - p, 0, end - p)
        for at, rows in grams(clean, p, end):
            sums = np.zeros(len(at) + 1)
            np.cumsum(model.table[rows], out=sums[1:])
            cut = np.searchsorted(at, edge)
            total[first:last] += np.diff(sums[cut])
            many[first:last] += np.diff(cut)
    z = np.clip(model.bias + total / (PADDING + many), -50, 50)
    return 1 / (1 + np.exp(-z))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _fit_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (id, text, toxic) make one row: the model's table and bias."""
    table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("text", pa.string()), ("toxic", pa.int64())]))
    table = table.sort_by("id")
    model = fit(table.column("text"), table.column("toxic").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["table", "bias"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on labelled rows that are not held out, in order of a hash of the id: at most ``train_rows`` of them and ``train_bytes`` bytes of text.

    Null ids and labels are left out, a null text is empty, of several labels of an id the largest counts, and of
    several texts of an id the longest, then the greatest. Without such rows, or if their labels agree, the model is a
    constant. One executor task reads the sample and fits; the driver gets the model, whose size is fixed, and no text.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("long").alias("toxic"))
    chosen = known.filter(~held_out("id")).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(train_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.octet_length("text") <= train_bytes // 16).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.max(F.struct(F.octet_length("text").alias("bytes"), "text")).alias("best"), F.max("toxic").alias("toxic"))
    # the sample has at most train_rows rows, so one window sees it whole
    before = F.sum("best.bytes").over(Window.orderBy(F.xxhash64(F.lit(SEED), "id"), "id"))
    rows = rows.withColumn("upto", before).filter(F.col("upto") <= train_bytes).select(F.col("id").cast("string").alias("id"), "best.text", "toxic")
    got = rows.repartition(1).mapInArrow(_fit_once, "table binary, bias double").first()
    return Model(np.frombuffer(got.table, np.float32), got.bias) if got else fit([], [])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score added, in place of a column of that name.

    Null and empty texts have the score of the model's bias alone. Rows are independent, so rows that repeat have one
    score each, an empty table gives no rows, and other columns stay as they are; the model has a fixed size and goes
    to the executors once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.array(score(text, sent.value), pa.float64())

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, held_out (also where the id is null), score, predicted; null and empty texts included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
