"""Runs of repeated phrases: maximal stretches of words that repeat with a period at least ``exponent`` times.

A document's words become numbers. The array is compared with itself shifted by every lag up to n / exponent, and the
true stretches are measured. A stretch that is long enough holds ``exponent - 1`` places in a row that are multiples of
the lag, so each lag is compared there first, all lags at once, and only lags with such places are compared whole. A
stretch whose first period is itself a repetition belongs to a smaller lag, which finds the same stretch; it is noted
so that further multiples need no look. Long documents are dealt as ranges of lags to other tasks, short ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from .common import cut, small_batches

EXPONENT, LEAST = 4, 6
#: Texts of more bytes are dealt by ranges of lags.
LONG_BYTES = 1 << 16
#: Places of a long document that a range of lags compares first; a document has at most ``MOST_RANGES`` ranges, larger ones if need be.
RANGE_PLACES, MOST_RANGES = 1 << 16, 64
#: Places compared at once.
BLOCK = 1 << 20
#: Runs of long documents that may be broadcast, at some 40 bytes each; more are joined by shuffle.
BROADCAST_RUNS = 300_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORDS = r"[\x20\x09-\x0D]+"


def numbered(text: bytes) -> np.ndarray:
    """The words of a text as numbers; equal words have equal numbers. White space is what ``bytes.split`` takes for it: the six ASCII characters."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in text.split()], np.int32)


def least_period(block: np.ndarray) -> int:
    """The length of the shortest word that ``block`` is a power of."""
    size, rest, prime = len(block), len(block), 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        rest //= prime
        while size % prime == 0 and np.array_equal(block[: size - size // prime], block[size // prime : size]):
            size //= prime
    return size


def _covered(known: dict[int, list[tuple[int, int]]], lag: int, at: np.ndarray, reach: int) -> np.ndarray:
    """Which of the places lie, with ``reach`` words, in a known stretch whose period divides the lag."""
    found = np.zeros(len(at), bool)
    for period, stretches in known.items():
        if lag % period == 0:
            spans = np.array(sorted(stretches))
            k = np.searchsorted(spans[:, 0], at, side="right") - 1
            found |= (k >= 0) & (spans[k, 1] >= at + reach)
    return found


def scan(words: np.ndarray, low: int = 1, high: int | None = None, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) with periods from ``low`` to below ``high``, by period and start.

    >>> scan(np.array([5, 1, 2, 1, 2, 1, 2, 1, 2, 1, 7]))
    [(1, 9, 2)]
    """
    n = len(words)
    high = min(n // exponent + 1, high or n)
    known: dict[int, list[tuple[int, int]]] = {}
    out = []
    while low < high:
        lags = np.arange(low, min(high, low + BLOCK))
        counts = (n - 1) // lags
        lags = lags[: max(1, int(np.searchsorted(np.cumsum(counts), BLOCK, side="right")))]
        counts = counts[: len(lags)]
        low += len(lags)
        lag = np.repeat(lags, counts)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * lag
        same = words[at] == words[at + lag]
        row = exponent - 1
        hit = same[: len(same) - row + 1].copy()
        for k in range(1, row):
            hit &= same[k : len(same) - row + 1 + k]
        hit = np.flatnonzero(hit)
        hit = hit[lag[hit] == lag[hit + row - 1]]
        bounds = np.flatnonzero(np.diff(lag[hit], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            q = int(lag[hit[a]])
            if _covered(known, q, at[hit[a:b]], row * q + 1).all():
                continue
            edges = np.diff((words[:-q] == words[q:]).astype(np.int8), prepend=0, append=0)
            start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            enough = stop - start >= max(row * q, least - q)
            for s, e in zip(start[enough].tolist(), (stop[enough] + q).tolist()):
                period = least_period(words[s : s + q])
                known.setdefault(period, []).append((s, e))
                if period == q:
                    out.append((s, e - s, q))
    return out


def ranges(n: int, exponent: int = EXPONENT, places: int = RANGE_PLACES) -> list[tuple[int, int]]:
    """Ranges of lags of a document of ``n`` words, each with about as many places to compare."""
    if n < exponent:
        return []
    counts = np.cumsum((n - 1) // np.arange(1, n // exponent + 1))
    share = max(places, -(-int(counts[-1]) // MOST_RANGES))
    low, out = 1, []
    while low <= len(counts):
        before = int(counts[low - 2]) if low > 1 else 0
        high = max(low + 1, int(np.searchsorted(counts, before + share, side="right")) + 1)
        out.append((low, min(high, len(counts) + 1)))
        low = high
    return out


def _runs_array(found: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    flat = np.array([r for runs in found for r in sorted(runs, key=lambda r: (r[0], r[2]))], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (value.as_buffer().to_pybytes() if value.is_valid else b"" for value in column.cast(pa.large_binary()))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def periodic_runs(docs: DataFrame, text_col: str = "text", out_col: str = "runs", exponent: int = EXPONENT, least: int = LEAST, long_bytes: int = LONG_BYTES, places: int = RANGE_PLACES) -> DataFrame:
    """``docs`` with the array ``out_col`` of each whole text's runs (start, length, period; in words), by start, then period.

    A run is a stretch of words with smallest period q, at least ``least`` words and ``exponent`` * q words long, that
    no neighbour extends. A null or empty text has none. Rows are judged alone, so ties and repeated rows are alike
    and an empty table stays empty; a column named ``out_col`` is replaced, others of any name are kept. Of texts of
    more than ``long_bytes`` bytes, ranges of lags are dealt to other tasks; these alone are shuffled, with the words
    as numbers, and their runs come back by a digest of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c != out_col]
    all_of = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    near = docs.filter(F.octet_length(text) <= long_bytes).select(*all_of, text.alias(out_col))
    runs_type = _parse_datatype_string(RUNS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(numbered(t), exponent=exponent, least=least) for t in _texts(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _runs_array(found)], names=batch.schema.names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0), _texts(batch.column(1))):
                words = numbered(t)
                if parts := ranges(len(words), exponent, places):
                    low, high = zip(*parts)
                    yield pa.RecordBatch.from_pydict({"key": [key.as_py()] * len(parts), "low": low, "high": high, "words": [words.tobytes()] * len(parts)})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, low, high, words in zip(*(c.to_pylist() for c in batch.columns)):
                found = scan(np.frombuffer(words, np.int32), low, high, exponent, least)
                start, length, period = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), *(pa.array(c, pa.int64()) for c in (start, length, period))], names=["key", "start", "length", "period"])

    short = near.mapInArrow(whole, StructType([*near.schema.fields[:-1], StructField(out_col, runs_type)]))
    far = docs.filter(F.octet_length(text) > long_bytes)
    if not far.limit(1).count():
        return short
    key = F.sha2(text.cast("binary"), 256)
    dealt = far.select(key.alias("key"), text.alias("text")).mapInArrow(deal, "key string, low long, high long, words binary")
    # in turns, not by key: the ranges of one text must not meet in a task
    found = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(part, "key string, start long, length long, period long")
    by_text = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length", "period"))).alias("found"))
    order = F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    by_text = cut(by_text.select("key", order.alias("found")), "long-runs")
    held = by_text.agg(F.coalesce(F.sum(F.size("found") + 1), F.lit(0))).first()[0]
    by_text = by_text.select(F.col("key").alias("__key"), F.col("found").alias("__found"))
    row = far.select(F.struct(*all_of).alias("__row"), key.alias("__key"))
    joined = row.join(F.broadcast(by_text) if held <= BROADCAST_RUNS else by_text, "__key", "left")
    long = joined.select("__row.*", F.coalesce("__found", F.array().cast(RUNS)).alias(out_col))
    return short.unionByName(long) if len(set(keep)) == len(keep) else short.union(long)


def collapse_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed") -> DataFrame:
    """``docs`` with the string ``out_col``: the words of each text, joined by one space, without those that a run holds after its first period.

    Null or empty texts give an empty string, null runs are none; a column named ``out_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != out_col]
    runs = _free("__runs", keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{runs_col}`").alias(runs), F.col(f"`{text_col}`").cast("string").alias(out_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for found, t in zip(batch.column(batch.num_columns - 2).to_pylist(), _texts(batch.column(batch.num_columns - 1))):
                words = t.split()
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        gone[r["start"] + r["period"]] += 1
                        gone[r["start"] + r["length"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                made.append(b" ".join(words))
            out = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], out], names=[*batch.schema.names[:-2], out_col])

    return rows.mapInArrow(work, StructType([*rows.schema.fields[:-2], StructField(out_col, StringType())]))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of each document whose crc32(doc_id) ends in 0 repeats a part of its words up to its end; a null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    split = chosen.withColumn("words", F.when(F.col("g").isNotNull(), F.filter(F.split("text", WORDS, -1), lambda w: w != "")))
    sized = split.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    known = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform("words", lambda w, i: F.get(F.col("words"), at(i).cast("int"))), " ")
    # a generator: filters on the new text stay above it, so that it is made once
    return known.select("doc_id", F.explode(F.array(F.when(F.col("n") > 0, made).otherwise(F.col("text")))).alias("text"))


def _sooner(a: Column, b: Column) -> Column:
    """Negative if run ``a`` comes before ``b``: greater exponent, smaller start, smaller period."""
    ratio = b["length"] * a["period"] - a["length"] * b["period"]
    return F.signum(F.when(ratio != 0, ratio).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each document's words as ``with_repeats`` gives them; nulls, empty, long and repeated texts as in ``periodic_runs``."""
    docs = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = collapse_runs(periodic_runs(docs)).withColumn("best", F.get(F.array_sort("runs", _sooner), F.lit(0)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
