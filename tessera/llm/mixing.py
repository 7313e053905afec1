"""Mixing sources to target weights by fitting subset sums to word budgets.

Documents are counted by source and exact length. A source whose target holds its size q times is taken q times
whole; of the rest of its budget, each length first gives its share of documents, rounded down, then lengths in a
seeded order give one more, and what then remains (less than ``DP_WORDS``) is met by bounded-knapsack dynamic
programming over the documents that are left. While more than that remains, documents longer than it are fitted first, by
a program over the sums that they reach. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import bytes_of, cut, pieces, small_batches, word_bounds

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20260723
#: The remaining budget, in words, that dynamic programming meets; its memory is this many bits a length at most.
DP_WORDS = 1 << 17
#: Rows of a plan that may be broadcast, at some 80 bytes each; a larger plan is joined by shuffle.
BROADCAST_PLAN = 300_000
#: Sums of long documents that are held for the way back; beyond that, of sums that lie close together the ends stay.
HELD_SUMS = 1 << 23
#: Parts of long lengths that one program fits, and how many of the longest document the rest may hold before it does.
PROGRAM_PARTS, PROGRAM_RESTS = 256, 8


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its number of words."""
    for batch in batches:
        data, starts = bytes_of(batch.column(batch.num_columns - 1))
        counts = [word_bounds(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])[2] for i, j in pieces(starts, 4 << 20)]
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64())], names=batch.schema.names)


def source_key(source: Column) -> Column:
    """A key that is never null: null sources make one source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def share_targets(sizes: dict[str, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str, float]:
    """The words that each source should give; keys as of source_key, in code point order, the null source last.

    >>> share_targets({"sa": 10, "sb": 90})
    {'sa': 30.0, 'sb': 70.0}
    """
    order = sorted(sizes, key=lambda k: (k == "n", k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > most * sizes[k]]
        if not over:
            target |= {k: left * weight[k] / total for k in open_}
            break
        for k in over:
            target[k] = float(most * sizes[k])
            left -= target[k]
        open_ = [k for k in open_ if k not in target]
    return {k: target[k] for k in order}


def fit_long(lengths: np.ndarray, spare: np.ndarray, rest: int, fill: int, seed: int = SEED) -> np.ndarray:
    """How many of each length to take so that their words, with up to ``fill`` words more to come, are near to ``rest``.

    Up to ``PROGRAM_PARTS`` parts (powers of two of a length's documents) are fitted by one program over their sums. Of
    more, lengths in a seeded order are taken while the rest is many times the longest, and a program over some of the
    others, the longest among them, fits what remains; this goes on until a program takes nothing more.
    """
    take = np.zeros(len(lengths), np.int64)
    order = np.array(sorted(range(len(lengths)), key=lambda i: hashlib.md5(f"{seed}:long:{lengths[i]}".encode()).digest()), np.int64)
    while rest > 0:
        spare_now = spare - take
        usable = order[(spare_now[order] > 0) & (lengths[order] <= 2 * rest)]
        if not len(usable):
            break
        parts = _parts(lengths, spare_now, usable, rest)
        if every := len(parts) <= PROGRAM_PARTS:
            chosen = parts
        else:
            edge = PROGRAM_RESTS * int(lengths[usable].max())
            for i in usable.tolist():
                n = min(int(spare_now[i]), max(0, rest - edge) // int(lengths[i]))
                take[i] += n
                rest -= n * int(lengths[i])
            spare_now = spare - take
            usable = usable[(spare_now[usable] > 0) & (lengths[usable] <= 2 * rest)]
            parts = _parts(lengths, spare_now, usable, rest)
            longest = sorted(parts, key=lambda p: -p[1] * int(lengths[p[0]]))[: PROGRAM_PARTS // 2]
            chosen = longest + [p for p in parts if p not in set(longest)][: PROGRAM_PARTS // 2]
        more = _fit_sums(lengths, chosen, rest, fill)
        take += more
        rest -= int((more * lengths).sum())
        if every or not more.any():
            break
    return take


def _parts(lengths: np.ndarray, spare: np.ndarray, usable: np.ndarray, rest: int) -> list[tuple[int, int]]:
    """A length's documents as powers of two, so that any number of them is a sum of parts."""
    parts = []
    for i in usable.tolist():
        n, many = min(int(spare[i]), rest // int(lengths[i]) + 1), 1
        while n > 0:
            parts.append((i, min(many, n)))
            n, many = n - many, many * 2
    return parts


def _fit_sums(lengths: np.ndarray, parts: list[tuple[int, int]], rest: int, fill: int) -> np.ndarray:
    """The subset of ``parts`` whose sum is nearest to what is wanted, by a program over all sums that they reach.

    Where there are more sums than are held, of those in a unit the least and the greatest stay: a sum lost lies
    between two that stay, so the error is below a unit a step however long the documents are.
    """
    take, steps = np.zeros(len(lengths), np.int64), []
    held, sums = max(1 << 10, HELD_SUMS // max(1, len(parts))), np.zeros(1, np.int64)
    unit = 4 * rest // held + 1
    for i, part in parts:
        steps.append((i, part, sums))
        more = sums + part * int(lengths[i])
        sums = np.union1d(sums, more[more <= 2 * rest])
        if len(sums) > held:
            first = np.unique(sums // unit, return_index=True)[1]
            sums = sums[np.union1d(first, np.append(first[1:], len(sums)) - 1)]
    off = np.where(sums > rest, sums - rest, np.maximum(rest - sums - fill, 0))
    goal = int(sums[np.flatnonzero(off == off.min())[-1]])
    for i, part, before in reversed(steps):
        at = np.searchsorted(before, goal)
        if at == len(before) or before[at] != goal:
            take[i] += part
            goal -= part * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as the method can get."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    rest = budget - int((take * lengths).sum())
    spare = counts - take
    order = sorted(range(len(lengths)), key=lambda i: hashlib.md5(f"{seed}:{lengths[i]}".encode()).digest())
    long = lengths > dp_words
    if rest > dp_words and spare[long].any():
        more = fit_long(lengths, np.where(long, spare, 0), rest, int((spare * lengths)[~long].sum()), seed)
        take, spare, rest = take + more, spare - more, rest - int((more * lengths).sum())
    for most in (1, None):  # one more of each length, then as many as there are
        for i in order:
            if rest <= dp_words:
                break
            if spare[i] and 0 < lengths[i] <= rest and not long[i]:
                n = min(int(spare[i]), most or -(-(rest - dp_words) // int(lengths[i])))
                take[i] += n
                spare[i] -= n
                rest -= n * int(lengths[i])
    if rest <= 0 or rest > dp_words:
        return take
    # a bit for each sum up to rest and the longest document beyond it; the sums before each step stay for the way back
    reach, steps, mask = 1, [], (1 << (rest + int(lengths.max()) + 1)) - 1
    for i in order:
        n, many, length = min(int(spare[i]), rest // max(1, int(lengths[i])) + 1), 1, int(lengths[i])
        if length == 0 or length > 2 * rest:
            continue
        while n > 0 and not reach >> rest & 1:
            part = min(many, n)
            steps.append((i, part, reach))
            reach = (reach | reach << part * length) & mask
            n, many = n - part, many * 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    above = rest + (above & -above).bit_length() if above else None
    goal = above if above is not None and above - rest < rest - below else below
    for i, part, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += part
            goal -= part * int(lengths[i])
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("__size", ignore_index=True)
    size, target = int(group["__source_size"][0]), float(group["__target"][0])
    whole = min(MOST, int(target // size)) if size else 1
    rest = round(target - whole * size) if whole < MOST else 0
    return group.assign(__whole=whole, __extra=fit_budget(group["__size"].to_numpy(), group["__n"].to_numpy(), rest))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """__id, __skey (the source), __h (a seeded hash of id and text) and __size (words); the columns ``keep`` as one, __row, so that no name can clash."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.coalesce(text, F.lit("")))
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")] if keep else []
    rows = docs.select(*row, F.col(f"`{id_col}`").alias("__id"), source_key(F.col(f"`{source_col}`")).alias("__skey"), h.alias("__h"), text.alias("__size"))
    schema = StructType([*rows.schema.fields[:-1], StructField("__size", LongType())])
    return rows.mapInArrow(count_words, schema)


def plan_mix(sizes: DataFrame) -> DataFrame:
    """One row a source and length, by the columns of ``sized``: how often all are taken (``whole``), and up to which split and hash once more.

    The driver holds one number a source; the histogram of a source, which has a row for each distinct length, is one
    task's. Rows of one length are split by hash into about the root of their number, so that no group is ranked as a whole.
    """
    spark = sizes.sparkSession
    hist = cut(sizes.groupBy("__skey", "__size").agg(F.count("*").alias("__n")), "mix-lengths")
    totals = {r[0]: int(r[1]) for r in hist.groupBy("__skey").agg(F.sum(F.col("__size") * F.col("__n"))).collect()}
    targets = share_targets(totals)
    frame = spark.createDataFrame([(k, totals[k], t) for k, t in targets.items()], "__skey string, __source_size long, __target double")
    plan = cut(hist.join(F.broadcast(frame), "__skey").groupBy("__skey").applyInPandas(_fit, "__skey string, __size long, __n long, __source_size long, __target double, __whole long, __extra long"), "mix-plan")
    group = ["__skey", "__size"]
    rows = sizes.select(*group, "__h").join(plan.filter("__extra > 0").select(*group, "__n", "__extra"), group).withColumn("split", _split())
    counted = rows.groupBy(*group, "split").agg(F.count("*").alias("here"), F.first("__extra").alias("extra"))
    counted = counted.withColumn("upto", F.sum("here").over(Window.partitionBy(*group).orderBy("split")))
    edge = counted.filter("upto >= extra AND upto - here < extra").select(*group, "split", (F.col("extra") - F.col("upto") + F.col("here")).alias("need"))
    ranked = rows.join(edge, [*group, "split"]).withColumn("rank", F.row_number().over(Window.partitionBy(*group, "split").orderBy("__h")))
    edge = ranked.filter("rank = need").select(*group, F.col("split").alias("__last_split"), F.col("__h").alias("__last_h"))
    return cut(plan.join(edge, group, "left"), "mix-bounds")


def _split() -> Column:
    return F.pmod(F.shiftright("__h", 20), F.ceil(F.sqrt("__n")))


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (as of ``sized``) with __source_size, __target and __copies added. The plan, whose size depends on the number of sources and lengths alone, is broadcast if it is small."""
    small = plan.count() <= BROADCAST_PLAN
    joined = rows.join(F.broadcast(plan) if small else plan, ["__skey", "__size"])
    one = (_split() < F.col("__last_split")) | ((_split() == F.col("__last_split")) & (F.col("__h") <= F.col("__last_h")))
    return joined.withColumn("__copies", F.col("__whole") + F.coalesce(one.cast("long"), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row a document: id, skey, size, source_size, target, copies.

    Null or empty texts have size 0; they are taken as often as their whole source is. Rows that repeat an id are
    documents of their own; those that repeat id and text are taken alike. An empty table gives no rows.
    """
    sizes = cut(sized(docs, id_col, source_col, text_col, seed=seed), "mix-sizes")
    out = apply_mix(sizes, plan_mix(sizes))
    return out.select(F.col("__id").alias("id"), F.col("__skey").alias("skey"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with the columns of ``docs`` whatever their names.

    Nulls, empty texts, repeated rows and empty tables are as in ``mix``. The texts are not shuffled.
    """
    sizes = cut(sized(docs, id_col, source_col, text_col, seed=seed), "mix-sizes")
    taken = apply_mix(sized(docs, id_col, source_col, text_col, tuple(docs.columns), seed), plan_mix(sizes)).filter("__copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("__row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
