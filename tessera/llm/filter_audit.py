"""What each filter of a chain does in every order of the chain, from one count a part and set of failed filters.

Each document gets a mask of the filters that it fails. Counts by part and mask are turned by a subset-zeta transform
into how many documents survive every subset of the filters; a step of an order is the difference between two
neighbouring subsets, and so are the losses of labelled documents and a filter's share over all orders. So the corpus
is read once, whatever the number of orders; all that depends on orders works on 2^m numbers a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches

WORDS = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose steps a task holds at once.
PARTS = 50


def survivors(counts: np.ndarray) -> np.ndarray:
    """For each set of filters how many pass them all, from how many fail exactly each set; both by mask, along the last axis.

    >>> survivors(np.array([5, 2, 1, 4])).tolist()
    [12, 6, 7, 5]
    """
    size = counts.shape[-1]
    within = counts.reshape(*counts.shape[:-1], *(2,) * (size.bit_length() - 1)).copy()
    for axis in range(counts.ndim - 1, within.ndim):
        np.cumsum(within, axis=axis, out=within)
    # who fails only filters outside a set passes the set
    return within.reshape(counts.shape)[..., ::-1]


def steps(alive: np.ndarray, letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders and step numbers, and per part (first axis) the counts of each step; ``alive`` is parts x measures x masks."""
    m, size = len(letters), alive.shape[-1]
    orders = list(permutations(range(m)))
    before = np.array([[sum(1 << f for f in order[:k]) for k in range(m)] for order in orders]).ravel()
    filters = np.array(orders).ravel()
    after = before | 1 << filters
    removed = alive[:, :, before] - alive[:, :, after]
    fails = alive[:, 0, :1] - alive[:, 0, 1 << filters]
    others = (size - 1) ^ (1 << filters)
    shares = np.zeros((len(alive), m), np.int64)
    for f in range(m):
        for subset in (s for s in range(size) if not s >> f & 1):
            taken = subset.bit_count()
            shares[:, f] += factorial(taken) * factorial(m - 1 - taken) * (alive[:, 0, subset] - alive[:, 0, subset | 1 << f])
    found = [alive[:, 0, after], removed[:, 0], fails - removed[:, 0], alive[:, 0, others] - alive[:, 0, -1:], removed[:, 1], removed[:, 2], shares[:, filters]]
    names = ["".join(letters[f] for f in order) for order in orders for _ in range(m)]
    return names, np.tile(np.arange(1, m + 1, dtype=np.int32), len(orders)), np.stack(found, axis=1)


def failed_masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], repeats: str | None, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a part and set of failed filters: part, mask, n, good, toxic. A filter's bit is its place among the names.

    ``conditions`` tell by a filter's name when a row fails it (null: it does not); the filter ``repeats``, named there
    with any column, is failed by a text that a smaller id has as well. Rows are brought down to id, part, mask and a
    digest before they are shuffled; copies of a text are combined by part and labels in each task first, so that no
    group of copies meets in one task but as one row a part.
    """
    names = list(conditions)
    bit = lambda c, k: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    mask = sum((bit(c, k) for k, (name, c) in enumerate(conditions.items()) if name != repeats), F.lit(0))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"), (F.unhex(F.sha2(text.cast("binary"), 256)) if repeats else F.lit(None).cast("binary")).alias("digest"),
    )
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    if repeats:
        # rows that repeat id and text become one, which counts them
        rows = rows.groupBy("id", "digest", *kind).agg(F.count("*").alias("n"))
        some = F.col("id").isNotNull()
        copies = rows.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(some, F.struct("id", "n"))).alias("least"))
        first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
        copies = copies.select(*kind, "n", (F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0)).alias("kept"))
        both = F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << names.index(repeats))).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
        rows = copies.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").filter("n > 0")
    else:
        rows = rows.withColumn("n", F.lit(1))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")])


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row a part, order of the filters and step, by the columns of ``failed_masks``; zeros included.

    Columns: part, filter_order, step and the counts ``COUNTS``: documents that the step keeps and removes; those that fail
    its filter but went before; those that fail it alone; good and toxic ones removed; what its filter removes over all
    orders. A part's counts, 2^m numbers, are one row. An empty table gives no rows.
    """
    small_batches(masks.sparkSession)
    size = 1 << len(letters)
    by_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PARTS):
                some = batch.slice(i, PARTS)
                flat, lens = some.column(1).flatten(), some.column(1).value_lengths().to_numpy(zero_copy_only=False)
                counts = np.zeros((len(lens), len(MEASURES), size), np.int64)
                row, at = np.repeat(np.arange(len(lens)), lens), flat.field("mask").to_numpy(zero_copy_only=False)
                for k, name in enumerate(MEASURES):
                    counts[row, k, at] = flat.field(name).to_numpy(zero_copy_only=False)
                orders, step, found = steps(survivors(counts), letters)
                parts = some.column(0).take(pa.array(np.repeat(np.arange(len(lens)), len(orders))))
                columns = [parts, pa.array(orders * len(lens)), pa.array(np.tile(step, len(lens))), *(pa.array(found[:, k].ravel()) for k in range(len(COUNTS)))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(work, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, a part being a source.

    Null texts are empty, null sources one part, the empty string. A null id has no smaller id and no labels; of ids
    with several labels one that says 1 decides. Rows that repeat id and text do not fail for each other. Texts are
    read whole, whatever their length.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.filter(F.split("text", WORDS, -1), lambda w: w != ""))
    size = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = {
        "A": size < 50,
        "B": F.size(F.array_distinct("words")).cast("long") * 100 < size.cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.length("text").cast("long") * 5,
        "D": F.col("text").rlike(MARKS),
        "E": F.lit(None),
    }
    return audit(failed_masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), conditions, "E"), "".join(conditions))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
g AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS mine,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, mine,
        sum(CASE WHEN mask & (before | mine) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & mine <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & mine <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = mine THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & mine <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & mine <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, mine)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, mine)::BIGINT AS shapley FROM r
"""
