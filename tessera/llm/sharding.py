"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table. The shards take turns, in
the order of their number, and each claims the free slot that it prefers most, until no slot is free. A row's
key is hashed to a slot; the table, which has a fixed size whatever the rows, is broadcast, so that a row finds
its shard by one lookup. A shard more or less moves few of the other shards' slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 16381


def preference(shard: str, slots: int) -> tuple[int, int]:
    """The first slot that a shard prefers and its step; the slots being prime, the steps visit them all."""
    d = hashlib.md5(shard.encode()).hexdigest()
    return int(d[:15], 16) % slots, int(d[15:30], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot.

    >>> sorted(set(lookup_table(["a", "b", "c"], 13)))
    [0, 1, 2]
    """
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be prime: {slots}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, one at least and no more than there are slots")
    table, free = [-1] * slots, slots
    state = [list(preference(s, slots)) for s in shards]
    while free:
        for k, x in enumerate(state):
            while table[x[0]] >= 0:
                x[0] = (x[0] + x[1]) % slots
            table[x[0]] = k
            free -= 1
            if not free:
                break
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` added (one of either name is replaced).

    A row's slot is the first 60 bits of the MD5 of its key as text, modulo the number of slots; a null key
    counts as empty text. Equal keys get equal shards, so repeated rows stay together; an empty table stays
    empty. No row moves: the table is broadcast, its size is fixed by ``slots``.
    """
    spark = df.sparkSession
    table = lookup_table(shards or shard_names(SHARDS), slots)
    rows = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "shard"))
    rows = rows.select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"))
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*keep, slot.alias("slot")).join(F.broadcast(rows), "slot", "left").select(*keep, "slot", "shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


def op6_sql() -> str:
    table = ",".join(map(str, lookup_table(shard_names(SHARDS), SLOTS)))
    return f"""
    WITH t AS (SELECT [{table}] AS shards),
         d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
    SELECT doc_id, slot, CAST(shards[slot + 1] AS BIGINT) AS shard FROM d, t
    """
