"""The stages of the corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing and sharding.

Each stage takes all that its predecessor kept, with any columns, and returns the same columns (the last adds slot and
shard). What nulls, empty texts, ties, repeated rows and empty tables give is told by the operator that a stage calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, mixing, sharding, toxicity
from .common import cut, discard, free_name
from .ngram_join import JaccardJoin


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("__score", docs.columns)
    return toxicity.score_documents(docs, model, out_col=score).filter(F.col(score) < 0.5).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the least id stays."""
    return JaccardJoin(docs, words=5, threshold="0.8").run().one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    hits = free_name("__hits", docs.columns)
    found = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), out_col=hits)
    return found.filter(F.size(hits) == 0).drop(hits)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard."""
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Toxicity and decontamination have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's input goes when its output is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
