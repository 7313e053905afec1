"""Incremental campaigns: requests that arrive as files are executed once, whatever is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has ended well: only then it has a success marker."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def run_missing(spark: SparkSession, requests: str, done: str, execute: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Executes the requests (Parquet files under ``requests``, with a request_id) that ``done`` has no row of, and appends their outcomes there.

    Each micro-batch leaves out what is done already, so a batch that is repeated after a failure adds nothing twice.
    """
    schema = spark.read.parquet(requests).schema

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(["request_id"])
        if finished(spark, done):
            fresh = fresh.join(spark.read.parquet(done).select("request_id"), "request_id", "left_anti")
        execute(fresh).write.mode("append").parquet(done)

    query = spark.readStream.schema(schema).parquet(requests).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
