"""Exact deduplication of a stream with disk-backed keyed state that never expires.

The state is keyed by the SHA-256 of the normalised text and keeps, in a RocksDB store checkpointed to the shared
folder, the number of rows seen, the stable identifier of the row that stays and the locator of its content
(file and row number). Rows are combined in each task before they are dealt by digest, so a text that a third of
all rows share costs one row a task. A digest seen before counts as a hit only after the full bytes agree: the
texts under such digests are compared whole, and a digest that stands for several texts is split by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, shared_path

#: Digests that may be broadcast, at 32 bytes each; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamingDedup:
    """Keeps, of the rows of a growing folder of Parquet files that have equal texts, the one with the largest id.

    ``advance()`` takes in what the folder has gained since the last call, by micro-batches of at most
    ``files_per_batch`` files; ``result()`` tells each row of the folder what became of it. The state lies under
    ``location`` in the shared folder; a new object on the same location goes on from there.

    A null text counts as empty; a null id is below every other. Of rows that repeat the largest id, the one
    last in order of file and row number stays. ``digest`` is a parameter so that tests can make it collide.
    """

    def __init__(self, spark: SparkSession, path: str, location: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000):
        self.spark, self.path, self.digest, self.files = spark, path, digest, files_per_batch
        self.location = location or shared_path(spark, "dedup-state")
        self.id, self.text = id_col, text_col

    def _rows(self, source: DataFrame) -> DataFrame:
        text = lower_ascii(F.coalesce(F.col(self.text), F.lit("")))
        return source.select(F.col(self.id).alias("id"), text.alias("norm"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")).withColumn("digest", self.digest(F.col("norm")))

    def advance(self) -> None:
        conf = self.spark.conf
        # without preallocated logs: with many partitions these would be larger than the state
        wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
        before = {k: conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            schema = self.spark.read.parquet(self.path).schema
            path = self.path.rstrip("/")
            # a pattern that fits this path alone: a stream takes a single file only by a pattern
            stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files).option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")
            state = self._rows(stream).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"))
            query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.location).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def state(self) -> DataFrame:
        """One row a digest: digest, n, keep (id, locator)."""
        return self.spark.read.format("statestore").load(self.location).select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("keep"))

    def _split(self, state: DataFrame) -> DataFrame:
        """Per digest and text of the digests that stand for several texts: digest, norm, n, keep. Usually empty."""
        hits = state.filter("n > 1").select("digest")
        many = hits.limit(BROADCAST_DIGESTS + 1).count() > BROADCAST_DIGESTS
        rows = self._rows(self.spark.read.parquet(self.path)).join(hits if many else F.broadcast(hits), "digest", "left_semi")
        texts = rows.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"))
        # one fixed-size row a text goes on, so that the texts move once
        narrow = texts.select("digest", F.length("norm").alias("size"), "n", "keep")
        several = cut(narrow.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "dedup-several")
        return cut(texts.join(several, "digest", "left_semi"), "dedup-split") if several.limit(1).count() else texts.limit(0)

    def result(self) -> DataFrame:
        """One row a row of the folder: id, digest, n, keep_id, kept."""
        state = cut(self.state(), "dedup-table")
        split = self._split(state)
        rows = self._rows(self.spark.read.parquet(self.path))
        whole = state
        found = []
        if split.limit(1).count():
            several = split.select("digest").distinct()
            whole = state.join(several, "digest", "left_anti")
            found.append(rows.join(split, ["digest", "norm"]).select("id", "locator", "digest", "n", "keep"))
        found.insert(0, rows.select("id", "locator", "digest").join(whole, "digest").select("id", "locator", "digest", "n", "keep"))
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return out.select("id", "digest", "n", F.col("keep.id").alias("keep_id"), (F.col("locator") == F.col("keep.locator")).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = StreamingDedup(spark, f"{sf_dir}/documents.parquet")
    dedup.advance()
    return dedup.result().select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
