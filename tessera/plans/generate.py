"""The batch pipeline: config to scenes, roster, plan, and published dataset. Stage tables are the points to go on from."""

from __future__ import annotations

import hashlib
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import canonical_json_text
from tessera.operators import moves as M
from tessera.operators import roster as T
from tessera.sources.config import GenerationConfig
from tessera.sources.dataset import DatasetManifest, inspect_dataset, publish_dataset, verify_dataset
from tessera.sources.fixture import ROOM
from tessera.streaming.campaign import finished


def config_digest(config: GenerationConfig) -> str:
    return hashlib.sha256(canonical_json_text(asdict(config)).encode()).hexdigest()


def stage(spark: SparkSession, path: str, build, key: str) -> DataFrame:
    """The stage's table if it was written whole under this key, else built and written now, in place of what a broken write left."""
    at = f"{path}/key={key}"
    if not finished(spark, at):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def plan(objects: DataFrame, requests: DataFrame, room: tuple[float, float, float, float] = ROOM, steps: tuple[float, ...] = M.STEPS) -> DataFrame:
    """A row a request: the cheapest allowed move, or the stage and reason of its rejection."""
    best = M.solve(objects, requests, room, strict=False, steps=steps)
    d = requests.join(best.select("request_id", "new_x", "new_y", "total"), "request_id", "left")
    return d.withColumns({"accepted": F.col("new_x").isNotNull(), "stage": F.when(F.col("new_x").isNull(), "planning").otherwise("execution"), "reason": F.when(F.col("new_x").isNull(), "no_certified_endpoint").otherwise("accepted")})


def selected_requests(objects: DataFrame, config: GenerationConfig) -> DataFrame:
    quotas = T.QUOTAS | {"total": min(config.max_requests, T.QUOTAS["total"])}
    from tessera.functions import relations as R

    d = T.select_with_quotas(T.candidate_inventory(objects), quotas, config.seed)
    return d.select(F.concat(F.lit("request-"), F.sha2(F.concat_ws("|", F.lit(str(config.seed)), "selection_index", "scene_id", "s_object_id", "r_object_id", "relation").cast("binary"), 256)).alias("request_id"), "selection_index", "scene_id", F.col("s_object_id").alias("subject_id"), F.col("r_object_id").alias("reference_id"), F.col("relation").alias("relation_before"), R.lookup(R.OPPOSITE, F.col("relation")).alias("relation_after"))


def records(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("accepted").select(F.lit(1).alias("record_version"), "request_id", "scene_id", "subject_id", "reference_id", "relation_before", "relation_after", "new_x", "new_y", "total")


def generate_dataset(spark: SparkSession, objects: DataFrame, config: GenerationConfig, root: str | Path, work: str) -> DatasetManifest:
    """Selects, plans and publishes; a run that broke off goes on from the stages under ``work`` that were finished."""
    key = config_digest(config)
    requests = stage(spark, f"{work}/requests", lambda: selected_requests(objects, config), key)
    outcomes = stage(spark, f"{work}/outcomes", lambda: plan(objects, requests), key)
    return publish_dataset(records(outcomes), outcomes, key, root)


__all__ = ["generate_dataset", "inspect_dataset", "verify_dataset"]
