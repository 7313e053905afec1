"""Queries on regions of moves and their certificates, and on normal forms of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import domains as X
from tessera.sources.fixture import OBJECTS, ROOM, scene_objects

REACH, MOST_GAP = 6.0, 1.0


def _domain(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf)
    return X.candidate_domain(d, X.distance_requests(d), ROOM, REACH)


def candidate_domain(spark: SparkSession, sf: str) -> DataFrame:
    return X.ledger(_domain(spark, sf))


def certified_moves(spark: SparkSession, sf: str) -> DataFrame:
    d = X.certify(_domain(spark, sf), MOST_GAP)
    return d.select("request_id", "subject_id", "reference_id", "relation_after", "status", *[F.round(c, 6).alias(c) for c in ("upper", "lower", "gap")])


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Results found twice: how many requests there are, and how many differ."""
    return X.replay_counts(certified_moves(spark, sf), certified_moves(spark, sf))


def camera_rebase(spark: SparkSession, sf: str) -> DataFrame:
    """The scene in the frame of the camera turned by one quarter."""
    d = X.rebase(scene_objects(spark, sf), 4.0, -2.0, 1)
    return d.select("scene_id", "object_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "ex", "ey")])


def cardinal_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes turned by 0, 90, 180, 270 or 45 degrees by their number."""
    d = scene_objects(spark, sf).withColumn("yaw", F.when(F.col("object_id") % 5 == 4, 45.0).otherwise((F.col("object_id") % 5) * 90.0))
    return X.without_cardinal_yaw(d).select("scene_id", "object_id", "cardinal", F.round("ex", 6).alias("ex"), F.round("ey", 6).alias("ey"), "yaw")


QUERIES = {
    "candidate_domain": (candidate_domain, None),
    "certified_moves": (certified_moves, None),
    "replayed_moves": (replayed, None),
    "camera_rebase": (camera_rebase, f"WITH {OBJECTS} SELECT scene_id, object_id, round(y + 2, 6) AS x, round(4 - x, 6) AS y, round(ey, 6) AS ex, round(ex, 6) AS ey FROM objects"),
    "cardinal_normal_form": (cardinal_normal_form, f"WITH {OBJECTS} SELECT scene_id, object_id, object_id % 5 <> 4 AS cardinal, round(CASE WHEN object_id % 5 IN (1, 3) THEN ey ELSE ex END, 6) AS ex, round(CASE WHEN object_id % 5 IN (1, 3) THEN ex ELSE ey END, 6) AS ey, CASE WHEN object_id % 5 = 4 THEN 45::DOUBLE ELSE 0::DOUBLE END AS yaw FROM objects"),
}
