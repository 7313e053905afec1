"""Queries on outcomes, publication and exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as C
from tessera.operators import moves as M
from tessera.operators import pairs as P
from tessera.operators import planning as L
from tessera.operators import roster as T
from tessera.sources import dataset as D
from tessera.sources.fixture import OBJECTS, ROOM, scene_objects

from . import sql as S
from .scenes import MIRROR, _mirror_moves


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The mirror move of every request as an outcome: errors of the scene reject in planning, others in execution."""
    d = scene_objects(spark, sf)
    v = M.verify(d, _mirror_moves(d), ROOM)
    reason = F.when(F.col("errors") != "", F.regexp_extract("errors", "^([a-z_]+)", 1)).otherwise(F.lower("status"))
    return v.select("request_id", "relation_after", F.when(F.col("status") == "INVALID_SCENE", "planning").otherwise("execution").alias("stage"), (F.col("status") == "SUCCESS").alias("accepted"), reason.alias("reason"))


def terminal_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return D.terminal_reasons(_outcomes(spark, sf))


def generation_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.report(_outcomes(spark, sf))


def inspect_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).filter("accepted").groupBy("relation_after").agg(F.count("*").alias("records"))


def attempt_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every request is planned; those of scenes that 10 divides are attempted twice, of those after them not at all."""
    planned = M.all_requests(scene_objects(spark, sf)).select("request_id", "scene_id")
    tries = planned.filter("scene_id % 10 <> 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("scene_id") % 10 == 0, 2).otherwise(1))))
    return D.attempt_closure(planned, tries)


def reference_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose part, supplier or order is not there, and orders without a line."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    line, orders = read("lineitem"), read("orders")
    found = D.missing_references(line, "l_partkey", read("part"), "p_partkey", "part").unionByName(D.missing_references(line, "l_suppkey", read("supplier"), "s_suppkey", "supplier")).unionByName(D.missing_references(line, "l_orderkey", orders, "o_orderkey", "order")).unionByName(D.missing_references(orders, "o_orderkey", line, "l_orderkey", "line"))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def checksum_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger line a scene; whether the names, in order of scenes as text, go up."""
    d = scene_objects(spark, sf).groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "object_id", "category"))), ";").alias("roster"))
    return d.select("scene_id", F.concat(F.sha2(F.col("roster").cast("binary"), 256), F.lit("  "), F.lit("scene-"), F.lpad(F.col("scene_id").cast("string"), 8, "0")).alias("line"))


def dataset_tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest for each split over its scenes' digests in order."""
    d = scene_objects(spark, sf).groupBy("split", "scene_id").agg(F.count("*").alias("n"))
    told = F.concat_ws(":", "scene_id", "n")
    # digests of blocks of scenes first, so that no list is longer than a block
    blocks = d.groupBy("split", F.floor(F.col("scene_id") / 1000).cast("long").alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_id", told.alias("t")))), lambda x: x["t"]), "\n").cast("binary"), 256).alias("h"))
    return blocks.groupBy("split").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n").cast("binary"), 256).alias("digest"), F.count("*").alias("blocks"))


def hash_sampler(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf).select("scene_id", "object_id")
    label = F.concat_ws(":", "scene_id", "object_id")
    return d.select("scene_id", "object_id", C.hash_integer("sample", label, 1000).alias("number"))


def quantised_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of 1 cm, halves to the even one, and how many objects of a scene share a key."""
    d = scene_objects(spark, sf).select("scene_id", F.bround(F.col("x") * 40).cast("long").alias("kx"), F.bround(F.col("y") * 40).cast("long").alias("ky"))
    return d.groupBy("scene_id", "kx", "ky").agg(F.count("*").alias("objects"))


def proven_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Contact of every unordered pair by gaps along height and sides, with a margin for contact."""
    d = P.unordered_pairs(scene_objects(spark, sf), ("x", "y", "z", "ex", "ey", "ez"))
    gx = F.abs(P.c("s", "x") - P.c("r", "x")) - (P.c("s", "ex") + P.c("r", "ex")) / 2
    gy = F.abs(P.c("s", "y") - P.c("r", "y")) - (P.c("s", "ey") + P.c("r", "ey")) / 2
    gap, dz = F.greatest(gx, gy), -P.z_overlap()
    state = F.when((dz > 1e-9) | (gap > 1e-9), "PROVEN_SEPARATED").when((dz < -1e-9) & (gap < -1e-9), "PROVEN_CLOSED_INTERSECTION").otherwise("UNKNOWN")
    return d.select("scene_id", state.alias("state")).groupBy("scene_id", "state").agg(F.count("*").alias("n"))


def translation_cell_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The least and greatest distance from the origin to each object's rectangle of moves."""
    d = scene_objects(spark, sf)
    lo, hi = L.cell_distance(F.col("x") - 4 - F.col("ex"), F.col("x") - 4 + F.col("ex"), F.col("y") - 4 - F.col("ey"), F.col("y") - 4 + F.col("ey"))
    return d.select("scene_id", "object_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def support_lineage(spark: SparkSession, sf: str) -> DataFrame:
    d = T.object_inventory(scene_objects(spark, sf))
    return d.groupBy("support_kind", "subject_state").agg(F.count("*").alias("objects"), F.count_distinct("scene_id").alias("scenes"))


def directed_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Sure bounds of sine and cosine of whole degrees made of the part sizes: how far they are apart at most, and whether they hold the built-in values."""
    d = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") * 7 % 360).cast("double").alias("deg")).distinct()
    d = d.withColumn("b", C.directed_turn("deg"))
    s, c = F.sin(F.radians("deg")), F.cos(F.radians("deg"))
    holds = (F.col("b.sin_lo") <= s + 1e-15) & (s - 1e-15 <= F.col("b.sin_hi")) & (F.col("b.cos_lo") <= c + 1e-15) & (c - 1e-15 <= F.col("b.cos_hi"))
    narrow = (F.col("b.sin_hi") - F.col("b.sin_lo") < 1e-15) & (F.col("b.cos_hi") - F.col("b.cos_lo") < 1e-15)
    return d.agg(F.count("*").alias("angles"), F.count_if(holds).alias("holding"), F.count_if(narrow).alias("narrow"))


def slot_window(spark: SparkSession, sf: str) -> DataFrame:
    """Selection indexes from 0 within each scene, by category and number."""
    w = Window.partitionBy("scene_id").orderBy("category", "object_id")
    return scene_objects(spark, sf).select("scene_id", "object_id", (F.row_number().over(w) - 1).cast("long").alias("selection_index"))


OUT = f"""{MIRROR}, outcomes AS (SELECT {S.KEY} AS request_id, rel_after AS relation_after, CASE WHEN status = 'INVALID_SCENE' THEN 'planning' ELSE 'execution' END AS stage, status = 'SUCCESS' AS accepted,
    CASE WHEN errors <> '' THEN regexp_extract(errors, '^([a-z_]+)', 1) ELSE lower(status) END AS reason FROM scored)"""
QUERIES = {
    "terminal_reasons": (terminal_reasons, f"WITH {OUT} SELECT stage || ':' || reason AS reason, count(*) AS n FROM outcomes WHERE NOT accepted GROUP BY ALL"),
    "generation_report": (generation_report, f"WITH {OUT} SELECT count(*) AS frozen_requests, count(*) FILTER (WHERE stage <> 'planning') AS planned_requests, count(*) FILTER (WHERE stage = 'planning') AS planning_rejected, count(*) FILTER (WHERE accepted) AS accepted_requests, count(*) FILTER (WHERE stage <> 'planning' AND NOT accepted) AS execution_rejected FROM outcomes"),
    "inspect_summary": (inspect_summary, f"WITH {OUT} SELECT relation_after, count(*) AS records FROM outcomes WHERE accepted GROUP BY ALL"),
    "attempt_closure": (attempt_closure, f"WITH {S.REQUESTS} SELECT {S.KEY} AS request_id, CASE scene_id % 10 WHEN 0 THEN 'repeated' ELSE 'missing' END AS finding FROM requests WHERE scene_id % 10 IN (0, 1)"),
    "reference_closure": (reference_closure, """SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'part' AS kind, l_partkey AS v FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT DISTINCT 'supplier', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT DISTINCT 'order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT DISTINCT 'line', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY kind"""),
    "checksum_ledger": (checksum_ledger, f"WITH {OBJECTS} SELECT scene_id, sha256(array_to_string(list_sort(list(object_id || ':' || category)), ';')) || '  scene-' || lpad(CAST(scene_id AS VARCHAR), 8, '0') AS line FROM objects GROUP BY scene_id"),
    "dataset_tree_digest": (dataset_tree_digest, f"""WITH {OBJECTS}, s AS (SELECT split, scene_id, count(*) AS n FROM objects GROUP BY ALL), b AS (SELECT split, scene_id // 1000 AS block, sha256(string_agg(scene_id || ':' || n, chr(10) ORDER BY scene_id)) AS h FROM s GROUP BY ALL)
        SELECT split, sha256(string_agg(h, chr(10) ORDER BY block)) AS digest, count(*) AS blocks FROM b GROUP BY split"""),
    "hash_sampler": (hash_sampler, f"WITH {OBJECTS} SELECT scene_id, object_id, CAST(CAST(CAST('0x' || substr(sha256('sample' || chr(0) || scene_id || ':' || object_id), 1, 16) AS UBIGINT) AS HUGEINT) % 1000 AS BIGINT) AS number FROM objects"),
    "quantised_positions": (quantised_positions, f"WITH {OBJECTS} SELECT scene_id, round_even(x * 40, 0)::BIGINT AS kx, round_even(y * 40, 0)::BIGINT AS ky, count(*) AS objects FROM objects GROUP BY ALL"),
    "proven_disjoint": (proven_disjoint, f"""WITH {S.PAIRS}, t AS (SELECT scene_id, greatest(abs(sx - rx) - (sex + rex) / 2, abs(sy - ry) - (sey + rey) / 2) AS g, -(least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2)) AS dz FROM pairs WHERE s_id < r_id)
        SELECT scene_id, CASE WHEN dz > 1e-9 OR g > 1e-9 THEN 'PROVEN_SEPARATED' WHEN dz < -1e-9 AND g < -1e-9 THEN 'PROVEN_CLOSED_INTERSECTION' ELSE 'UNKNOWN' END AS state, count(*) AS n FROM t GROUP BY ALL"""),
    "translation_cell_bounds": (translation_cell_bounds, f"""WITH {OBJECTS}, t AS (SELECT scene_id, object_id, x - 4 - ex AS a, x - 4 + ex AS b, y - 4 - ey AS c, y - 4 + ey AS d FROM objects) SELECT scene_id, object_id, round(sqrt(greatest(0::DOUBLE, a, -b) ** 2 + greatest(0::DOUBLE, c, -d) ** 2), 6) AS lo, round(sqrt(greatest(abs(a), abs(b)) ** 2 + greatest(abs(c), abs(d)) ** 2), 6) AS hi FROM t"""),
    "support_lineage": (support_lineage, f"WITH {S.INVENTORY} SELECT support_kind, subject_state, count(*) AS objects, count(DISTINCT scene_id) AS scenes FROM inventory GROUP BY ALL"),
    "directed_rotation": (directed_rotation, "WITH t AS (SELECT DISTINCT p_size * 7 % 360 AS d FROM part) SELECT count(*) AS angles, count(*) AS holding, count(*) AS narrow FROM t"),
    "selection_index": (slot_window, f"WITH {OBJECTS} SELECT scene_id, object_id, row_number() OVER (PARTITION BY scene_id ORDER BY category, object_id) - 1 AS selection_index FROM objects"),
}
