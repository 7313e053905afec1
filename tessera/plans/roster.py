"""Queries on inventories, candidates, selection and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import relations as R
from tessera.operators import evidence as E
from tessera.operators import pairs as P
from tessera.operators import planning as L
from tessera.operators import roster as T
from tessera.sources.fixture import OBJECTS, scene_objects

from . import sql as S


def support_closure(spark: SparkSession, sf: str) -> DataFrame:
    return P.support_closure(T.support_edges(scene_objects(spark, sf))).select("scene_id", "child", "ancestor")


def support_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return T.cyclic_objects(scene_objects(spark, sf)).select("scene_id", "object_id")


def support_cycle_removal(spark: SparkSession, sf: str) -> DataFrame:
    d = T.without_cyclic_support(scene_objects(spark, sf))
    return d.filter("support_id IS NOT NULL").select("scene_id", "object_id", "support_id")


def children_by_support(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf).filter("support_id IS NOT NULL")
    return d.groupBy("scene_id", "support_id").agg(F.array_join(F.array_sort(F.collect_list("object_id")), ",").alias("children"))


def category_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf).withColumn("unique", F.count("*").over(Window.partitionBy("scene_id", "category")) == 1)
    return d.groupBy("category").agg(F.count_if("unique").alias("unique_objects"), F.count("*").alias("objects"))


def object_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return T.object_inventory(scene_objects(spark, sf)).select("scene_id", "object_id", "support_kind", "subject_state", "reference_eligible", F.coalesce("reason", F.lit("")).alias("reason"))


def candidate_states(spark: SparkSession, sf: str) -> DataFrame:
    return T.candidate_inventory(scene_objects(spark, sf)).groupBy("state", "relation", "s_support_kind").agg(F.count("*").alias("n")).withColumnRenamed("s_support_kind", "support_kind")


def roster_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = T.summary(T.candidate_inventory(scene_objects(spark, sf)))
    return d.select(F.coalesce("state", F.lit("*")).alias("state"), F.coalesce("relation", F.lit("*")).alias("relation"), "candidates", "scenes")


def rejections_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return T.rejection_counts(scene_objects(spark, sf))


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    return T.seeded_order(T.candidate_inventory(scene_objects(spark, sf)))


def seeded_order(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf).select("relation", "scene_id", F.col("s_object_id").alias("subject_id"), F.col("r_object_id").alias("reference_id"), "digest", "round")


def candidate_identity(spark: SparkSession, sf: str) -> DataFrame:
    d = T.candidate_inventory(scene_objects(spark, sf)).filter("state = 'PENDING'")
    return d.select("scene_id", F.concat(F.lit("candidate-"), F.sha2(F.concat_ws("|", "s_split", T.candidate_key(), "s_support_kind").cast("binary"), 256)).alias("candidate_id"))


def quota_selection(spark: SparkSession, sf: str) -> DataFrame:
    return T.select_with_quotas(T.candidate_inventory(scene_objects(spark, sf)))


def cap_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes are the sources, in shards of 32; each shard may hold 1000 candidates."""
    d = scene_objects(spark, sf).groupBy("scene_id").agg((F.count("*") * (F.count("*") - 1) * 6).alias("n"))
    d = d.select(F.floor(F.col("scene_id") / 32).cast("long").alias("shard"), F.col("scene_id").alias("source_index"), "n")
    return T.cap_prefix(d, 1000).select("shard", "source_index", "n", "accepted")


def relation_slots(spark: SparkSession, sf: str) -> DataFrame:
    return L.slots(_ordered(spark, sf)).select("slot_index", "relations", "status", "missing")


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return L.batches(_ordered(spark, sf)).select("slot_index", "size", "batch_id")


def camera_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = E.camera_scores(E.pose_views(scene_objects(spark, sf), E.pose_bank(E.reachable_positions(scene_objects(spark, sf)))))
    return d.select("scene_id", "pose_index", "movable_visible", "all_visible")


def camera_argmax(spark: SparkSession, sf: str) -> DataFrame:
    d = E.camera_scores(E.pose_views(scene_objects(spark, sf), E.pose_bank(E.reachable_positions(scene_objects(spark, sf)))))
    return E.best_pose(d).select("scene_id", "pose_index", "movable_visible", "all_visible")


def nearest_ring_position(spark: SparkSession, sf: str) -> DataFrame:
    d = E.ring_positions(E.reachable_positions(scene_objects(spark, sf)))
    return d.select("scene_id", "direction", F.round("px", 6).alias("px"), F.round("pz", 6).alias("pz"))


def camera_clearance(spark: SparkSession, sf: str) -> DataFrame:
    d = E.clear_positions(E.reachable_positions(scene_objects(spark, sf)), scene_objects(spark, sf), 0.25)
    return d.groupBy("scene_id").agg(F.count("*").alias("positions"))


def tolerance_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Object centres moved by half a micrometre or by three, bound to the unmoved ones within one."""
    d = scene_objects(spark, sf)
    shift = F.when(F.col("object_id") % 5 == 0, 3e-6).otherwise(5e-7)
    seen = d.select("scene_id", F.col("object_id").alias("oid"), (F.col("x") + shift).alias("x"), "y", "z")
    known = d.select("scene_id", F.col("object_id").alias("fid"), "x", "y", "z")
    return P.bind_within(seen, known, 1e-6).select("scene_id", "oid", "matches", F.coalesce("fid", F.lit(-1)).alias("fid"))


def patch_grid_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Grids of 21 x 21 native points for every scene's first object; scenes whose number 7 divides lack a point."""
    return E.patches(E.native_grid(scene_objects(spark, sf))).select("scene_id", "patch_index", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "z_min", "z_max")])


def endpoint_interleave(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists of points of each scene dealt in turn; the first owns points that both have; eight at most."""
    d = scene_objects(spark, sf)
    w = Window.partitionBy("scene_id")
    native = d.select("scene_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.row_number().over(w.orderBy("object_id")).alias("rank"))
    legacy = d.select("scene_id", F.round("y", 1).alias("x"), F.round("x", 1).alias("y"), F.row_number().over(w.orderBy(F.col("object_id").desc())).alias("rank"))
    return L.interleave(native, legacy, 8).select("scene_id", "position", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "origin")


def target_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose target relation some native position of the subject's scene would reach."""
    d = scene_objects(spark, sf)
    out = E.target_reachability(T.candidate_inventory(d).filter("state = 'PENDING'"), E.reachable_positions(d))
    return out.groupBy("relation", "status").agg(F.count("*").alias("candidates"), F.sum("reaching").alias("reaching"))


def obstacle_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Of each movable object, the others that its workspace of 1 m cannot touch, by the sum of half extents."""
    return L.obstacle_partition(scene_objects(spark, sf), 1.0).select("scene_id", "subject_id", "disjoint", "kept")


def support_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Where the centre of a box on a support may stand."""
    d = L.support_domain(scene_objects(spark, sf))
    return d.select("scene_id", "object_id", *[F.round(c, 6).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")], "empty")


def collision_domain(spark: SparkSession, sf: str) -> DataFrame:
    """The area that one obstacle takes from the moves of one subject, in the plain and the wider (cleared) bound."""
    d = L.collision_rectangles(scene_objects(spark, sf), 4.0)
    return d.groupBy("scene_id").agg(F.round(F.sum("outer_area"), 6).alias("outer_area"), F.round(F.sum("inner_area"), 6).alias("inner_area"), F.count("*").alias("obstacles"))


def target_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Inner and outer near and far sets of moves: whether staying in place is in each."""
    d = L.distance_brackets(scene_objects(spark, sf), R.NEAR_M)
    cols = ("near_inner", "near_outer", "far_inner", "far_outer")
    return d.groupBy("scene_id").agg(*[F.count_if(c).alias(c) for c in cols], F.count("*").alias("pairs"))


def bracket_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Three-valued sets by two booleans: intersection, union and complement, counted by outcome."""
    d = L.distance_brackets(scene_objects(spark, sf), R.NEAR_M)
    both = L.bracket_and(("near_inner", "near_outer"), L.bracket_not("far_inner", "far_outer"))
    either = L.bracket_or(("near_inner", "near_outer"), ("far_inner", "far_outer"))
    told = lambda b: F.when(b[0], "IN").when(~b[1], "OUT").otherwise("UNKNOWN")
    return d.select(told(both).alias("near_not_far"), told(either).alias("near_or_far")).groupBy("near_not_far", "near_or_far").agg(F.count("*").alias("n"))


def rectilinear_area(spark: SparkSession, sf: str) -> DataFrame:
    """Exact areas of union, pairwise intersection and difference of a scene's footprints, on the grid of their sides."""
    return L.rectilinear_areas(scene_objects(spark, sf)).select("scene_id", *[F.round(c, 6).alias(c) for c in ("union_area", "overlap_area", "alone_area")])


def interval_objective_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sums of intervals, the least margin and its deficit, and the certificate's gap."""
    d = L.interval_bounds(scene_objects(spark, sf))
    return d.select("scene_id", *[F.round(c, 5).alias(c) for c in ("lo", "hi", "slack", "deficit", "gap")])


def stress_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The schedule does not depend on the tables."""
    return L.stress_schedule(spark).select("seed", "direction", "raw_slot", "outcome", "transformed")


def stress_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes turned by 90 degrees about the room's middle and mirrored: distances must not change."""
    d = scene_objects(spark, sf)
    gap = P.unordered_pairs(d, ("x", "y", "ex", "ey")).withColumn("g", P.ground_gap()).groupBy("scene_id").agg(F.sum("g").alias("g"))
    turned = P.unordered_pairs(L.turn(d, 4.0, 4.0), ("x", "y", "ex", "ey")).withColumn("t", P.ground_gap()).groupBy("scene_id").agg(F.sum("t").alias("t"))
    mirrored = P.unordered_pairs(L.mirror(d, 4.0), ("x", "y", "ex", "ey")).withColumn("m", P.ground_gap()).groupBy("scene_id").agg(F.sum("m").alias("m"))
    same = lambda c: F.count_if(F.abs(F.col(c) - F.col("g")) < 1e-9)
    return gap.join(turned, "scene_id").join(mirrored, "scene_id").agg(F.count("*").alias("scenes"), same("t").alias("turned"), same("m").alias("mirrored"))


ORDERED = f"""{S.CANDIDATES},
pending AS (SELECT *, sha256('{T.SEED}|' || scene_id || ':' || s_id || ':' || r_id || ':' || relation) AS digest FROM candidates WHERE state = 'PENDING'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY relation, s_category, r_category, support_kind, scene_id ORDER BY digest, s_id, r_id) AS round FROM pending),
ranked AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY round, digest) - 1 AS slot_index FROM ordered)"""
POSITIONS = f"""{OBJECTS},
centre AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my FROM objects GROUP BY scene_id),
positions AS (SELECT c.scene_id, mx, my, round(mx * 2) / 2 + (i - 2) AS px, round(my * 2) / 2 + (j - 2) AS pz FROM centre c, range(0, 5) g(i), range(0, 5) h(j)),
ring AS (SELECT *, row_number() OVER (PARTITION BY scene_id, direction ORDER BY d2, px, pz) AS k FROM (
    SELECT p.*, d.direction, round((px - (mx + 2 * d.dx)) * (px - (mx + 2 * d.dx)) + (pz - (my + 2 * d.dz)) * (pz - (my + 2 * d.dz)), 9) AS d2 FROM positions p CROSS JOIN (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) d(direction, dx, dz))),
first_ring AS (SELECT scene_id, px, pz, min(direction) AS direction FROM ring WHERE k = 1 GROUP BY scene_id, px, pz),
poses AS (SELECT f.*, row_number() OVER (PARTITION BY scene_id ORDER BY direction) - 1 AS pose_index FROM first_ring f),
views AS (SELECT p.scene_id, p.pose_index, o.movable, count(*) OVER (PARTITION BY p.scene_id, p.pose_index, o.category) = 1 AS single, o.x - p.px AS right_, o.y - p.pz AS forward_ FROM poses p JOIN objects o ON o.scene_id = p.scene_id),
scores AS (SELECT scene_id, pose_index, count(*) FILTER (WHERE single AND movable AND forward_ > 0.1::DOUBLE AND abs(right_) <= forward_) AS movable_visible, count(*) FILTER (WHERE single AND forward_ > 0.1::DOUBLE AND abs(right_) <= forward_) AS all_visible FROM views GROUP BY ALL)"""
PAIR_BRACKETS = f"""{S.PAIRS}, b AS (SELECT scene_id, greatest(abs(sx - rx) - (sex + rex) / 2, 0::DOUBLE) AS gx, greatest(abs(sy - ry) - (sey + rey) / 2, 0::DOUBLE) AS gy FROM pairs),
brackets AS (SELECT scene_id, gx <= 0.25::DOUBLE AND gy <= 0.25::DOUBLE AS near_inner, gx <= 0.5::DOUBLE AND gy <= 0.5::DOUBLE AS near_outer, NOT (gx < 0.5::DOUBLE AND gy < 0.5::DOUBLE) AS far_inner, gx > 0 OR gy > 0 AS far_outer FROM b)"""

QUERIES = {
    "support_closure": (support_closure, f"WITH {S.CLOSURE} SELECT scene_id, child, ancestor FROM closure"),
    "support_cycles": (support_cycles, f"WITH {S.INVENTORY} SELECT scene_id, child AS object_id FROM cyclic"),
    "support_cycle_removal": (support_cycle_removal, f"WITH {S.INVENTORY} SELECT scene_id, object_id, support_id FROM facts WHERE support_id IS NOT NULL AND support_kind <> 'CYCLIC'"),
    "children_by_support": (children_by_support, f"WITH {OBJECTS} SELECT scene_id, support_id, array_to_string(list_sort(list(object_id)), ',') AS children FROM objects WHERE support_id IS NOT NULL GROUP BY ALL"),
    "category_uniqueness": (category_uniqueness, f"WITH {S.INVENTORY} SELECT category, count(*) FILTER (WHERE unique_category) AS unique_objects, count(*) AS objects FROM facts GROUP BY category"),
    "object_inventory": (object_inventory, f"""WITH {S.INVENTORY} SELECT scene_id, object_id, support_kind, subject_state, reference_eligible,
        CASE subject_state WHEN 'REJECTED_NOT_MOVABLE' THEN 'object:not_movable' WHEN 'REJECTED_PINNED' THEN 'object:pinned' WHEN 'REJECTED_HAS_DEPENDENT_CHILD' THEN 'object:has_dependent_child' WHEN 'REJECTED_UNKNOWN_SUPPORT' THEN 'object:support_cyclic' ELSE '' END AS reason FROM inventory"""),
    "candidate_states": (candidate_states, f"WITH {S.CANDIDATES} SELECT state, relation, support_kind, count(*) AS n FROM candidates GROUP BY ALL"),
    "roster_summary": (roster_summary, f"WITH {S.CANDIDATES} SELECT coalesce(state, '*') AS state, coalesce(relation, '*') AS relation, count(*) AS candidates, count(DISTINCT scene_id) AS scenes FROM candidates GROUP BY GROUPING SETS ((state), (relation), ())"),
    "rejections_by_stage": (rejections_by_stage, f"""WITH {S.CANDIDATES}, r AS (
        SELECT 'object_subject' AS stage, scene_id, CASE subject_state WHEN 'REJECTED_NOT_MOVABLE' THEN 'object:not_movable' WHEN 'REJECTED_PINNED' THEN 'object:pinned' WHEN 'REJECTED_HAS_DEPENDENT_CHILD' THEN 'object:has_dependent_child' ELSE 'object:support_cyclic' END AS reason FROM inventory WHERE subject_state LIKE 'REJECTED%'
        UNION ALL SELECT 'object_reference', scene_id, 'object:reference_ineligible' FROM inventory WHERE NOT reference_eligible
        UNION ALL SELECT 'candidate', scene_id, 'candidate:' || lower(substr(state, 10)) FROM candidates WHERE state LIKE 'REJECTED%') SELECT stage, reason, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM r GROUP BY ALL"""),
    "seeded_order": (seeded_order, f"WITH {ORDERED} SELECT relation, scene_id, s_id AS subject_id, r_id AS reference_id, digest, round FROM ordered"),
    "candidate_identity": (candidate_identity, f"WITH {S.CANDIDATES} SELECT scene_id, 'candidate-' || sha256(split || '|' || scene_id || ':' || s_id || ':' || r_id || ':' || relation || '|' || support_kind) AS candidate_id FROM candidates WHERE state = 'PENDING'"),
    "quota_selection": (quota_selection, None),
    "cap_prefix": (cap_prefix, f"""WITH RECURSIVE {OBJECTS}, src AS (SELECT scene_id // 32 AS shard, scene_id AS source_index, count(*) * (count(*) - 1) * 6 AS n, row_number() OVER (PARTITION BY scene_id // 32 ORDER BY scene_id) AS k FROM objects GROUP BY scene_id),
        walk AS (SELECT shard, source_index, n, k, n <= 1000 AS accepted, CASE WHEN n <= 1000 THEN n ELSE 0 END AS used FROM src WHERE k = 1
            UNION ALL SELECT s.shard, s.source_index, s.n, s.k, w.used + s.n <= 1000, CASE WHEN w.used + s.n <= 1000 THEN w.used + s.n ELSE w.used END FROM walk w JOIN src s ON s.shard = w.shard AND s.k = w.k + 1)
        SELECT shard, source_index, CAST(n AS BIGINT) AS n, accepted FROM walk"""),
    "relation_slots": (relation_slots, f"""WITH {ORDERED} SELECT slot_index, array_to_string(list_sort(list(relation)), ',') AS relations, CASE WHEN count(*) = 6 THEN 'ready' ELSE 'incomplete' END AS status, array_to_string(list_filter(['behind', 'far', 'front', 'left', 'near', 'right'], lambda v: NOT list_contains(list(relation), v)), ',') AS missing FROM ranked GROUP BY slot_index"""),
    "batches": (batches, f"WITH {ORDERED} SELECT slot_index, count(*) AS size, 'batch-' || sha256(array_to_string(list_sort(list(scene_id || ':' || s_id || ':' || r_id || ':' || relation)), ',')) AS batch_id FROM ranked GROUP BY slot_index"),
    "camera_scores": (camera_scores, f"WITH {POSITIONS} SELECT scene_id, pose_index, movable_visible, all_visible FROM scores"),
    "camera_argmax": (camera_argmax, f"WITH {POSITIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY movable_visible DESC, all_visible DESC, pose_index) AS k FROM scores) SELECT scene_id, pose_index, movable_visible, all_visible FROM b WHERE k = 1"),
    "nearest_ring_position": (nearest_ring_position, f"WITH {POSITIONS} SELECT scene_id, direction::BIGINT AS direction, round(px, 6) AS px, round(pz, 6) AS pz FROM first_ring"),
    "camera_clearance": (camera_clearance, f"""WITH {POSITIONS} SELECT scene_id, count(*) AS positions FROM positions p WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.scene_id = p.scene_id AND o.movable
        AND sqrt(greatest(abs(p.px - o.x) - o.ex / 2, 0::DOUBLE) * greatest(abs(p.px - o.x) - o.ex / 2, 0::DOUBLE) + greatest(abs(p.pz - o.y) - o.ey / 2, 0::DOUBLE) * greatest(abs(p.pz - o.y) - o.ey / 2, 0::DOUBLE)) <= 0.25::DOUBLE) GROUP BY scene_id"""),
    "tolerance_bind": (tolerance_bind, f"""WITH {OBJECTS}, seen_ AS (SELECT scene_id, object_id AS oid, x + CASE WHEN object_id % 5 = 0 THEN 3e-6 ELSE 5e-7 END AS x, y, z FROM objects),
        m AS (SELECT s.scene_id, s.oid, count(*) AS matches, min(o.object_id) AS fid FROM seen_ s JOIN objects o ON o.scene_id = s.scene_id AND sqrt((s.x - o.x) ** 2 + (s.y - o.y) ** 2 + (s.z - o.z) ** 2) <= 1e-6 GROUP BY ALL)
        SELECT s.scene_id, s.oid, coalesce(matches, 0) AS matches, coalesce(CASE WHEN matches = 1 THEN fid END, -1) AS fid FROM seen_ s LEFT JOIN m ON m.scene_id = s.scene_id AND m.oid = s.oid"""),
    "patch_grid_bounds": (patch_grid_bounds, f"""WITH {OBJECTS} SELECT scene_id, k AS patch_index, round(x - ex / 2 + k * 2, 6) AS x_min, round(x - ex / 2 + k * 2 + ex, 6) AS x_max, round(y - ey / 2, 6) AS z_min, round(y - ey / 2 + ey, 6) AS z_max FROM objects, range(0, 2) g(k) WHERE object_id = 1 AND scene_id % 7 <> 0"""),
    "endpoint_interleave": (endpoint_interleave, f"""WITH {OBJECTS}, a AS (SELECT scene_id, round(x, 1) AS x, round(y, 1) AS y, row_number() OVER (PARTITION BY scene_id ORDER BY object_id) AS rank, 0 AS origin FROM objects UNION ALL
        SELECT scene_id, round(y, 1), round(x, 1), row_number() OVER (PARTITION BY scene_id ORDER BY object_id DESC), 1 FROM objects),
        o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, x, y ORDER BY origin, rank) AS own FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY rank, origin) AS position FROM o WHERE own = 1)
        SELECT scene_id, position, x, y, CASE origin WHEN 0 THEN 'native' ELSE 'legacy' END AS origin FROM r WHERE position <= 8"""),
    "target_reachability": (target_reachability, f"""WITH {S.CANDIDATES}, centre AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my FROM objects GROUP BY scene_id),
        positions AS (SELECT c.scene_id, round(mx * 2) / 2 + (i - 2) AS px, round(my * 2) / 2 + (j - 2) AS pz FROM centre c, range(0, 5) g(i), range(0, 5) h(j)),
        tried AS (SELECT c.scene_id, c.s_id, c.r_id, c.relation, r.cx - ((p.px - 4) * 320 / (p.pz + 2) + 320) AS dx, r.depth - (p.pz + 2) AS dd, p.pz + 2 AS depth_, {S.gap('p.px', 'p.pz', 's.ex', 's.ey', 'r')} AS g
            FROM candidates c JOIN positions p ON p.scene_id = c.scene_id JOIN objects s ON s.scene_id = c.scene_id AND s.object_id = c.s_id JOIN objects r ON r.scene_id = c.scene_id AND r.object_id = c.r_id WHERE state = 'PENDING'),
        counted AS (SELECT scene_id, s_id, r_id, relation, count(*) FILTER (WHERE depth_ > 0.1::DOUBLE AND CASE relation WHEN 'right' THEN dx >= 32 WHEN 'left' THEN -dx >= 32 WHEN 'behind' THEN dd >= 0.2::DOUBLE WHEN 'front' THEN -dd >= 0.2::DOUBLE WHEN 'far' THEN g <= 0.5::DOUBLE ELSE g >= 1.5::DOUBLE END) AS reaching FROM tried GROUP BY ALL)
        SELECT relation, CASE WHEN reaching > 0 THEN 'REACHABLE_NATIVE_TARGET' ELSE 'NO_REACHABLE_NATIVE_TARGET' END AS status, count(*) AS candidates, CAST(sum(reaching) AS BIGINT) AS reaching FROM counted GROUP BY ALL"""),
    "obstacle_partition": (obstacle_partition, f"""WITH {S.PAIRS}, t AS (SELECT scene_id, s_id, least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2) <= 0 OR abs(sx - rx) > 1 + (sex + sey) / 2 + (rex + rey) / 2 OR abs(sy - ry) > 1 + (sex + sey) / 2 + (rex + rey) / 2 AS apart FROM pairs WHERE s_movable)
        SELECT scene_id, s_id AS subject_id, count(*) FILTER (WHERE apart) AS disjoint, count(*) FILTER (WHERE NOT apart) AS kept FROM t GROUP BY ALL"""),
    "support_domain": (support_domain, f"""WITH {OBJECTS} SELECT s.scene_id, s.object_id, round(h.x - h.ex / 2 + s.ex / 2, 6) AS x_lo, round(h.x + h.ex / 2 - s.ex / 2, 6) AS x_hi, round(h.y - h.ey / 2 + s.ey / 2, 6) AS y_lo, round(h.y + h.ey / 2 - s.ey / 2, 6) AS y_hi,
        h.x - h.ex / 2 + s.ex / 2 > h.x + h.ex / 2 - s.ex / 2 OR h.y - h.ey / 2 + s.ey / 2 > h.y + h.ey / 2 - s.ey / 2 AS empty FROM objects s JOIN objects h ON h.scene_id = s.scene_id AND h.object_id = s.support_id"""),
    "collision_domain": (collision_domain, f"""WITH {S.PAIRS}, t AS (SELECT p.scene_id, rx - sx AS cx, ry - sy AS cy, (sex + rex) / 2 AS hx, (sey + rey) / 2 AS hy, o.clearance AS c FROM pairs p JOIN objects o ON o.scene_id = p.scene_id AND o.object_id = p.r_id WHERE s_movable AND least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2) > 0),
        a AS (SELECT scene_id, {', '.join(f"greatest(least(cx + hx + {c}, 4) - greatest(cx - hx - {c}, -4), 0::DOUBLE) * greatest(least(cy + hy + {c}, 4) - greatest(cy - hy - {c}, -4), 0::DOUBLE) AS {n}" for c, n in (('0', 'q0'), ('c', 'q1')))} FROM t)
        SELECT scene_id, round(sum(64 - q0), 6) AS outer_area, round(sum(64 - q1), 6) AS inner_area, count(*) AS obstacles FROM a GROUP BY scene_id"""),
    "target_domain": (target_domain, f"WITH {PAIR_BRACKETS} SELECT scene_id, {', '.join(f'count(*) FILTER (WHERE {c}) AS {c}' for c in ('near_inner', 'near_outer', 'far_inner', 'far_outer'))}, count(*) AS pairs FROM brackets GROUP BY scene_id"),
    "bracket_algebra": (bracket_algebra, f"""WITH {PAIR_BRACKETS} SELECT CASE WHEN near_inner AND NOT far_outer THEN 'IN' WHEN NOT (near_outer AND NOT far_inner) THEN 'OUT' ELSE 'UNKNOWN' END AS near_not_far,
        CASE WHEN near_inner OR far_inner THEN 'IN' WHEN NOT (near_outer OR far_outer) THEN 'OUT' ELSE 'UNKNOWN' END AS near_or_far, count(*) AS n FROM brackets GROUP BY ALL"""),
    "rectilinear_area": (rectilinear_area, f"""WITH {OBJECTS}, r AS (SELECT scene_id, round((x - ex / 2) * 10000)::BIGINT AS x0, round((x + ex / 2) * 10000)::BIGINT AS x1, round((y - ey / 2) * 10000)::BIGINT AS y0, round((y + ey / 2) * 10000)::BIGINT AS y1 FROM objects),
        xs AS (SELECT scene_id, v, lead(v) OVER (PARTITION BY scene_id ORDER BY v) AS w FROM (SELECT scene_id, x0 AS v FROM r UNION SELECT scene_id, x1 FROM r)), ys AS (SELECT scene_id, v, lead(v) OVER (PARTITION BY scene_id ORDER BY v) AS w FROM (SELECT scene_id, y0 AS v FROM r UNION SELECT scene_id, y1 FROM r)),
        cells AS (SELECT xs.scene_id, (xs.w - xs.v) * (ys.w - ys.v) AS a, (SELECT count(*) FROM r WHERE r.scene_id = xs.scene_id AND r.x0 <= xs.v AND r.x1 >= xs.w AND r.y0 <= ys.v AND r.y1 >= ys.w) AS k FROM xs JOIN ys ON xs.scene_id = ys.scene_id WHERE xs.w IS NOT NULL AND ys.w IS NOT NULL)
        SELECT scene_id, round(sum(CASE WHEN k > 0 THEN a ELSE 0 END) / 1e8, 6) AS union_area, round(sum(CASE WHEN k > 1 THEN a ELSE 0 END) / 1e8, 6) AS overlap_area, round(sum(CASE WHEN k = 1 THEN a ELSE 0 END) / 1e8, 6) AS alone_area FROM cells GROUP BY scene_id"""),
    "interval_objective_bounds": (interval_objective_bounds, f"""WITH {OBJECTS}, t AS (SELECT scene_id, 1::DOUBLE / (object_id + 1) AS w, greatest(0::DOUBLE, x - 4, -x - ex) AS lo, abs(x) + ex AS hi, (ez - 0.35::DOUBLE) / 0.35::DOUBLE AS m FROM objects)
        SELECT scene_id, round(sum(w * lo), 5) AS lo, round(sum(w * hi), 5) AS hi, round(min(m), 5) AS slack, round(greatest(0::DOUBLE, 0.5::DOUBLE - min(m)), 5) AS deficit, round(min(hi) - min(lo), 5) AS gap FROM t GROUP BY scene_id"""),
    "stress_schedule": (stress_schedule, f"""WITH s AS (SELECT seed, direction, raw_slot, CASE WHEN raw_slot < 60 THEN 'SAT' ELSE 'UNSAT' END AS outcome, sha256(seed || '|' || direction || '|' || raw_slot) AS h
            FROM range(2026080200, 2026080210) a(seed), (VALUES ('fb'), ('lr'), ('nf')) d(direction), range(0, 100) b(raw_slot)),
        r AS (SELECT *, row_number() OVER (PARTITION BY seed, direction, outcome ORDER BY h) AS k FROM s) SELECT seed, direction, raw_slot, outcome, k <= CASE outcome WHEN 'SAT' THEN 18 ELSE 12 END AS transformed FROM r"""),
    "stress_transforms": (stress_transforms, f"WITH {S.PAIRS} SELECT count(DISTINCT scene_id) AS scenes, count(DISTINCT scene_id) AS turned, count(DISTINCT scene_id) AS mirrored FROM pairs"),
}
