"""Queries on scenes, pairs, relations and moves."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import camera as K
from tessera.functions import geometry as G
from tessera.functions import relations as R
from tessera.operators import moves as M
from tessera.operators import pairs as P
from tessera.sources.fixture import OBJECTS, ROOM, scene_objects

from . import sql as S

GEOMETRY = ("x", "y", "z", "ex", "ey", "ez", "cx", "depth", "visible_fraction", "image_area_fraction", "truncated_fraction")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _zero(c, digits: int):
    """Rounded, with numbers that differ from 0 by less than any engine's last digits as 0 itself."""
    return F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.round(c, digits))


def _zero_sql(e: str, digits: int) -> str:
    return f"CASE WHEN abs({e}) < 1e-9 THEN 0::DOUBLE ELSE round({e}, {digits}) END"


def scene_table(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf)
    return d.select("scene_id", "object_id", "category", *[_r(c) for c in GEOMETRY], "movable", "pinned", F.coalesce("support_id", F.lit(0)).alias("support_id"), "split")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_relations(P.ordered_pairs(scene_objects(spark, sf), GEOMETRY))


def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = P.observations(P.ordered_pairs(scene_objects(spark, sf), GEOMETRY))
    return d.groupBy("relation").agg(F.count_if("satisfied").alias("holds"), F.count_if(F.col("status") == "SUCCESS").alias("decided"), F.count("*").alias("pairs"))


def relation_status_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    d = P.observations(P.ordered_pairs(scene_objects(spark, sf), GEOMETRY))
    return d.groupBy("relation", "status", "satisfied").agg(F.count("*").alias("n"))


def relation_margin_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = P.observations(P.ordered_pairs(scene_objects(spark, sf), GEOMETRY)).filter("status = 'SUCCESS'")
    return d.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.min("margin"), 6).alias("least"), F.round(F.max("margin"), 6).alias("most"), F.round(F.avg("margin"), 4).alias("mean"))


def pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("scene_id", F.col("s_object_id").alias("subject_id"), F.col("r_object_id").alias("reference_id"), F.array_join("labels", ",").alias("labels"))


def relation_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The scene's graph as a map of 'subject:reference' to labels, told as its number of keys and a digest of its entries."""
    key = F.concat_ws(":", "s_object_id", "r_object_id")
    graph = _labelled(spark, sf).groupBy("scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.array_join("labels", ",").alias("v"))))).alias("g"))
    told = F.array_join(F.transform(F.map_entries("g"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return graph.select("scene_id", F.size("g").cast("long").alias("pairs"), F.sha2(told.cast("binary"), 256).alias("digest"))


def relation_graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).withColumn("relation", F.explode("labels"))
    return d.groupBy("scene_id", F.col("s_object_id").alias("subject_id"), "relation").agg(F.count("*").alias("degree"))


def converse_check(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).select("scene_id", "s_object_id", "r_object_id", "labels")
    back = d.select("scene_id", F.col("r_object_id").alias("s_object_id"), F.col("s_object_id").alias("r_object_id"), F.col("labels").alias("reverse"))
    both = d.join(back, ["scene_id", "s_object_id", "r_object_id"])
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("reverse") == R.converses(F.col("labels"))).alias("consistent"))


def axis_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    rows = [F.struct(F.lit(a).alias("axis"), F.array_join(R.on_axis(F.col("labels"), a), ",").alias("labels")) for a in R.AXES]
    return d.select(F.explode(F.array(*rows)).alias("o")).groupBy("o.axis", "o.labels").agg(F.count("*").alias("n"))


def ground_gap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = P.unordered_pairs(scene_objects(spark, sf), GEOMETRY).withColumn("gap", P.ground_gap())
    return d.groupBy(F.floor(F.round(F.col("gap"), 6) * 2).cast("long").alias("half_metres")).agg(F.count("*").alias("n"), F.round(F.max("gap"), 6).alias("most"))


def polygon_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The general polygon distance and overlap area on boxes along the axes, where closed forms check them."""
    d = P.unordered_pairs(scene_objects(spark, sf), GEOMETRY)
    a, b = (G.footprint(P.c(p, "x"), P.c(p, "y"), P.c(p, "ex"), P.c(p, "ey")) for p in ("s", "r"))
    d = d.select("scene_id", "s_object_id", "r_object_id", G.gap(a, b).alias("gap"), G.overlap_area(a, b).alias("area"))
    return d.groupBy("scene_id").agg(F.round(F.sum("gap"), 6).alias("gap"), F.round(F.sum("area"), 6).alias("area"), F.count("*").alias("pairs"))


def obb_collisions(spark: SparkSession, sf: str) -> DataFrame:
    d = P.unordered_pairs(scene_objects(spark, sf), GEOMETRY).filter(P.collides())
    return d.select("scene_id", F.col("s_object_id").alias("a_id"), F.col("r_object_id").alias("b_id"), F.round(P.box_intersection(), 6).alias("area"), F.round(P.z_overlap(), 6).alias("depth"))


def z_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = P.unordered_pairs(scene_objects(spark, sf), GEOMETRY).withColumn("dz", P.z_overlap())
    return d.groupBy("scene_id").agg(F.count_if(F.col("dz") > G.CONTACT).alias("overlapping"), F.round(F.max("dz"), 6).alias("most"))


def inside_room(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf)
    room = G.polygon((ROOM[0], ROOM[1]), (ROOM[2], ROOM[1]), (ROOM[2], ROOM[3]), (ROOM[0], ROOM[3]))
    small = G.polygon((0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0))
    box = G.footprint(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))
    d = d.withColumns({"in_room": G.covers_convex(room, box), "in_part": G.covers_convex(small, box), "centre_in_part": G.covers_point(small, G.point(F.col("x"), F.col("y")))})
    return d.groupBy("category").agg(*[F.count_if(c).alias(c) for c in ("in_room", "in_part", "centre_in_part")], F.count("*").alias("n"))


def conservative_obstacles(spark: SparkSession, sf: str) -> DataFrame:
    """Every box grown by its clearance on all sides, and the subjects whose box meets a grown one but not the bare one."""
    d = scene_objects(spark, sf)
    grown = d.select("scene_id", "object_id", "x", "y", "z", *[(F.col(e) + 2 * F.col("clearance")).alias(e) for e in ("ex", "ey", "ez")])
    pairs = P.side(d, "s", ("object_id", *P.BOX)).join(P.side(grown, "r"), "scene_id").filter("s_object_id <> r_object_id")
    bare = P.side(d, "b", ("object_id", *P.BOX)).withColumnRenamed("b_object_id", "r_object_id")
    pairs = pairs.join(bare, ["scene_id", "r_object_id"])
    return pairs.groupBy("scene_id").agg(F.count_if(P.collides("s", "r")).alias("grown"), F.count_if(P.collides("s", "b")).alias("bare"))


def clearance(spark: SparkSession, sf: str) -> DataFrame:
    """Of each object the least distance to the room's walls and to the objects that share its height."""
    d = scene_objects(spark, sf)
    walls = F.least(F.col("s_x") - F.col("s_ex") / 2 - ROOM[0], ROOM[2] - F.col("s_x") - F.col("s_ex") / 2, F.col("s_y") - F.col("s_ey") / 2 - ROOM[1], ROOM[3] - F.col("s_y") - F.col("s_ey") / 2)
    near = P.ordered_pairs(d, GEOMETRY).filter(P.z_overlap() > G.CONTACT).groupBy("scene_id", "s_object_id").agg(F.min(P.ground_gap()).alias("gap"))
    s = P.side(d, "s", ("object_id", *P.BOX)).join(near, ["scene_id", "s_object_id"], "left")
    return s.select("scene_id", F.col("s_object_id").alias("object_id"), F.round(F.least(walls, F.coalesce("gap", walls)), 6).alias("clearance"))


def _camera(d: DataFrame) -> DataFrame:
    matrix = K.world_to_camera(F.lit(4.0), F.lit(-2.0), F.lit(1.5), F.lit(0.0), F.lit(0.0))
    k = K.intrinsics(F.lit(73.73979529168804), F.lit(640.0), F.lit(480.0))
    bbox = F.struct("xmin", "ymin", "xmax", "ymax")
    return d.withColumns({"k": k, "m": matrix, "bbox": bbox})


def projection_calibration(spark: SparkSession, sf: str) -> DataFrame:
    d = _camera(scene_objects(spark, sf))
    d = d.withColumn("c", K.calibrate(F.col("k"), F.col("m"), F.col("x"), F.col("y"), F.col("z"), F.col("bbox"), F.col("depth")))
    return d.select("scene_id", "object_id", *[_zero(F.col(f"c.{n}"), 4).alias(n) for n in ("du", "dv", "dd")])


def projected_views(spark: SparkSession, sf: str) -> DataFrame:
    """The view of every object moved by (0.5, 1.0)."""
    d = _camera(scene_objects(spark, sf))
    c = K.calibrate(F.col("k"), F.col("m"), F.col("x"), F.col("y"), F.col("z"), F.col("bbox"), F.col("depth"))
    d = d.withColumn("c", c).withColumn("v", K.projected_view(F.col("k"), F.col("c"), F.col("bbox"), F.col("x") + 0.5, F.col("y") + 1.0, F.lit(640.0), F.lit(480.0)))
    return d.select("scene_id", "object_id", *[F.round(F.col(f"v.bbox.{n}"), 4).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")], F.round("v.depth", 6).alias("depth"), _zero(F.col("v.truncated"), 5).alias("truncated"))


def _mirror_moves(d: DataFrame) -> DataFrame:
    """Every request, its subject moved to the other side of the reference."""
    m = M.all_requests(d, ("x", "y"))
    return m.withColumn("new_x", 2 * F.col("r_x") - F.col("s_x")).withColumn("new_y", 2 * F.col("r_y") - F.col("s_y")).drop("s_x", "s_y", "r_x", "r_y")


MIRROR = f"""{S.REQUESTS},
mirror AS (SELECT f.scene_id, f.s_id, f.r_id, f.rel_before, f.rel_after, 2 * r.x - s.x AS nx, 2 * r.y - s.y AS ny FROM requests f
    JOIN objects s ON s.scene_id = f.scene_id AND s.object_id = f.s_id JOIN objects r ON r.scene_id = f.scene_id AND r.object_id = f.r_id), {S.verified("mirror")}"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_objects(spark, sf)
    return M.verify(d, _mirror_moves(d), ROOM)


def verifier_status(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("request_id", "subject_id", "reference_id", "relation_before", "status", "quality", "leakage", "relation_damage", "errors")


def moved_relation_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).filter("status = 'SUCCESS'").select("request_id", F.col("changed").alias("changes"))


def relation_damage(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).groupBy("relation_before", "status", "quality").agg(F.count("*").alias("n"), F.sum("relation_damage").alias("damage"), F.sum("leakage").alias("leakage"))


def expected_target_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The four changes that a flip of a request's pair must make at least."""
    d = M.all_requests(scene_objects(spark, sf))
    s, r, a, b = (F.col(c).cast("string") for c in ("subject_id", "reference_id", "relation_before", "relation_after"))
    row = lambda sign, x, rel, y: F.concat_ws(":", F.concat(F.lit(sign), x), rel, y)
    four = F.array(row("+", s, b, r), row("-", s, a, r), row("+", r, R.lookup(R.CONVERSE, b), s), row("-", r, R.lookup(R.CONVERSE, a), s))
    return d.select("request_id", F.array_join(F.array_sort(four), ",").alias("changes"))


def objective_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = M.score(_verified(spark, sf), ROOM)
    return d.select("request_id", *[F.round(c, 5).alias(c) for c in ("translation", "damage", "visibility", "safety", "total")])


def _best(spark: SparkSession, sf: str, strict: bool, steps: tuple[float, ...] = M.STEPS) -> DataFrame:
    d = scene_objects(spark, sf)
    best = M.solve(d, M.all_requests(d), ROOM, strict=strict, steps=steps)
    return best.select("request_id", "subject_id", "reference_id", "relation_after", "new_x", "new_y", F.round("translation", 5).alias("translation"), "relation_damage", "quality")


def grid_best(spark: SparkSession, sf: str) -> DataFrame:
    """The strict solver: grid of 0.1 m, then 3 x 3 points at 0.05 and 0.01 m."""
    return _best(spark, sf, True)


def min_cost_best(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum-cost solver at the same steps."""
    return _best(spark, sf, False)


def grid_coarse(spark: SparkSession, sf: str) -> DataFrame:
    """The strict solver on a grid of 2 m, which SQL can search too."""
    return _best(spark, sf, True, (2.0,))


def min_cost_coarse(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum-cost solver on a grid of 2 m, which SQL can search too."""
    return _best(spark, sf, False, (2.0,))


def grid_refined(spark: SparkSession, sf: str) -> DataFrame:
    """How far each request's best gets at the minimum cost."""
    d = scene_objects(spark, sf)
    best = M.solve(d, M.all_requests(d), ROOM, strict=False, steps=M.STEPS)
    return best.select("request_id", "new_x", "new_y", F.round("total", 5).alias("total"))


def _grid_sql(strict: bool) -> str:
    order = "translation, total, nx, ny" if strict else "total, translation, nx, ny"
    return f"""WITH {S.REQUESTS}, moves AS (SELECT f.scene_id, f.s_id, f.r_id, f.rel_before, f.rel_after, (i * 2)::DOUBLE AS nx, (j * 2)::DOUBLE AS ny FROM requests f, range(0, 5) g(i), range(0, 5) h(j)), {S.verified("moves", strict)},
    ranked AS (SELECT *, 1 * translation + 5 * damage + 2 * visibility + 1 * safety AS total FROM scored WHERE status = 'SUCCESS'),
    best AS (SELECT *, row_number() OVER (PARTITION BY scene_id, s_id, r_id, rel_before ORDER BY {order}) AS k FROM ranked)
    SELECT {S.KEY} AS request_id, s_id AS subject_id, r_id AS reference_id, rel_after AS relation_after, nx AS new_x, ny AS new_y, round(translation, 5) AS translation, relation_damage, quality FROM best WHERE k = 1"""


QUERIES = {
    "scene_objects": (scene_table, f"WITH {OBJECTS} SELECT scene_id, object_id, category, {', '.join(f'round({c}, 6) AS {c}' for c in GEOMETRY)}, movable, pinned, coalesce(support_id, 0) AS support_id, split FROM objects"),
    "relation_counts": (relation_counts, f"WITH {S.OBSERVED} SELECT relation, count(*) FILTER (WHERE satisfied) AS holds, count(*) FILTER (WHERE status = 'SUCCESS') AS decided, count(*) AS pairs FROM observed GROUP BY relation"),
    "relation_status_breakdown": (relation_status_breakdown, f"WITH {S.OBSERVED} SELECT relation, status, satisfied, count(*) AS n FROM observed GROUP BY ALL"),
    "relation_margin_stats": (relation_margin_stats, f"WITH {S.OBSERVED} SELECT relation, count(*) AS n, round(min(margin), 6) AS least, round(max(margin), 6) AS most, round(avg(margin), 4) AS mean FROM observed WHERE status = 'SUCCESS' GROUP BY relation"),
    "pair_labels": (pair_labels, f"WITH {S.PAIRS} SELECT scene_id, s_id AS subject_id, r_id AS reference_id, array_to_string(labels, ',') AS labels FROM labelled"),
    "relation_graph": (relation_graph, f"""WITH {S.PAIRS} SELECT scene_id, count(*) AS pairs, sha256(array_to_string(list_transform(list_sort(list({{'k': s_id || ':' || r_id, 'v': array_to_string(labels, ',')}})), lambda e: e.k || '=' || e.v), ';')) AS digest FROM labelled GROUP BY scene_id"""),
    "relation_graph_degree": (relation_graph_degree, f"WITH {S.PAIRS} SELECT scene_id, s_id AS subject_id, u.relation, count(*) AS degree FROM labelled, unnest(labels) AS u(relation) GROUP BY ALL"),
    "converse_check": (converse_check, f"WITH {S.PAIRS} SELECT count(*) AS pairs, count(*) FILTER (WHERE b.labels = list_sort(list_transform(a.labels, lambda v: {S.lookup(R.CONVERSE, 'v')}))) AS consistent FROM labelled a JOIN labelled b ON a.scene_id = b.scene_id AND a.s_id = b.r_id AND a.r_id = b.s_id"),
    "axis_labels": (axis_labels, "WITH " + S.PAIRS + " " + " UNION ALL ".join(f"SELECT '{a}' AS axis, array_to_string({S.on_axis('labels', a)}, ',') AS labels, count(*) AS n FROM labelled GROUP BY ALL" for a in R.AXES)),
    "ground_gap_histogram": (ground_gap_histogram, f"WITH {S.PAIRS} SELECT CAST(floor(round(gap, 6) * 2) AS BIGINT) AS half_metres, count(*) AS n, round(max(gap), 6) AS most FROM pairs WHERE s_id < r_id GROUP BY ALL"),
    "polygon_gap": (polygon_gap, f"""WITH {S.PAIRS} SELECT scene_id, round(sum(gap), 6) AS gap, round(sum(greatest(least(sx + sex / 2, rx + rex / 2) - greatest(sx - sex / 2, rx - rex / 2), 0::DOUBLE) * greatest(least(sy + sey / 2, ry + rey / 2) - greatest(sy - sey / 2, ry - rey / 2), 0::DOUBLE)), 6) AS area, count(*) AS pairs FROM pairs WHERE s_id < r_id GROUP BY scene_id"""),
    "obb_collisions": (obb_collisions, f"""WITH {S.PAIRS}, t AS (SELECT *, greatest(least(sx + sex / 2, rx + rex / 2) - greatest(sx - sex / 2, rx - rex / 2), 0::DOUBLE) * greatest(least(sy + sey / 2, ry + rey / 2) - greatest(sy - sey / 2, ry - rey / 2), 0::DOUBLE) AS area, least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2) AS dz FROM pairs WHERE s_id < r_id) SELECT scene_id, s_id AS a_id, r_id AS b_id, round(area, 6) AS area, round(dz, 6) AS depth FROM t WHERE area > 1e-9 AND dz > 1e-9"""),
    "z_overlap": (z_overlap, f"WITH {S.PAIRS}, t AS (SELECT scene_id, least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2) AS dz FROM pairs WHERE s_id < r_id) SELECT scene_id, count(*) FILTER (WHERE dz > 1e-9) AS overlapping, round(max(dz), 6) AS most FROM t GROUP BY scene_id"),
    "inside_room": (inside_room, f"""WITH {OBJECTS}, t AS (SELECT category, x - ex / 2 >= -1 - 1e-6 AND x + ex / 2 <= 9 + 1e-6 AND y - ey / 2 >= -1 - 1e-6 AND y + ey / 2 <= 9 + 1e-6 AS a, x - ex / 2 >= -1e-6 AND x + ex / 2 <= 6 + 1e-6 AND y - ey / 2 >= -1e-6 AND y + ey / 2 <= 6 + 1e-6 AS b, x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 6 AS c FROM objects) SELECT category, count(*) FILTER (WHERE a) AS in_room, count(*) FILTER (WHERE b) AS in_part, count(*) FILTER (WHERE c) AS centre_in_part, count(*) AS n FROM t GROUP BY category"""),
    "conservative_obstacles": (conservative_obstacles, f"""WITH {OBJECTS}, t AS (SELECT s.scene_id, s.x AS sx, s.y AS sy, s.z AS sz, s.ex AS sex, s.ey AS sey, s.ez AS sez, r.x, r.y, r.z, r.ex, r.ey, r.ez, r.clearance AS c FROM objects s JOIN objects r ON s.scene_id = r.scene_id AND s.object_id <> r.object_id),
        h AS (SELECT scene_id, {', '.join(f"greatest(least(sx + sex / 2, x + {e('ex')} / 2) - greatest(sx - sex / 2, x - {e('ex')} / 2), 0::DOUBLE) * greatest(least(sy + sey / 2, y + {e('ey')} / 2) - greatest(sy - sey / 2, y - {e('ey')} / 2), 0::DOUBLE) > 1e-9 AND least(sz + sez / 2, z + {e('ez')} / 2) - greatest(sz - sez / 2, z - {e('ez')} / 2) > 1e-9 AS {n}" for n, e in (('grown', lambda v: f'({v} + 2 * c)'), ('bare', lambda v: v)))} FROM t)
        SELECT scene_id, count(*) FILTER (WHERE grown) AS grown, count(*) FILTER (WHERE bare) AS bare FROM h GROUP BY scene_id"""),
    "clearance": (clearance, f"""WITH {S.PAIRS}, near AS (SELECT scene_id, s_id, min(gap) AS gap FROM pairs WHERE least(sz + sez / 2, rz + rez / 2) - greatest(sz - sez / 2, rz - rez / 2) > 1e-9 GROUP BY ALL),
        w AS (SELECT scene_id, object_id, least(x - ex / 2 + 1, 9 - x - ex / 2, y - ey / 2 + 1, 9 - y - ey / 2) AS walls FROM objects) SELECT w.scene_id, object_id, round(least(walls, coalesce(gap, walls)), 6) AS clearance FROM w LEFT JOIN near ON near.scene_id = w.scene_id AND near.s_id = object_id"""),
    "projection_calibration": (projection_calibration, f"WITH {OBJECTS} SELECT scene_id, object_id, {_zero_sql('(xmin + xmax) / 2 - (320 * (x - 4) / (y + 2) + 320)', 4)} AS du, {_zero_sql('(ymin + ymax) / 2 - (240 - 320 * (z - 1.5::DOUBLE) / (y + 2))', 4)} AS dv, {_zero_sql('depth - (y + 2)', 4)} AS dd FROM objects"),
    "projected_views": (projected_views, f"""WITH {OBJECTS}, t AS (SELECT *, 320 * (x + 0.5::DOUBLE - 4) / (y + 3) + 320 + (xmin + xmax) / 2 - (320 * (x - 4) / (y + 2) + 320) AS u, 240 - 320 * (z - 1.5::DOUBLE) / (y + 3) + (ymin + ymax) / 2 - (240 - 320 * (z - 1.5::DOUBLE) / (y + 2)) AS v, (xmax - xmin) / 2 AS hw, (ymax - ymin) / 2 AS hh FROM objects)
        SELECT scene_id, object_id, round(u - hw, 4) AS xmin, round(v - hh, 4) AS ymin, round(u + hw, 4) AS xmax, round(v + hh, 4) AS ymax, round(y + 3, 6) AS depth,
        {_zero_sql('1 - greatest(0::DOUBLE, least(u + hw, 640) - greatest(u - hw, 0::DOUBLE)) * greatest(0::DOUBLE, least(v + hh, 480) - greatest(v - hh, 0::DOUBLE)) / (4 * hw * hh)', 5)} AS truncated FROM t"""),
    "verifier_status": (verifier_status, f"WITH {MIRROR} SELECT {S.KEY} AS request_id, s_id AS subject_id, r_id AS reference_id, rel_before AS relation_before, status, quality, leakage, relation_damage, errors FROM scored"),
    "moved_relation_diff": (moved_relation_diff, f"WITH {MIRROR} SELECT {S.KEY} AS request_id, changes FROM scored WHERE status = 'SUCCESS'"),
    "relation_damage": (relation_damage, f"WITH {MIRROR} SELECT rel_before AS relation_before, status, quality, count(*) AS n, CAST(sum(relation_damage) AS BIGINT) AS damage, CAST(sum(leakage) AS BIGINT) AS leakage FROM scored GROUP BY ALL"),
    "expected_target_diff": (expected_target_diff, f"""WITH {S.REQUESTS} SELECT {S.KEY} AS request_id, array_to_string(list_sort(['+' || s_id || ':' || rel_after || ':' || r_id, '-' || s_id || ':' || rel_before || ':' || r_id, '+' || r_id || ':' || {S.lookup(R.CONVERSE, 'rel_after')} || ':' || s_id, '-' || r_id || ':' || {S.lookup(R.CONVERSE, 'rel_before')} || ':' || s_id]), ',') AS changes FROM requests"""),
    "objective_terms": (objective_terms, f"WITH {MIRROR} SELECT {S.KEY} AS request_id, round(translation, 5) AS translation, round(damage, 5) AS damage, round(visibility, 5) AS visibility, round(safety, 5) AS safety, round(translation + 5 * damage + 2 * visibility + safety, 5) AS total FROM scored"),
    "grid_best": (grid_best, None),
    "min_cost_best": (min_cost_best, None),
    "grid_coarse": (grid_coarse, _grid_sql(True)),
    "min_cost_coarse": (min_cost_coarse, _grid_sql(False)),
    "grid_refined": (grid_refined, None),
}
