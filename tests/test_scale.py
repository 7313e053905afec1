"""Steps that must not shuffle what is already together, nor grow faster than their input, and cases that only larger tables have."""

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import evidence as E
from tessera.operators import moves
from tessera.operators import navigation as N
from tessera.operators import pairs as P
from tessera.operators import convex as V
from tessera.operators import search
from tessera.plans import bounds, convex, domains, library, navigation, roster, scenes
from tessera.sources.fixture import ROOM, scene_objects

SF = "/root/testdata/sf0.001"


def shuffles(d):
    """Shuffles of a query's plan, those that are used again once."""
    text = d._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:").startswith("Exchange ") for line in text.splitlines())


@pytest.fixture
def unbroadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_scenes_objects_pairs_and_requests_stay_together(unbroadcast):
    # lines and parts by part, then lines by order
    assert shuffles(scene_objects(unbroadcast, SF)) == 3
    assert shuffles(scenes._labelled(unbroadcast, SF)) == 3
    assert shuffles(roster._ordered(unbroadcast, SF)) == 3
    # candidates meet their scene once: two times the objects
    assert shuffles(scenes.verifier_status(unbroadcast, SF)) <= 6
    assert shuffles(bounds.cell_visibility(unbroadcast, SF)) == 3


def test_counts_by_scene_need_no_shuffle_of_candidates(unbroadcast):
    plan = roster.roster_summary(unbroadcast, SF)
    assert shuffles(plan) == 4 and "Expand" not in plan._jdf.queryExecution().executedPlan().toString()


def test_parts_that_repeat_or_miss_neither_renumber_nor_drop_lines(spark, tmp_path):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey < 40")
    part = spark.read.parquet(f"{SF}/part.parquet").join(line.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")
    keys = sorted(r.p_partkey for r in part.select("p_partkey").collect())
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    part.filter(F.col("p_partkey") != keys[0]).unionByName(part.filter(F.col("p_partkey") == keys[1])).write.parquet(f"{tmp_path}/part.parquet")
    whole = {(r.scene_id, r.object_id): r.n for r in scene_objects(spark, SF).filter("scene_id < 40").groupBy("scene_id", "object_id").agg(F.count("*").alias("n")).collect()}
    got = {(r.scene_id, r.object_id): r.n for r in scene_objects(spark, str(tmp_path)).groupBy("scene_id", "object_id").agg(F.count("*").alias("n")).collect()}
    missing, twice = (line.filter(F.col("l_partkey") == k).count() for k in keys[:2])
    assert len(whole) - len(got) == missing > 0 and sum(n == 2 for n in got.values()) == twice > 0
    assert set(got) <= set(whole)


def test_fields_of_view_beyond_180_degrees(spark, tmp_path):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").limit(18).withColumn("l_orderkey", F.lit(1).cast("long"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    rows = {r.object_id: r.fx for r in library.intrinsics(spark, str(tmp_path)).collect()}
    assert len(rows) == 18 and rows[15] == 0 and rows[6] == 240 and rows[18] == pytest.approx(-64.307806)


def test_a_patch_keeps_no_point(spark):
    n = E.GRID_SIDE**2
    points = spark.range(2 * n).select(F.lit(1).alias("scene_id"), F.col("id").alias("position"), F.col("id").cast("double").alias("px"), F.lit(0.0).alias("pz"))
    more = points.filter("position <> 62").withColumn("scene_id", F.lit(2)).unionByName(points.filter("position = 63").withColumn("scene_id", F.lit(2)))
    found = E.patches(points.unionByName(more))
    assert [(r.scene_id, r.patch_index, r.x_min, r.x_max) for r in found.orderBy("patch_index").collect()] == [(1, 0, 0.0, n - 1.0), (1, 1, float(n), 2 * n - 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan.lower() and "Join" not in plan


def test_tolerance_join_hardly_copies_points(spark):
    d = spark.range(1000).select(F.lit(1).alias("scene_id"), F.col("id").alias("oid"), *[(F.rand(k) * 9 - 4).alias(a) for k, a in enumerate("xyz")]).cache()
    edge = d.withColumns({a: F.round(F.col(a) / (P.COARSE * 1e-3)) * P.COARSE * 1e-3 for a in "xyz"})  # on the corners of cells
    for points in (d, edge):
        near = points.withColumn("x", F.col("x") + 0.9e-3 * F.when(F.col("oid") % 2 == 0, 1).otherwise(-1)).withColumn("y", F.col("y") + 1e-4)
        far = points.withColumn("x", F.col("x") + 1.1e-3)
        frozen = points.withColumnRenamed("oid", "fid")
        assert P.bind_within(near, frozen, 1e-3).filter("matches > 0").count() == 1000
        assert P.bind_within(far, frozen, 1e-3).filter("matches = 0").count() == 1000
    plan = P.bind_within(d, d.withColumnRenamed("oid", "fid"), 1e-3)._jdf.queryExecution().analyzed().toString()
    assert P.COARSE >= 16 and plan.count("Generate explode") == 3


def test_grid_points_of_a_wide_room_against_every_point(spark):
    room = spark.createDataFrame([(1, -20.0, -1.0, 3.0, 40.0)], "scene_id int, room_x0 double, room_y0 double, room_x1 double, room_y1 double")
    boxes = [(1, 1, 0.0, 0.0, 1.0, 3.0, 0.0), (1, 2, -9.0, 15.8, 2.0, 1.0, 0.0), (1, 3, -15.0, 31.0, 3.0, 9.0, 0.0)]
    d = spark.createDataFrame(boxes, "scene_id int, object_id int, x double, y double, ex double, ey double, yaw double")
    got = {(r.x, r.y) for r in N.grid_points(d, room, 0.5, 0.4).collect()}
    free = lambda x, y: all(abs(x - b[2]) >= b[4] / 2 + 0.4 or abs(y - b[3]) >= b[5] / 2 + 0.4 for b in boxes)
    assert got == {(i / 2, j / 2) for i in range(-39, 6) for j in range(-1, 80) if free(i / 2, j / 2)}
    assert "collect_set" not in N.grid_points(d, room, 0.5, 0.4)._jdf.queryExecution().optimizedPlan().toString()


def test_geometry_works_out_its_polygons_once(spark):
    a, b = F.col("first_polygon"), F.col("second_polygon")
    once = {"area": G.signed_area(a), "ring": G.canonical_ring(a), "bounds": G.bounds(a), "hausdorff": G.hausdorff(a, b), "gap": G.gap(a, b), "separation": G.separation(a, b), "overlap": G.overlap_area(a, b)}
    named = {n: [e._jc.toString().count(p) for p in ("first_polygon", "second_polygon")] for n, e in once.items()}
    assert all(k <= 1 for found in named.values() for k in found), named


def test_polygons_of_a_pair_stay_with_their_scene(unbroadcast):
    # pairs are made of their scene's row, cells and areas of their pair's
    assert shuffles(convex.complement_cells(unbroadcast, SF)) == 3
    assert shuffles(convex.obstacle_brackets(unbroadcast, SF)) == 3


def test_complements_cut_once_are_those_cut_cell_by_cell(spark):
    # F2; bounds that leave some of the cells out, and planes that graze a corner
    d = convex._obstacles(spark, SF).limit(200).withColumns({"k": F.monotonically_increasing_id(), "ux1": F.col("bx1"), "uy0": (F.col("by0") + F.col("by1")) / 2}).select("k", "ux0", "ux1", "uy0", "uy1", "outer").localCheckpoint()
    cells = V.with_shapes(V.outside(d, "outer")).filter("shape.state <> 'EMPTY'").groupBy("k").agg(F.count_if(F.col("shape.state") == "OPEN").alias("cells"), F.count_if(F.col("shape.state") == "THIN").alias("thin"), F.sum("shape.area").alias("area"))
    known = {r.k: (r.cells, r.thin, round(r.area, 9)) for r in cells.collect()}
    got = {r.k: (r.cells, r.thin, round(r.area, 9)) for r in V.outside_summary(d, "outer").collect()}
    assert got == known and len(known) == 200 and len({v[0] for v in known.values()}) > 2


def test_requests_are_not_worked_out_twice(spark):
    # no filter by the size of the relations
    plan = moves.all_requests(scene_objects(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "near" in plan and not any("near" in line for line in plan.splitlines() if "Filter" in line)


def test_free_space_is_cut_where_its_object_is(unbroadcast):
    # no turn of obstacles is a join; the fourth shuffle is the summary's, a row an object
    assert shuffles(convex.free_space(unbroadcast, SF)) == 4


def test_no_object_is_torn_by_a_batch():
    # F10
    start = [True, False, False, True, True, False, False, False, True]
    whole = pa.RecordBatch.from_pydict({"start": start, "n": list(range(9))})
    for size in range(1, 10):
        got = [b.column("n").to_pylist() for b in V.whole_subjects(whole.slice(k, size) for k in range(0, 9, size))]
        assert sum(got, []) == list(range(9)) and all(start[b[0]] for b in got), (size, got)


def test_shortest_moves_are_looked_for_where_their_scene_is(unbroadcast):
    # objects, and requests with their own reading of them; pieces and cells are not joined
    assert shuffles(convex.continuous_moves(unbroadcast, SF)) <= 6


def test_selection_shuffles_few_candidates_and_visits_more_where_these_do_not_settle_it(unbroadcast, monkeypatch):
    # the ranks of whole relations by five keys are left to cases that need them
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    d = roster.T.candidate_inventory(scene_objects(unbroadcast, SF)).localCheckpoint()
    for quotas in (roster.T.QUOTAS, roster.T.QUOTAS | {"total": 25, "pair": 1, "scene": 2, "subject": 1}):
        found = roster.T.select_with_quotas(d, quotas)
        assert shuffles(found) == 0
        with monkeypatch.context() as m:
            m.setattr(roster.T, "LOOK", 3)
            assert rows(roster.T.select_with_quotas(d, quotas)) == rows(found)


@pytest.mark.parametrize("query", [roster.relation_slots, roster.batches])
def test_slots_read_their_scenes_once(unbroadcast, query):
    # F32, F33: all that is before a request is counted of the shuffle that ranks it
    unbroadcast.conf.set("spark.sql.adaptive.enabled", "false")
    plan = query(unbroadcast, SF)._jdf.queryExecution().executedPlan().toString()
    unbroadcast.conf.unset("spark.sql.adaptive.enabled")
    assert sum("sha2(cast(concat_ws(|" in line for line in plan.splitlines()) == 1


def test_inventory_sorts_objects_once(unbroadcast):
    # F31, F32, F33: no window of its own for each category
    plan = roster.object_inventory(unbroadcast, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Sort ") for line in plan.splitlines() if "category" in line or "p_type" in line.split("]")[0]) == 0


def test_regions_are_summed_where_their_scene_is(unbroadcast, monkeypatch):
    # no run is shuffled, and parts of scenes have what all at once have
    d = navigation._objects(unbroadcast, SF).filter("scene_id % 10 = 1").localCheckpoint()
    rooms, movers = navigation._rooms(d), d.filter("movable AND NOT pinned")
    given = (movers, N.grid_points(d, rooms, 0.5, 0.4).localCheckpoint(), rooms.localCheckpoint(), 0.4, 0.05, 0.25)
    rows = lambda d: sorted((r.scene_id, r.subject_id, round(r.inner_area, 9), round(r.outer_area, 9), r.runs, r.euler) for r in d.collect())
    found = N.region_areas(*given)
    # the objects of a scene, and its points
    assert shuffles(found) <= 3
    known = rows(found)
    assert rows(N.region_summary(N.position_runs(*given))) == known and len(known) > 100
    monkeypatch.setattr(N, "PART", 300)
    assert rows(N.region_areas(*given)) == known


def test_replays_are_counted_in_one_reading(unbroadcast):
    # F40; a request that is there twice, one that is not found again, and one that differs
    d = unbroadcast.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", None), ("d", 4.0)], "request_id string, upper double")
    again = unbroadcast.createDataFrame([("b", 3.0), ("a", 1.0), ("b", 2.0), ("d", None), ("e", 1.0)], "request_id string, upper double")
    assert tuple(domains.X.replay_counts(d, again).first()) == (5, 3) and tuple(domains.X.replay_counts(d, d).first()) == (5, 0)
    assert tuple(domains.X.replay_counts(d.limit(0), d.limit(0)).first()) == (0, 0)
    plan = domains.replayed(unbroadcast, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_least_costs_are_looked_for_in_their_subjects_row(unbroadcast):
    # no round of jobs a level, and no cell is shuffled: three for the objects, twice, and subjects are dealt once
    plan = bounds.bounded_costs(unbroadcast, SF)
    assert shuffles(plan) <= 8 and "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString()


def test_certificates_are_replayed_where_their_scene_is(unbroadcast):
    # certificates are dealt by scene, once, and what is tried of them is not shuffled: three for each reading of the objects
    plan = bounds.replayed_costs(unbroadcast, SF)
    assert shuffles(plan) <= 12 and "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString()


def test_requests_are_searched_where_their_scene_is(unbroadcast):
    d = scene_objects(unbroadcast, SF)
    plan = search.best_points(d, moves.all_requests(d), ROOM, True, (2.0,), moves.WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Exchange ")]
    assert dealt and not any("request_id" in line for line in dealt)


def test_agents_places_are_made_where_their_scene_is(unbroadcast):
    # lines by part and by order, and parts; points, words of them and rooms are not shuffled
    assert shuffles(navigation.navigation_regions(unbroadcast, SF)) == 3


def test_areas_by_places_made_in_a_scenes_row(spark):
    d = convex.turned_objects(spark, SF).filter("scene_id % 31 < 4")
    # a box without a place takes no point, and a room that is no multiple of the step has none at its edge
    d = d.withColumn("x", F.when(F.col("scene_id") % 5 != 1, F.col("x")).otherwise(F.when(F.col("object_id") != 1, F.col("x")))).localCheckpoint()
    room = (-0.7, -1.0, 8.3, 9.2)
    rooms = d.select("scene_id").distinct().withColumns({n: F.lit(v) for n, v in zip(N.ROOM, room)})
    key = lambda r: (r.scene_id, r.subject_id)
    there = sorted(N.scene_areas(d, F.expr("movable AND NOT pinned"), room, 0.5, 0.4, 0.05, 0.25).collect(), key=key)
    plain = sorted(N.region_areas(d.filter("movable AND NOT pinned"), N.grid_points(d, rooms, 0.5, 0.4), rooms, 0.4, 0.05, 0.25).collect(), key=key)
    assert len(there) > 100 and there == plain
