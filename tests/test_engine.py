"""Operators against hand values, plain Python and the boundary cases of the relation semantics."""

import json
import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import camera as K
from tessera.functions import geometry as G
from tessera.functions import relations as R
from tessera.functions import scalars as C
from tessera.operators import domains as X
from tessera.operators import moves as M
from tessera.operators import pairs as P
from tessera.operators import planning as L
from tessera.operators import roster as T
from tessera.plans import generate, scenes
from tessera.sources import dataset as D
from tessera.sources import scenes as S
from tessera.sources.config import GenerationConfig, load_generation_config
from tessera.sources.fixture import ROOM, scene_objects
from tessera.streaming.campaign import run_missing

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def told(spark, relation, dx=0.0, dd=0.0, gap=0.0, seen=True):
    r = one(spark, R.observe(relation, F.lit(seen), F.lit(dx), F.lit(dd), F.lit(gap)))
    return r.satisfied, round(r.margin, 9), r.status


@pytest.mark.parametrize(
    ("relation", "kw", "expected"),
    [
        ("left", {"dx": 32.0}, (True, 0.0, "SUCCESS")),
        ("left", {"dx": 32.0 - 1e-10}, (True, 0.0, "SUCCESS")),
        ("left", {"dx": 32.0 - 1e-8}, (False, round(-1e-8, 9), "AMBIGUOUS")),
        ("right", {"dx": 40.0}, (False, 8.0, "SUCCESS")),
        ("front", {"dd": 0.2}, (True, 0.0, "SUCCESS")),
        ("behind", {"dd": -0.3}, (True, 0.1, "SUCCESS")),
        ("near", {"gap": 0.5}, (True, 0.0, "SUCCESS")),
        ("near", {"gap": 0.5000001}, (False, 0.0, "AMBIGUOUS")),
        ("far", {"gap": 1.4999999}, (False, 0.0, "AMBIGUOUS")),
        ("far", {"gap": 1.5}, (True, 0.0, "SUCCESS")),
        ("near", {"gap": 2.0}, (False, 1.5, "SUCCESS")),
        ("far", {"gap": 2.0, "seen": False}, (False, 0.0, "NOT_VISIBLE")),
    ],
)
def test_observe(spark, relation, kw, expected):
    assert told(spark, relation, **kw) == expected


def test_visibility_bounds_are_inclusive(spark):
    lit = F.lit
    assert one(spark, R.is_visible(lit(0.2), lit(0.0025), lit(0.5)))
    assert not one(spark, R.is_visible(lit(0.19999), lit(0.0025), lit(0.5)))
    assert not one(spark, R.is_visible(lit(None).cast("double"), lit(1.0), lit(0.0)))


def test_enum_algebra(spark):
    assert one(spark, R.converses(F.array(F.lit("left"), F.lit("near")))) == ["near", "right"]
    assert R.OPPOSITE["near"] == "far" and R.CONVERSE["near"] == "near"


def test_polygons(spark):
    square = G.polygon((0, 0), (2, 0), (2, 2), (0, 2))
    turned = G.footprint(F.lit(4.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(45.0))
    assert one(spark, G.signed_area(square)) == 4
    assert math.isclose(one(spark, G.gap(square, turned)), 2 - math.sqrt(0.5))
    over = G.footprint(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(45.0))
    assert math.isclose(one(spark, G.overlap_area(square, over)), 0.5) and one(spark, G.gap(square, over)) == 0
    touching = G.polygon((2, 0), (3, 0), (3, 2), (2, 2))
    assert one(spark, G.gap(square, touching)) == 0 and one(spark, G.overlap_area(square, touching)) == 0
    assert one(spark, G.covers_point(square, G.point(F.lit(2.0), F.lit(1.0)))) and not one(spark, G.covers_point(square, G.point(F.lit(2.1), F.lit(1.0))))
    eroded = G.erode_convex(square, G.relative_to(G.footprint(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.5)), F.lit(0.0), F.lit(0.0)))
    b = one(spark, G.bounds(eroded))
    assert (b.xmin, b.xmax, b.ymin, b.ymax) == (0.5, 1.5, 0.25, 1.75)
    assert [tuple(p) for p in one(spark, G.canonical_ring(G.polygon((2, 2), (2, 0), (0, 0), (0, 2))))] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    ring = one(spark, G.disk(F.lit(1.0), 16, outer=True))
    assert len(ring) == 16 and min(math.hypot(*p) for p in ring) >= 1


def test_hull(spark):
    r = random.Random(0)
    pts = [(r.randint(0, 6), r.randint(0, 6)) for _ in range(14)]

    def plain(points):
        def half(ps):
            out = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ps = sorted(set(points))
        return half(ps) + half(ps[::-1])

    assert [tuple(p) for p in one(spark, G.hull(G.polygon(*pts)))] == [(float(a), float(b)) for a, b in plain(pts)]


def test_camera(spark):
    lit = F.lit
    k = K.intrinsics(lit(90.0), lit(640.0), lit(480.0))
    m = K.world_to_camera(lit(0.0), lit(0.0), lit(1.0), lit(90.0), lit(0.0))
    p = one(spark, K.transform(m, lit(5.0), lit(0.0), lit(1.0)))
    assert math.isclose(p.z, 5) and abs(p.x) < 1e-12 and abs(p.y) < 1e-12
    assert one(spark, k)[0] == pytest.approx(240)
    box = F.struct(lit(-10.0).alias("xmin"), lit(0.0).alias("ymin"), lit(30.0).alias("xmax"), lit(10.0).alias("ymax"))
    assert one(spark, K.truncated(box, lit(640.0), lit(480.0))) == pytest.approx(0.25)
    with pytest.raises(Exception, match="16 values"):
        one(spark, K.transform(F.array(lit(1.0)), lit(0.0), lit(0.0), lit(0.0)))


def test_euler_and_yaw(spark):
    q = K.euler_to_quaternion(F.struct(F.lit(0.0).alias("x"), F.lit(30.0).alias("y"), F.lit(0.0).alias("z")))
    assert one(spark, G.yaw_degrees(q["x"], q["y"], q["z"], q["w"])) == pytest.approx(-30)
    assert one(spark, K.quaternion_residual(q, q)) == pytest.approx(0, abs=1e-5)


def test_directed_bounds(spark):
    for d in (0.0, 0.1, 30.0, 45.0, 89.9999, 90.0, 179.0, 200.0, 271.5, -12.25):
        s, c = C.sine_cosine_bounds(d)
        assert C.below(s[0]) - 1e-15 <= math.sin(math.radians(d)) <= C.above(s[1]) + 1e-15
        assert C.below(c[0]) - 1e-15 <= math.cos(math.radians(d)) <= C.above(c[1]) + 1e-15
        assert s[0] ** 2 + c[0] ** 2 <= 1 <= s[1] ** 2 + c[1] ** 2 or d > 90 or d < 0
    assert C.above(Fraction(1, 3)) > C.below(Fraction(1, 3)) and C.below(Fraction(1, 2)) == 0.5
    row = spark.createDataFrame([([0.1, 0.2, 0.3],)], "v array<double>").select(C.directed_sum("v").alias("s")).first().s
    assert Fraction(row.lo) <= Fraction(0.1) + Fraction(0.2) + Fraction(0.3) <= Fraction(row.hi)


def test_scalars(spark):
    assert [one(spark, C.quantise(F.lit(v), 1.0)) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, C.safe_path(F.lit("a/b.json"))) and not any(one(spark, C.safe_path(F.lit(p))) for p in ("/a", "a/../b", "a\\b", ""))
    assert spark.createDataFrame([('{"b": 1, "a": [true, null]}',), ("x",)], "t string").select(C.canonical_json("t").alias("c")).collect()[0].c == '{"a":[true,null],"b":1}'


def test_turned_pairs_agree_with_the_fast_path(spark):
    d = scene_objects(spark, SF).filter("scene_id < 300").withColumn("yaw", F.lit(0.0))
    a = P.with_relations(P.ordered_pairs(d)).select("scene_id", "s_object_id", "r_object_id", "labels")
    b = P.with_relations(P.ordered_pairs(d), turned=True).select(a.columns)
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_closure_with_cycles_and_several_parents(spark):
    edges = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 3), (2, 1, 2), (2, 1, 3), (2, 3, 5)]
    got = {tuple(r) for r in P.support_closure(spark.createDataFrame(edges, "scene_id long, child long, parent long")).collect()}
    expected = set(edges)
    while True:
        more = expected | {(s, a, d) for s, a, b in expected for t, c, d in expected if (s, b) == (t, c)}
        if more == expected:
            break
        expected = more
    assert got == expected


def test_quota_selection_is_the_plain_greedy_one(spark):
    r = random.Random(3)
    rows = [(s, o, q, rel, f"c{r.randint(0, 2)}", f"c{r.randint(0, 2)}", "FLOOR", "PENDING") for s in range(25) for o in range(3) for q in range(3) if o != q for rel in R.RELATIONS if r.random() < 0.6]
    d = spark.createDataFrame(rows, "scene_id long, s_object_id long, r_object_id long, relation string, s_category string, r_category string, s_support_kind string, state string")
    for quotas in ({"total": 12, "relation": 4, "scene": 3, "subject": 2, "pair": 3}, {"total": 60, "relation": 10, "scene": 6, "subject": 2, "pair": 7}, T.QUOTAS):
        ordered = T.seeded_order(d).toPandas().sort_values(T.VISIT)
        seen, expected = {}, []
        for x in ordered.itertuples():
            keys = {"total": (), "relation": ("r", x.relation), "scene": ("s", x.scene_id), "subject": ("o", x.scene_id, x.s_object_id), "pair": ("p", x.s_category, x.r_category)}
            if all(seen.get(k, 0) < quotas[q] for q, k in keys.items()):
                expected.append((len(expected), x.relation, x.scene_id, x.s_object_id, x.r_object_id))
                for k in keys.values():
                    seen[k] = seen.get(k, 0) + 1
        got = sorted((x.selection_index, x.relation, x.scene_id, x.s_object_id, x.r_object_id) for x in T.select_with_quotas(d, quotas).collect())
        assert got == expected
        assert T.within_reach(T.seeded_order(d), {"total": 2, "relation": 1, "scene": 1, "subject": 1, "pair": 1}).count() < len(rows)


def test_bracket_complement_swaps(spark):
    d = spark.createDataFrame([(True, True), (False, True), (False, False)], "i boolean, o boolean")
    i, o = L.bracket_not("i", "o")
    assert [tuple(r) for r in d.select(i, o).collect()] == [(False, False), (False, True), (True, True)]


def test_box_contact(spark):
    a = G.footprint(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    b = lambda x: G.footprint(F.lit(x), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(45.0))
    z = F.lit(-0.5)
    assert one(spark, L.box_contact(a, b(3.0), z)) == "PROVEN_SEPARATED"
    assert one(spark, L.box_contact(a, b(0.5), z)) == "PROVEN_CLOSED_INTERSECTION"
    assert one(spark, L.box_contact(a, b(0.5), F.lit(0.1))) == "PROVEN_SEPARATED"


def scene_document(name="room1"):
    box = lambda x, y: {"center": {"x": x, "y": y, "z": 0.5}, "extent": {"x": 0.5, "y": 0.5, "z": 1.0}, "rotation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}}
    view = lambda x, d: {"camera_id": "main", "bbox": {"xmin": x - 20.0, "ymin": 200.0, "xmax": x + 20.0, "ymax": 280.0}, "camera_depth": d, "visible_fraction": 0.9, "image_area_fraction": 0.01, "truncated_fraction": 0.0}
    obj = lambda i, x, y, px, d: {"object_id": i, "name": i, "category": i, "movable": True, "position": {"x": x, "y": y, "z": 0.5}, "rotation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}, "obb": box(x, y), "views": {"main": view(px, d)}}
    return {"scene_id": name, "source": "test", "coordinate_system": "RH_METERS_Z_UP", "generation_seed": 1, "room_polygon_xy": [{"x": 0.0, "y": 0.0}], "pinned_object_ids": ["b"], "cameras": [], "objects": [obj("a", 1.0, 1.0, 100.0, 2.0), obj("b", 3.0, 1.0, 300.0, 3.0)],
            "collision_obstacles": [{"obstacle_id": "o", "source_object_id": "b", "clearance_m": 0.1, "obb": box(3.0, 1.0)}]}


def test_scene_documents(spark, tmp_path):
    (tmp_path / "room1.json").write_text(json.dumps(scene_document(), indent=1))
    scenes = S.read_scenes(spark, str(tmp_path))
    d = S.object_table(scenes)
    rows = {(r.s_object_id, r.r_object_id): r.labels for r in P.with_relations(P.ordered_pairs(d), turned=True).collect()}
    assert rows["a", "b"] == ["far", "front", "left"] and rows["b", "a"] == ["behind", "far", "right"]
    assert {r.object_id: r.pinned for r in d.collect()} == {"a": False, "b": True} and S.obstacle_table(scenes).first().grown_ex == pytest.approx(0.7)
    (tmp_path / "other.json").write_text(json.dumps(scene_document("wrong")))
    with pytest.raises(Exception, match="not a scene document"):
        S.read_scenes(spark, str(tmp_path)).collect()


def test_events(spark, tmp_path):
    v = lambda x, y, z: {"x": x, "y": y, "z": z}
    obj = lambda i, kind, p, size, parents, move=True: {"objectId": i, "name": i, "objectType": kind, "moveable": move, "pickupable": False, "position": p, "rotation": v(0.0, 0.0, 0.0), "axisAlignedBoundingBox": {"center": p, "size": size}, "parentReceptacles": parents}
    event = {"scene_name": "FloorPlan2", "fov": 90.0, "width": 640, "height": 480, "camera_position": v(1.0, 1.5, -2.0), "camera_yaw": 0.0, "camera_horizon": 0.0, "scene_bounds": {"center": v(0.0, 1.5, 1.0), "size": v(6.0, 3.0, 8.0)},
             "objects": [obj("chair", "Chair", v(0.0, 0.5, 1.0), v(1.0, 1.0, 0.5), ["floor", "table"]), obj("table", "Table", v(0.0, 0.45, 1.5), v(8.0, 0.1, 8.0), [], False), obj("floor", "Floor", v(0.0, 0.0, 0.0), v(9.0, 0.0, 9.0), [], False)]}
    (tmp_path / "e.json").write_text(json.dumps(event))
    events = S.read_events(spark, str(tmp_path))
    rows = {r.object_id: r for r in S.event_objects(events).collect()}
    assert (rows["chair"].x, rows["chair"].y, rows["chair"].z, rows["chair"].ey) == (0.0, 1.0, 0.5, 0.5)
    assert rows["chair"].support_id == "table" and rows["chair"].support_kind == "RECEPTACLE" and rows["table"].movable is False
    room = [tuple(p) for p in S.event_rooms(events).first().room]
    assert room == [(-3.0, -3.0), (3.0, -3.0), (3.0, 5.0), (-3.0, 5.0)]
    assert S.event_cameras(events).first().intrinsics[0] == pytest.approx(240)


def test_ids_are_remapped_by_name(spark):
    known = spark.createDataFrame([(1, "k1", "n1"), (1, "k2", "n2")], "scene_id long, object_id string, name string")
    seen = spark.createDataFrame([(1, "o9", "n1", "o8"), (1, "o8", "n2", None)], "scene_id long, object_id string, name string, support_id string")
    assert {(r.object_id, r.support_id) for r in S.remap_ids(seen, known).collect()} == {("k1", "k2"), ("k2", None)}
    with pytest.raises(Exception, match="no single known"):
        S.remap_ids(seen, known.filter("name = 'n1'")).collect()


@pytest.mark.parametrize(("new_y", "seen"), [(-2.0, False), (-5.0, False), (-2.0 + 5e-16, True)])
def test_nothing_is_seen_at_or_behind_the_camera(spark, new_y, seen):
    """The camera stands at y = -2: a move onto its plane, or next to it, divided by zero once. ``seen`` tells whether there is a point in the image, far outside."""
    objects = scene_objects(spark, SF).filter("scene_id = 1")
    rows = objects.select("object_id").orderBy("object_id").limit(2).collect()
    move = spark.createDataFrame([("q", 1, rows[0].object_id, rows[1].object_id, "left", "right", 4.0, new_y)], "request_id string, scene_id long, subject_id long, reference_id long, relation_before string, relation_after string, new_x double, new_y double")
    got = M.move_pairs(objects, move).select("a_truncated", "a_cx", "seen_a").collect()
    assert got and all((r.a_cx is not None) == seen and r.a_truncated == 1.0 and not r.seen_a for r in got)
    assert M.score(M.verify(objects, move, ROOM), ROOM).count() == 1


def test_toy_move(spark):
    objects = scene_objects(spark, SF).filter("scene_id = 1")
    first = objects.orderBy("object_id").first()
    move = spark.createDataFrame([(1, first.object_id, first.x + 1, first.y - 2)], "scene_id long, object_id long, new_x double, new_y double")
    got = M.toy_move(objects, move).first()
    assert (got.x, got.y, got.z) == (first.x + 1, first.y - 2, first.z)
    assert abs(got.xmin - first.xmin - 100) < 1e-9 and abs(got.depth - first.depth + 2) < 1e-9 and got.ymin == first.ymin


def test_config_defaults(tmp_path):
    path = tmp_path / "least.toml"
    path.write_text('scene_names = ["B", "A", "B"]\ncampaign_id = "x"\n')
    config = load_generation_config(path)
    assert (config.config_version, config.adapter, config.split, config.scene_names) == (1, "ai2thor", "train", ("A", "B"))
    (tmp_path / "other.toml").hardlink_to(path)
    with pytest.raises(ValueError):
        load_generation_config(path)


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('config_version = 1\nadapter = "tables"\nscene_names = ["A"]\nsplit = "train"\ncampaign_id = "x"\n')
    assert load_generation_config(path).seed == 20260723
    path.write_text(path.read_text() + "extra = 1\n")
    with pytest.raises(ValueError, match="extra"):
        load_generation_config(path)
    assert GenerationConfig(1, "tables", ("b", "a"), "train", "x").scene_names == ("a", "b")
    for names in ((), ("a", ""), tuple(map(str, range(33)))):
        with pytest.raises(ValueError, match="scene_names"):
            GenerationConfig(1, "tables", names, "train", "x")


def test_stages_that_died_are_built_again(spark, tmp_path):
    """A folder without its success marker is what a broken write leaves."""
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(3)

    (tmp_path / "stage" / "key=k" / "_temporary").mkdir(parents=True)
    assert generate.stage(spark, path, build, "k").count() == 3 and len(built) == 1
    assert generate.stage(spark, path, build, "k").count() == 3 and len(built) == 1


def test_generate_verify_inspect(spark, tmp_path, capsys):
    config = GenerationConfig(1, "tables", ("A",), "train", "quick", max_requests=12)
    objects = scene_objects(spark, SF).filter("scene_id < 120")
    root, work = tmp_path / "out", str(tmp_path / "work")
    manifest = generate.generate_dataset(spark, objects, config, root, work)
    assert manifest.record_count > 0
    outcomes = spark.read.parquet(f"{work}/outcomes")
    assert D.verify_dataset(spark, root, generate.records(outcomes)) == manifest
    found = D.inspect_dataset(spark, root)
    assert found["record_count"] == manifest.record_count == sum(found["relation_after"].values())
    with pytest.raises(FileExistsError):
        generate.generate_dataset(spark, objects, config, root, work)
    assert cli.main(["inspect", str(root)]) == 0 and json.loads(capsys.readouterr().out)["record_count"] == manifest.record_count
    lines = (root / "records.jsonl").read_text().splitlines()
    (root / "records.jsonl").write_text("\n".join(lines[:-1]) + "\n")
    with pytest.raises(ValueError, match="checksum"):
        D.verify_dataset(spark, root)
    assert cli.main(["verify", str(root)]) == 2 and json.loads(capsys.readouterr().err)["error"] == "ValueError"


def test_report_must_close():
    with pytest.raises(ValueError, match="frozen"):
        D.GenerationReport(1, 5, 3, 1, 2, 1, {})


def test_campaign_runs_each_request_once(spark, tmp_path):
    path, done = str(tmp_path / "requests"), str(tmp_path / "done")
    run = lambda: run_missing(spark, path, done, lambda d: d.withColumn("outcome", F.lit("ok")), str(tmp_path / "checkpoint"))
    spark.createDataFrame([("a",), ("b",), ("b",)], "request_id string").write.parquet(path)
    run()
    spark.createDataFrame([("b",), ("c",)], "request_id string").write.mode("append").parquet(path)
    run()
    run()
    assert sorted(r.request_id for r in spark.read.parquet(done).collect()) == ["a", "b", "c"]


def test_moves_are_translated_with_the_scene(spark):
    d = scene_objects(spark, SF).filter("scene_id < 200")
    requests = M.all_requests(d).filter("scene_id < 60")
    best = M.solve(d, requests, ROOM, strict=False, steps=(2.0,)).toPandas()
    again = M.solve(d, requests, ROOM, strict=False, steps=(2.0,)).toPandas()
    assert isinstance(best, pd.DataFrame) and sorted(best.request_id) == sorted(again.request_id)
    strict = M.solve(d, requests, ROOM, strict=True, steps=(2.0,)).toPandas()
    assert set(strict.request_id) <= set(best.request_id) and (strict.quality == "PURE").all()


def test_plan_searches_at_the_steps_of_the_reference(spark):
    d = scene_objects(spark, SF).filter("scene_id < 40").cache()
    requests = M.all_requests(d).cache()
    fine = generate.plan(d, requests).toPandas().set_index("request_id").sort_index()
    assert sorted(fine.index) == sorted(r.request_id for r in requests.collect())
    # every point of 0.1 m, verified without a filter before
    some = [*fine[fine.accepted].index[:3], *fine[~fine.accepted].index[:2]]
    moves = M.grid_moves(requests.filter(F.col("request_id").isin(some)), ROOM, 0.1)
    assert moves.count() == 5 * 101 * 101
    least = {r.request_id: r.total for r in M.score(M.verify(d, moves, ROOM), ROOM).filter("status = 'SUCCESS'").groupBy("request_id").agg(F.min("total").alias("total")).collect()}
    assert set(least) == set(some[:3])
    assert all(fine.total[k] <= v + 1e-12 for k, v in least.items())


def test_every_request_is_verified(spark):
    d = scene_objects(spark, SF).filter("scene_id < 40").cache()
    names = ("scene_id", "subject_id", "reference_id", "relation_before")
    held = {(r.scene_id, r.subject_id, r.reference_id, r.relation_before) for r in M.satisfied_requests(d).collect()}
    moves = scenes._mirror_moves(d)
    rows = M.verify(d, moves, ROOM).select("request_id", *names).collect()
    assert {tuple(r)[1:] for r in rows} == held and len({r.request_id for r in rows}) == len(rows) == len(held) > d.select("scene_id").distinct().count()
    near = {r.request_id for r in X.distance_requests(d).collect()}
    assert near == {":".join(map(str, h)) for h in held if h[3] in ("near", "far")}


@pytest.mark.parametrize("strict", [True, False])
def test_search_finds_what_verifying_every_point_finds(spark, strict):
    d = scene_objects(spark, SF).filter("scene_id < 40").cache()
    requests = M.all_requests(d).cache()
    least = ("translation", "total", "new_x", "new_y") if strict else ("total", "translation", "new_x", "new_y")
    columns = ("request_id", "new_x", "new_y", "total", "translation", "relation_damage", "leakage", "quality")
    plain = M.best_candidates(M.score(M.verify(d, M.grid_moves(requests, ROOM, 1.0), ROOM, strict), ROOM), least)
    found = M.solve(d, requests, ROOM, strict=strict, steps=(1.0,))
    assert sorted(plain.select(*columns).collect()) == sorted(found.select(*columns).collect()) != []
