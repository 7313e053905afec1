"""Verification with turned boxes and with each scene's own camera and room."""

import math

from pyspark.sql import functions as F

from tessera.operators import moves as M

ROOM = (-1.0, -1.0, 9.0, 9.0)


def objects(spark, rows):
    """Rows (scene, id, x, y, ex, ey, yaw), seen by a camera at (4, -2) that looks along y."""
    names = "scene_id long, object_id long, x double, y double, ex double, ey double, yaw double"
    d = spark.createDataFrame(rows, names).withColumns({"z": F.lit(0.5), "ez": F.lit(1.0), "support_id": F.lit(None).cast("long"), "movable": F.lit(True), "pinned": F.lit(False), "visible_fraction": F.lit(1.0), "image_area_fraction": F.lit(0.1), "truncated_fraction": F.lit(0.0), "scene_size": F.lit(3)})
    d = d.withColumns({"depth": F.col("y") + 2, "cx": (F.col("x") - 4) * 320 / (F.col("y") + 2) + 320})
    return d.withColumns({"xmin": F.col("cx") - 5, "xmax": F.col("cx") + 5, "ymin": F.lit(230.0), "ymax": F.lit(250.0)})


def moves(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, subject_id long, reference_id long, relation_before string, relation_after string, request_id string, new_x double, new_y double")


def test_a_turned_plank_collides(spark):
    # a plank of 2 m at 45 degrees whose corner reaches into another box, though unturned boxes would be apart
    rows = [(1, 1, 1.0, 7.0, 2.0, 0.1, 45.0), (1, 2, 4.7, 4.7, 0.3, 0.3, 0.0), (1, 3, 7.0, 1.0, 0.3, 0.3, 30.0)]
    move = [(1, 1, 3, "left", "right", "a", 4.0, 4.0), (1, 1, 3, "left", "right", "b", 7.9, 5.0), (1, 1, 3, "left", "right", "c", 8.5, 5.0)]
    found = {r.request_id: r.errors for r in M.verify(objects(spark, rows), moves(spark, move), ROOM).collect()}
    assert found == {"a": "collision:2", "b": "", "c": "outside_room"}
    flat = {r.request_id: r.errors for r in M.verify(objects(spark, rows).drop("yaw"), moves(spark, move), ROOM).collect()}
    assert flat == {"a": "", "b": "", "c": "outside_room"}


def test_gaps_of_turned_boxes(spark):
    rows = [(1, 1, 0.0, 0.0, 2.0, 2.0, 45.0), (1, 2, 1.9, 0.0, 0.2, 0.2, 0.0), (1, 3, 8.0, 8.0, 0.2, 0.2, 0.0)]
    near = {(r.subject_id, r.reference_id) for r in M.satisfied_requests(objects(spark, rows)).collect() if r.relation_before == "near"}
    assert (1, 2) in near  # the corner at 1.414 is within 0.5 of the box at 1.8
    assert (1, 2) not in {(r.subject_id, r.reference_id) for r in M.satisfied_requests(objects(spark, rows).drop("yaw")).collect() if r.relation_before == "near"}


def test_each_scene_has_its_camera_and_room(spark):
    """A scene turned about a point together with its camera and room is verified and scored as it was."""
    base = [(1, 1, 2.0, 3.0, 0.6, 0.3, 20.0), (1, 2, 5.0, 4.0, 0.4, 0.4, 75.0), (1, 3, 6.5, 7.0, 0.5, 0.2, 0.0)]
    tries = [(1, 2, 3, "left", "right", f"{k}", 4.0 + 0.5 * k, 2.0 + 0.6 * k) for k in range(11)]
    turn = lambda x, y, q: [(x, y), (-y, x), (-x, -y), (y, -x)][q]
    d, m, views = [], [], []
    plain = objects(spark, base)
    for q in range(4):
        cam, corners = turn(4.0, -2.0, q), (turn(-1.0, -1.0, q), turn(9.0, 9.0, q))
        xs, ys = sorted(p[0] for p in corners), sorted(p[1] for p in corners)
        views.append((q, *cam, 1.5, 90.0 * q, 320.0, 640.0, 480.0, xs[0], ys[0], xs[1], ys[1]))
        for r in plain.collect():
            x, y = turn(r.x, r.y, q)
            d.append((q, r.object_id, x, y, r.ex, r.ey, r.yaw + 90.0 * q, r.cx, r.depth, r.xmin, r.xmax, r.ymin, r.ymax))
        for t in tries:
            m.append((q, *t[1:6], *turn(t[6], t[7], q)))
    names = "scene_id long, object_id long, x double, y double, ex double, ey double, yaw double, cx double, depth double, xmin double, xmax double, ymin double, ymax double"
    rest = {n: F.lit(v) for n, v in (("z", 0.5), ("ez", 1.0), ("movable", True), ("pinned", False), ("visible_fraction", 1.0), ("image_area_fraction", 0.1), ("truncated_fraction", 0.0), ("scene_size", 3))}
    world = spark.createDataFrame(d, names).withColumns(rest).withColumn("support_id", F.lit(None).cast("long"))
    view = spark.createDataFrame(views, "scene_id long, " + ", ".join(f"{n} double" for n in M.VIEW))
    out = M.score(M.verify(world, moves(spark, m), ROOM, views=view, key=("request_id", "new_x", "new_y")), ROOM).collect()
    alone = {r.request_id: r for r in M.score(M.verify(plain, moves(spark, tries), ROOM), ROOM).collect()}
    assert len(out) == 4 * len(tries) and len({r.status for r in out}) > 1
    for r in out:
        o = alone[r.request_id]
        assert (r.status, r.errors, r.changed) == (o.status, o.errors, o.changed)
        assert all(math.isclose(r[n], o[n], abs_tol=1e-9) for n in ("translation", "damage", "visibility", "safety", "total"))
    # another room alone makes other errors
    small = view.withColumn("room_x1", F.col("room_x0") + 1)
    outside = lambda rows: sum("outside_room" in r.errors for r in rows)
    assert outside(M.verify(world, moves(spark, m), ROOM, views=small).collect()) > outside(out) + 20
