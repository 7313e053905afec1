"""Evidence that planning rests on: camera poses and their scores, native grids and patches, reachable targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import relations as R

from .pairs import side

RADIUS = 2.0
DIRECTIONS = ((0, -1), (1, 0), (0, 1), (-1, 0))
GRID_SIDE = 21
#: Bits of a long that say which points a block has.
WORD = 63


def reachable_positions(objects: DataFrame) -> DataFrame:
    """Recorded positions of the agent (scene_id, mx, my, px, pz): for the driver's scenes, a 5 x 5 grid of 1 m about the middle of the objects."""
    d = objects.groupBy("scene_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    steps = F.sequence(F.lit(-2), F.lit(2))
    d = d.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return d.select("scene_id", "mx", "my", (F.round(F.col("mx") * 2) / 2 + F.col("i")).alias("px"), (F.round(F.col("my") * 2) / 2 + F.col("j")).alias("pz"))


def clear_positions(positions: DataFrame, objects: DataFrame, radius: float) -> DataFrame:
    """Positions with more than ``radius`` to every movable footprint of their scene."""
    boxes = objects.filter("movable").select(F.col("scene_id").alias("o_scene"), "x", "y", "ex", "ey")
    gx, gy = F.greatest(F.abs(F.col("px") - F.col("x")) - F.col("ex") / 2, F.lit(0.0)), F.greatest(F.abs(F.col("pz") - F.col("y")) - F.col("ey") / 2, F.lit(0.0))
    return positions.join(boxes, (F.col("scene_id") == F.col("o_scene")) & (F.sqrt(gx * gx + gy * gy) <= radius), "left_anti")


def ring_positions(positions: DataFrame) -> DataFrame:
    """For each direction of the ring the nearest position, ties by x and z; a position that serves two directions is kept once, for the first."""
    ring = F.array(*[F.struct(F.lit(k).cast("long").alias("direction"), F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dz")) for k, (a, b) in enumerate(DIRECTIONS)])
    d = positions.withColumn("d", F.explode(ring))
    gx, gz = F.col("px") - (F.col("mx") + RADIUS * F.col("d.dx")), F.col("pz") - (F.col("my") + RADIUS * F.col("d.dz"))
    # rounded, so that places that are equally far tie
    nearest = d.groupBy("scene_id", F.col("d.direction").alias("direction")).agg(F.min(F.struct(F.round(gx * gx + gz * gz, 9).alias("d2"), "px", "pz")).alias("p"))
    return nearest.groupBy("scene_id", F.col("p.px").alias("px"), F.col("p.pz").alias("pz")).agg(F.min("direction").alias("direction"))


def pose_bank(positions: DataFrame) -> DataFrame:
    """The ring's poses in order: scene_id, pose_index, px, pz."""
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("direction")).cast("long") - 1
    return ring_positions(positions).withColumn("pose_index", rank)


def pose_views(objects: DataFrame, poses: DataFrame, least_depth: float = 0.1) -> DataFrame:
    """Every object from every pose: whether its category is its scene's only one, and whether it stands in the view of a camera of 90 degrees looking along z."""
    d = poses.join(side(objects, "o", ("category", "movable", "x", "y")), "scene_id")
    ahead, across = F.col("o_y") - F.col("pz"), F.col("o_x") - F.col("px")
    single = F.count("*").over(Window.partitionBy("scene_id", "pose_index", "o_category")) == 1
    return d.withColumns({"single": single, "visible": (ahead > least_depth) & (F.abs(across) <= ahead)})


def camera_scores(views: DataFrame) -> DataFrame:
    seen = F.col("single") & F.col("visible")
    return views.groupBy("scene_id", "pose_index").agg(F.count_if(seen & F.col("o_movable")).alias("movable_visible"), F.count_if(seen).alias("all_visible"))


def best_pose(scores: DataFrame) -> DataFrame:
    """The pose that shows most movable, then most objects; the first of equals."""
    best = F.max_by(F.struct("pose_index", "movable_visible", "all_visible"), F.struct("movable_visible", "all_visible", -F.col("pose_index")))
    return scores.groupBy("scene_id").agg(best.alias("b")).select("scene_id", "b.*")


def native_grid(objects: DataFrame) -> DataFrame:
    """Native points (scene_id, position, x, z): for the driver's scenes two grids of 21 x 21 on each scene's first object; some scenes lack a point."""
    n = GRID_SIDE * GRID_SIDE
    d = objects.filter("object_id = 1").select("scene_id", "x", "y", "ex", "ey").withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))))
    d = d.filter((F.col("scene_id") % 7 != 0) | (F.col("position") != n + 17))
    at = F.col("position") % n
    x = F.col("x") - F.col("ex") / 2 + F.floor(F.col("position") / n) * 2 + F.col("ex") * (at % GRID_SIDE) / (GRID_SIDE - 1)
    return d.select("scene_id", "position", x.alias("px"), (F.col("y") - F.col("ey") / 2 + F.col("ey") * F.floor(at / GRID_SIDE) / (GRID_SIDE - 1)).alias("pz"))


def patches(points: DataFrame) -> DataFrame:
    """Bounds of every block of points; a scene with an incomplete block has no patch at all."""
    n = GRID_SIDE * GRID_SIDE
    # a position of a block is a bit of a few numbers, so that a point is added to its block at once and never kept
    index, bit = F.floor(F.col("position") / n).cast("long"), F.pmod("position", F.lit(n))
    words = range(-(-n // WORD))
    had = [F.bit_or(F.when((bit >= w * WORD) & (bit < (w + 1) * WORD), F.call_function("shiftleft", F.lit(1).cast("long"), (bit - w * WORD).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    blocks = points.groupBy("scene_id", index.alias("patch_index")).agg(F.min("px").alias("x_min"), F.max("px").alias("x_max"), F.min("pz").alias("z_min"), F.max("pz").alias("z_max"), *had)
    # positions without a number count for no block
    whole = F.coalesce(sum((F.bit_count(f"w{w}") for w in words), F.lit(0)), F.lit(0)) == n
    blocks = blocks.withColumn("whole", F.min(whole).over(Window.partitionBy("scene_id"))).filter("whole OR scene_id IS NULL")
    return blocks.drop("whole", *[f"w{w}" for w in words])


def target_reachability(candidates: DataFrame, positions: DataFrame, focal: float = 320.0, camera_x: float = 4.0, camera_y: float = -2.0) -> DataFrame:
    """For each candidate at how many native positions its subject would stand in the target relation."""
    names = ["scene_id", "s_object_id", "r_object_id", "relation"]
    d = candidates.select(*names, "s_ex", "s_ey", "r_x", "r_y", "r_ex", "r_ey", "r_cx", "r_depth").join(positions.select("scene_id", "px", "pz"), "scene_id")
    depth = F.col("pz") - camera_y
    dx, dd = F.col("r_cx") - ((F.col("px") - camera_x) * focal / depth + 320.0), F.col("r_depth") - depth
    gx = F.greatest(F.abs(F.col("px") - F.col("r_x")) - (F.col("s_ex") + F.col("r_ex")) / 2, F.lit(0.0))
    gy = F.greatest(F.abs(F.col("pz") - F.col("r_y")) - (F.col("s_ey") + F.col("r_ey")) / 2, F.lit(0.0))
    gap = F.sqrt(gx * gx + gy * gy)
    after = R.lookup(R.OPPOSITE, F.col("relation"))
    holds = F.when(after == "left", dx >= 32).when(after == "right", -dx >= 32).when(after == "front", dd >= R.DEPTH_M).when(after == "behind", -dd >= R.DEPTH_M).when(after == "near", gap <= R.NEAR_M).otherwise(gap >= R.FAR_M)
    out = d.groupBy(*names).agg(F.count_if((depth > 0.1) & holds).alias("reaching"))
    return out.withColumn("status", F.when(F.col("reaching") > 0, "REACHABLE_NATIVE_TARGET").otherwise("NO_REACHABLE_NATIVE_TARGET"))
