"""Scenes as JSON documents and as recorded events, read with fixed schemas that fail on anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import camera as K

VEC3 = "struct<x:double,y:double,z:double>"
QUAT = "struct<x:double,y:double,z:double,w:double>"
BOX = f"struct<center:{VEC3},extent:{VEC3},rotation:{QUAT}>"
VIEW = "struct<camera_id:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,camera_depth:double,visible_fraction:double,image_area_fraction:double,truncated_fraction:double>"
RING = "array<struct<x:double,y:double>>"
SCENE = f"""scene_id string, source string, coordinate_system string, generation_seed long, room_polygon_xy {RING}, pinned_object_ids array<string>,
cameras array<struct<camera_id:string,width:int,height:int,intrinsics:array<double>,world_to_camera:array<double>>>,
objects array<struct<object_id:string,name:string,category:string,movable:boolean,request_eligible:boolean,position:{VEC3},rotation:{QUAT},obb:{BOX},support_object_id:string,views:map<string,{VIEW}>>>,
collision_obstacles array<struct<obstacle_id:string,source_object_id:string,clearance_m:double,obb:{BOX}>>,
subject_position_regions array<struct<region_id:string,subject_object_id:string,source_kind:string,source_sha256:string,components:array<struct<exterior:{RING},holes:array<{RING}>>>>>"""
EVENT = f"""scene_name string, fov double, width int, height int, camera_position {VEC3}, camera_yaw double, camera_horizon double, scene_bounds struct<center:{VEC3},size:{VEC3}>,
objects array<struct<objectId:string,name:string,objectType:string,moveable:boolean,pickupable:boolean,position:{VEC3},rotation:{VEC3},axisAlignedBoundingBox:struct<center:{VEC3},size:{VEC3}>,cornerPoints:array<{VEC3}>,parentReceptacles:array<string>>>"""
#: Parents that are part of the building and hold nothing up for planning.
STRUCTURAL = ("Floor", "Wall", "Ceiling", "Room", "Window", "Door")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """A row a document of the folder, with its file's stem. Another schema, a scene of another name or frame fails the read."""
    d = spark.read.schema(SCENE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    fine = (F.col("scene_id") == stem) & (F.col("coordinate_system") == "RH_METERS_Z_UP")
    return d.select("*", stem.alias("stem")).withColumn("scene_id", F.when(fine, F.col("scene_id")).otherwise(F.raise_error(F.concat(F.lit("not a scene document: "), "stem")))).drop("stem")


def scene_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_scenes(spark, path).select("scene_id").distinct().orderBy("scene_id")


def object_table(scenes: DataFrame, camera_id: str = "main") -> DataFrame:
    """The flat objects table of the operators, with the view of one camera."""
    d = scenes.select("scene_id", "pinned_object_ids", F.size("objects").cast("long").alias("scene_size"), F.explode("objects").alias("o"))
    view = F.col("o.views")[camera_id]
    from tessera.functions.geometry import yaw_degrees

    q = F.col("o.obb.rotation")
    return d.select(
        "scene_id", F.col("o.object_id").alias("object_id"), "scene_size", F.col("o.category").alias("category"), F.col("o.name").alias("name"),
        *[F.col(f"o.obb.center.{a}").alias(a) for a in "xyz"], *[F.col(f"o.obb.extent.{a}").alias(f"e{a}") for a in "xyz"], yaw_degrees(q["x"], q["y"], q["z"], q["w"]).alias("yaw"),
        ((view["bbox"]["xmin"] + view["bbox"]["xmax"]) / 2).alias("cx"), view["camera_depth"].alias("depth"), *[view["bbox"][n].alias(n) for n in ("xmin", "xmax", "ymin", "ymax")],
        *[view[n].alias(n) for n in ("visible_fraction", "image_area_fraction", "truncated_fraction")],
        F.col("o.movable").alias("movable"), F.coalesce("o.request_eligible", F.lit(True)).alias("request_eligible"), F.array_contains("pinned_object_ids", F.col("o.object_id")).alias("pinned"), F.col("o.support_object_id").alias("support_id"),
    )


def obstacle_table(scenes: DataFrame) -> DataFrame:
    """Obstacles as boxes, bare and grown by their clearance."""
    d = scenes.select("scene_id", F.explode(F.coalesce("collision_obstacles", F.array().cast(f"array<struct<obstacle_id:string,source_object_id:string,clearance_m:double,obb:{BOX}>>"))).alias("o"))
    grow = 2 * F.col("o.clearance_m")
    return d.select("scene_id", "o.obstacle_id", "o.source_object_id", *[F.col(f"o.obb.center.{a}").alias(a) for a in "xyz"], *[F.col(f"o.obb.extent.{a}").alias(f"e{a}") for a in "xyz"], *[(F.col(f"o.obb.extent.{a}") + grow).alias(f"grown_e{a}") for a in "xyz"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def event_objects(events: DataFrame) -> DataFrame:
    """Objects of recorded events (y upward) as boxes of scenes (z upward): a row an object, with its support, the first parent that is no part of the building."""
    parent_kind = "array<string>"
    d = events.select("scene_name", F.transform(F.filter("objects", lambda o: o["objectType"].isin(*STRUCTURAL)), lambda o: o["objectId"]).alias("building"), F.explode("objects").alias("o"))
    corners = F.transform("o.cornerPoints", K.swap_up_axis)
    turned = K.box_from_corners(corners, -F.col("o.rotation.y"))
    flat = F.struct(K.swap_up_axis(F.col("o.axisAlignedBoundingBox.center")).alias("center"), K.swap_up_axis(F.col("o.axisAlignedBoundingBox.size")).alias("extent"))
    oriented = F.coalesce(F.size("o.cornerPoints") == 8, F.lit(False))
    held = F.filter(F.coalesce("o.parentReceptacles", F.array().cast(parent_kind)), lambda p: ~F.array_contains("building", p))
    return d.select(
        F.col("scene_name").alias("scene_id"), F.col("o.objectId").alias("object_id"), F.col("o.name").alias("name"), F.col("o.objectType").alias("category"),
        F.when(oriented, turned).otherwise(flat).alias("box"), F.when(oriented, -F.col("o.rotation.y")).otherwise(0.0).alias("yaw"),
        (F.col("o.moveable") | F.col("o.pickupable")).alias("movable"), F.get(held, F.lit(0)).alias("support_id"),
        F.when(F.size(held) > 1, "MULTIPLE_AMBIGUOUS").when(F.size(held) == 1, "RECEPTACLE").when(F.exists(F.coalesce("o.parentReceptacles", F.array().cast(parent_kind)), lambda p: p.startswith("Floor")), "FLOOR").otherwise("UNKNOWN").alias("support_kind"),
    ).select("*", *[F.col(f"box.center.{a}").alias(a) for a in "xyz"], *[F.col(f"box.extent.{a}").alias(f"e{a}") for a in "xyz"]).drop("box")


def event_rooms(events: DataFrame) -> DataFrame:
    """The scene's bounds as a rectangle, counter-clockwise."""
    c, s = F.col("scene_bounds.center"), F.col("scene_bounds.size")
    at = lambda i, j: F.struct((c["x"] + i * s["x"] / 2).alias("x"), (c["z"] + j * s["z"] / 2).alias("y"))
    return events.select(F.col("scene_name").alias("scene_id"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("room"))


def event_cameras(events: DataFrame) -> DataFrame:
    p = F.col("camera_position")
    return events.select(F.col("scene_name").alias("scene_id"), F.lit("main").alias("camera_id"), "width", "height", K.intrinsics(F.col("fov"), F.col("width").cast("double"), F.col("height").cast("double")).alias("intrinsics"), K.world_to_camera(p["x"], p["z"], p["y"], F.col("camera_yaw"), F.col("camera_horizon")).alias("world_to_camera"))


def view_metrics(pixels: DataFrame, projected_area: Column, bbox_area: Column, clipped_area: Column, image_area: Column) -> DataFrame:
    """Of a pixel table (scene_id, object_id, mask): visible share of the projected box, share of the image, and truncated share, each from 0 to 1."""
    unit = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    return pixels.groupBy("scene_id", "object_id").agg(F.count_if("mask").alias("mask_pixels"), F.first(projected_area).alias("p"), F.first(bbox_area).alias("b"), F.first(clipped_area).alias("c"), F.first(image_area).alias("i")).select(
        "scene_id", "object_id", unit(F.col("mask_pixels") / F.col("p")).alias("visible_fraction"), unit(F.col("b") / F.col("i")).alias("image_area_fraction"), unit(1 - F.col("c") / F.col("p")).alias("truncated_fraction")
    )


def remap_ids(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Observed objects with the known ids of the same names, supports too; names must be unique and the same in both, or the row fails."""
    names = known.select("scene_id", "name", F.col("object_id").alias("known_id"))
    counts = names.groupBy("scene_id", "name").agg(F.count("*").alias("n"), F.min("known_id").alias("known_id"))
    d = observed.join(counts, ["scene_id", "name"], "left").withColumn("known_id", F.when(F.col("n") == 1, F.col("known_id")).otherwise(F.raise_error(F.concat(F.lit("no single known object is named "), "name"))))
    ids = d.select("scene_id", F.col("object_id").alias("support_id"), F.col("known_id").alias("known_support"))
    return d.join(ids, ["scene_id", "support_id"], "left").withColumns({"object_id": F.col("known_id"), "support_id": F.col("known_support")}).drop("n", "known_id", "known_support")


def write_point_cloud(objects: DataFrame) -> DataFrame:
    """A row a scene: the centres of its boxes as an ASCII PLY document."""
    line = F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"])
    d = objects.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("object_id", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("l").cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nend_header\n"))
    return d.select("scene_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("ply"))
