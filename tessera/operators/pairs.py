"""Pairs of objects of a scene and the relations that hold between them.

An objects table has a row an object: scene_id, object_id, x, y, z, ex, ey, ez (centre and full extents), cx and depth
(image centre and camera depth), visible_fraction, image_area_fraction, truncated_fraction, and, where boxes are turned,
yaw in degrees. Every join carries ``scene_id``, so that it is an equality join whose size is that of the scenes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import relations as R

BOX = ("x", "y", "z", "ex", "ey", "ez")
#: Width of the cells of a tolerance join, in tolerances.
COARSE = 64
VIEW = ("cx", "depth", "visible_fraction", "image_area_fraction", "truncated_fraction")


def side(objects: DataFrame, prefix: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The objects with all columns but scene_id prefixed."""
    names = columns or tuple(c for c in objects.columns if c != "scene_id")
    return objects.select("scene_id", *[F.col(c).alias(f"{prefix}_{c}") for c in names])


def scenes(objects: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A row a scene: scene_id, ``all``, its objects as structs of ``names``, and ``held``, the ids that hold an object up if objects have a support_id.

    The objects are looked through once, and what is made of a row by explosion stays where the scene is, so that no
    further shuffle by scene_id, alone or with other keys, is needed.
    """
    held = [F.collect_set("support_id").alias("held")] if "support_id" in objects.columns else []
    return objects.filter("scene_id IS NOT NULL").groupBy("scene_id").agg(F.collect_list(F.struct(*names)).alias("all"), *held)


def each(d: DataFrame, prefix: str, names: tuple[str, ...], condition: Column | None = None) -> DataFrame:
    """A row of ``d`` (see ``scenes``) for every object of its scene for which the condition on ``o`` holds, its columns prefixed."""
    d = d.withColumn("o", F.explode("all"))
    d = d if condition is None else d.filter(condition)
    return d.select(*[x for x in d.columns if x != "o"], *[F.col("o")[n].alias(f"{prefix}_{n}") for n in names])


def ordered_pairs(objects: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All (subject, reference) of a scene, prefixed s and r."""
    names = tuple(dict.fromkeys(("object_id", *(columns or tuple(c for c in objects.columns if c != "scene_id")))))
    return pairs_of(scenes(objects, names), names).drop("all", "held")


def pairs_of(scene: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The ordered pairs of each of ``scenes``."""
    return each(each(scene, "s", names), "r", names, F.col("o.object_id") != F.col("s_object_id"))


def unordered_pairs(objects: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    return ordered_pairs(objects, columns).filter("s_object_id < r_object_id")


def c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}_{name}")


def both_visible(a: str = "s", b: str = "r") -> Column:
    see = lambda p: R.is_visible(c(p, "visible_fraction"), c(p, "image_area_fraction"), c(p, "truncated_fraction"))
    return see(a) & see(b)


def footprints(a: str, b: str) -> Column:
    """struct(a, b): the plans of two turned boxes."""
    return F.struct(*[G.footprint(c(p, "x"), c(p, "y"), c(p, "ex"), c(p, "ey"), c(p, "yaw")).alias(n) for n, p in (("a", a), ("b", b))])


def ground_gap(a: str = "s", b: str = "r", turned: bool = False) -> Column:
    """The distance of the footprints; boxes along the axes need no polygons."""
    if turned:
        return G.let(footprints(a, b), lambda f: G.gap(f["a"], f["b"]))
    return G.box_gap(c(a, "x") - c(b, "x"), c(a, "y") - c(b, "y"), c(a, "ex") + c(b, "ex"), c(a, "ey") + c(b, "ey"))


def with_relations(pairs: DataFrame, turned: bool = False, width: float = 640.0) -> DataFrame:
    """Adds seen, dx, dd, gap and ``labels``, the sorted array of satisfied relations."""
    d = pairs.withColumns({"seen": both_visible(), "dx": c("r", "cx") - c("s", "cx"), "dd": c("r", "depth") - c("s", "depth"), "gap": ground_gap(turned=turned)})
    return d.withColumn("labels", R.labels(F.col("seen"), F.col("dx"), F.col("dd"), F.col("gap"), width))


def observations(pairs: DataFrame, turned: bool = False) -> DataFrame:
    """A row a pair and relation: relation, satisfied, margin, status."""
    d = with_relations(pairs, turned)
    rows = R.observe_all(F.col("seen"), F.col("dx"), F.col("dd"), F.col("gap"))
    return d.withColumn("o", F.explode(rows)).select(*[x for x in d.columns if x != "labels"], "o.*")


def box_intersection(a: str = "s", b: str = "r") -> Column:
    """Common area of two boxes along the axes, 0 without any."""
    wide = F.least(c(a, "x") + c(a, "ex") / 2, c(b, "x") + c(b, "ex") / 2) - F.greatest(c(a, "x") - c(a, "ex") / 2, c(b, "x") - c(b, "ex") / 2)
    deep = F.least(c(a, "y") + c(a, "ey") / 2, c(b, "y") + c(b, "ey") / 2) - F.greatest(c(a, "y") - c(a, "ey") / 2, c(b, "y") - c(b, "ey") / 2)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(deep, F.lit(0.0))


def z_overlap(a: str = "s", b: str = "r") -> Column:
    return G.z_overlap(c(a, "z"), c(a, "ez"), c(b, "z"), c(b, "ez"))


def collides(a: str = "s", b: str = "r", turned: bool = False) -> Column:
    if turned:
        area = G.let(footprints(a, b), lambda f: G.overlap_area(f["a"], f["b"]))
    else:
        area = box_intersection(a, b)
    return (area > G.CONTACT) & (z_overlap(a, b) > G.CONTACT)


def inside_rectangle(prefix: str, room: tuple[float, float, float, float], tolerance: float = G.ROOM_TOLERANCE) -> Column:
    """Whether a box along the axes stands in a rectangular room (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = room
    return (c(prefix, "x") - c(prefix, "ex") / 2 >= x0 - tolerance) & (c(prefix, "x") + c(prefix, "ex") / 2 <= x1 + tolerance) & (c(prefix, "y") - c(prefix, "ey") / 2 >= y0 - tolerance) & (c(prefix, "y") + c(prefix, "ey") / 2 <= y1 + tolerance)


def bind_within(observed: DataFrame, frozen: DataFrame, tolerance: float, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Each observed point (oid, x, y, z) with the frozen points (fid, x, y, z) within ``tolerance`` of it, and how many these are.

    Grid cells are ``COARSE`` tolerances wide and frozen points go to all that lie within the tolerance of them, mostly one,
    so that the join is one of equal cells and hardly copies a point.
    """
    wide, reach = COARSE * tolerance, tolerance * (1 + 1e-6)  # rounding must not lose a point on the edge
    index = lambda v: F.floor(v / wide)
    cell = lambda p: [index(F.col(f"{p}{a}")).alias(f"c{a}") for a in "xyz"]
    left = observed.select(*keys, "oid", *[F.col(a).alias(f"o{a}") for a in "xyz"])
    left = left.select("*", *cell("o"))
    right = frozen.select(*keys, "fid", *[F.col(a).alias(f"f{a}") for a in "xyz"])
    for a in "xyz":
        ulps = reach + 1e-15 * F.abs(f"f{a}")
        right = right.withColumn(f"c{a}", F.explode(F.sequence(index(F.col(f"f{a}") - ulps), index(F.col(f"f{a}") + ulps))))
    distance = F.sqrt(sum((F.pow(F.col(f"o{a}") - F.col(f"f{a}"), 2) for a in "xyz"), F.lit(0.0)))
    hits = left.join(right, [*keys, "cx", "cy", "cz"]).filter(distance <= tolerance)
    found = hits.groupBy(*keys, "oid").agg(F.count("*").alias("matches"), F.min("fid").alias("fid"))
    return left.select(*keys, "oid").join(found, [*keys, "oid"], "left").select(*keys, "oid", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("fid")).alias("fid"))


def support_closure(edges: DataFrame) -> DataFrame:
    """All (scene_id, child, ancestor) of the edges (scene_id, child, parent); members of a cycle reach themselves.

    A scene's edges are few (an object has few parents), so they are gathered and followed in one place, as often as
    there are edges at most.
    """
    parents = edges.groupBy("scene_id", "child").agg(F.collect_set("parent").alias("parents"))
    scenes = parents.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("child", "parents"))).alias("up"))
    d = scenes.select("scene_id", "up", F.explode("up").alias("child", "parents"))
    none = F.array().cast(parents.schema["parents"].dataType)
    follow = lambda found, _: F.array_union(found, F.flatten(F.transform(found, lambda x: F.coalesce(F.col("up")[x], none))))
    return d.select("scene_id", "child", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("up")), F.col("parents"), follow)).alias("ancestor"))
