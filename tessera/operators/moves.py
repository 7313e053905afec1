"""Moving one object of a scene in the plane: what changes, whether that is allowed, and what it costs.

A moves table has a row a candidate: request_id, scene_id, subject_id, reference_id, relation_before, relation_after,
new_x, new_y. No scene is copied: a candidate's rows are the pairs of its subject with the scene's other objects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import relations as R

from .pairs import c, collides, each, ground_gap, inside_rectangle, scenes, with_relations, z_overlap
from .search import best_points

WEIGHTS = {"translation": 1.0, "damage": 5.0, "visibility": 2.0, "safety": 1.0}
#: The reference's steps of the grid and of its two refinements, in metres.
STEPS = (0.1, 0.05, 0.01)
#: A scene's own camera and room: place, height, turn (degrees; 0 looks along y), focal length and size of the image in pixels, and the room's rectangle.
VIEW = ("camera_x", "camera_y", "camera_z", "camera_yaw", "focal", "width", "height", "room_x0", "room_y0", "room_x1", "room_y1")
STRUCT = ("object_id", "x", "y", "z", "ex", "ey", "ez", "cx", "depth", "xmin", "xmax", "ymin", "ymax", "visible_fraction", "image_area_fraction", "truncated_fraction", "support_id")


def satisfied_requests(objects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All (scene_id, subject_id, reference_id, relation_before, relation_after) that hold now with a subject that may move. Boxes with a ``yaw`` are turned.

    Columns of the objects to ``keep`` follow, prefixed s and r.
    """
    turned = "yaw" in objects.columns
    names = tuple(dict.fromkeys(("object_id", "x", "y", "ex", "ey", "cx", "depth", "visible_fraction", "image_area_fraction", "truncated_fraction", "movable", "pinned", *(("yaw",) if turned else ()), *keep)))
    movers = each(scenes(objects, names), "s", names, F.col("o.movable") & ~F.col("o.pinned") & ~F.array_contains("held", F.col("o.object_id")))
    pairs = with_relations(each(movers, "r", names, F.col("o.object_id") != F.col("s_object_id")), turned)
    # not by the column ``labels``: Spark would filter pairs by its size first and so work everything out twice, in code too large to be compiled
    found = R.labels(F.col("seen"), F.col("dx"), F.col("dd"), F.col("gap"))
    d = pairs.select("scene_id", F.col("s_object_id").alias("subject_id"), F.col("r_object_id").alias("reference_id"), F.explode(found).alias("relation_before"), *[F.col(f"{p}_{n}") for p in "sr" for n in keep])
    return d.select(*d.columns[:4], R.lookup(R.OPPOSITE, F.col("relation_before")).alias("relation_after"), *d.columns[4:])


def all_requests(objects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every satisfied request; its id is made of scene, subject, reference and relation. For ``keep`` see ``satisfied_requests``."""
    return satisfied_requests(objects, keep).withColumn("request_id", F.concat_ws(":", "scene_id", "subject_id", "reference_id", "relation_before"))


def with_camera(d: DataFrame, focal: float | Column, camera_x: float | Column, camera_y: float | Column, width: float | Column, height: float | Column, camera_z: float | Column = 1.5, camera_yaw: Column | None = None) -> DataFrame:
    """Adds the subject's view after the move: a_cx, a_depth, a_xmin, a_xmax, a_truncated. The box keeps its size; residuals of the observed view stay.

    At or behind the camera there is no view: the columns of the image are null and all of the box is cut off. So it is
    where the box is so near to the camera's plane that its image has no width in doubles.
    """
    if camera_yaw is None:
        across = lambda x, y: F.col(x) - camera_x
        along = lambda x, y: F.col(y) - camera_y
    else:
        cos, sin = F.cos(F.radians(camera_yaw)), F.sin(F.radians(camera_yaw))
        across = lambda x, y: (F.col(x) - camera_x) * cos + (F.col(y) - camera_y) * sin
        along = lambda x, y: (F.col(y) - camera_y) * cos - (F.col(x) - camera_x) * sin
    ahead = lambda x, y: F.when(along(x, y) > 0, along(x, y))
    depth_before, depth = ahead("s_x", "s_y"), ahead("new_x", "new_y")
    du = F.col("s_cx") - (across("s_x", "s_y") * focal / depth_before + width / 2)
    cx = across("new_x", "new_y") * focal / depth + width / 2 + du
    half_w, half_h = (F.col("s_xmax") - F.col("s_xmin")) / 2, (F.col("s_ymax") - F.col("s_ymin")) / 2
    rise = F.lit(camera_z) - F.col("s_z")  # below the camera
    cy = (F.col("s_ymin") + F.col("s_ymax")) / 2 + focal * rise / depth - focal * rise / depth_before
    d = d.withColumns({"a_depth": along("new_x", "new_y") + (F.col("s_depth") - along("s_x", "s_y")), "a_cx": cx, "a_xmin": cx - half_w, "a_xmax": cx + half_w, "a_ymin": cy - half_h, "a_ymax": cy + half_h})
    clip = lambda lo, hi, most: F.greatest(F.lit(0.0), F.least(F.col(hi), F.lit(most).cast("double")) - F.greatest(F.col(lo), F.lit(0.0)))
    area = (F.col("a_xmax") - F.col("a_xmin")) * (F.col("a_ymax") - F.col("a_ymin"))
    return d.withColumn("a_truncated", F.when(F.col("a_cx").isNull() | (area <= 0), 1.0).otherwise(1 - clip("a_xmin", "a_xmax", width) * clip("a_ymin", "a_ymax", height) / area))


def toy_move(objects: DataFrame, moves: DataFrame, pixels_per_metre: float = 100.0) -> DataFrame:
    """The objects that ``moves`` (scene_id, object_id, new_x, new_y) names, moved under the toy camera of JSON scenes: the image box shifts with x, the depth with y; heights, sizes and shares stay."""
    d = objects.join(moves, ["scene_id", "object_id"])
    dx, dy = F.col("new_x") - F.col("x"), F.col("new_y") - F.col("y")
    shift = {n: F.col(n) + pixels_per_metre * dx for n in ("xmin", "xmax", "cx")}
    return d.withColumns({**shift, "depth": F.col("depth") + dy, "x": F.col("new_x"), "y": F.col("new_y")}).drop("new_x", "new_y")


def move_pairs(objects: DataFrame, moves: DataFrame, focal: float = 320.0, camera_x: float = 4.0, camera_y: float = -2.0, width: float = 640.0, height: float = 480.0, views: DataFrame | None = None) -> DataFrame:
    """A row a candidate and other object, with the masks of labels of both directions before (fb, rb) and after (fa, ra), the gaps, and whether the moved subject collides.

    Candidates meet their scene once, by scene_id; it has the subject, the others, and the ids ``held`` that hold an object up.

    With ``views``, a row a scene with the columns ``VIEW``, each scene has its own camera (and its columns stay); scenes
    without one have no rows. Where objects have a ``yaw``, boxes are turned by it.
    """
    turned = "yaw" in objects.columns
    struct = (*STRUCT, "yaw") if turned else STRUCT
    whole = (*struct, "movable", "pinned", "scene_size")
    d = each(moves.join(scenes(objects, whole), "scene_id"), "s", whole, F.col("o.object_id") == F.col("subject_id")).drop("s_object_id")
    if views is None:
        d = with_camera(d, focal, camera_x, camera_y, width, height)
    else:
        d = d.join(views.select("scene_id", *VIEW), "scene_id")
        d = with_camera(d, *[F.col(n) for n in ("focal", "camera_x", "camera_y", "width", "height", "camera_z", "camera_yaw")])
        width = F.col("width")
    d = each(d, "r", struct, F.col("o.object_id") != F.col("subject_id")).drop("all")
    d = d.withColumns({"m_x": F.col("new_x"), "m_y": F.col("new_y"), **{f"m_{n}": F.col(f"s_{n}") for n in ("z", "ex", "ey", "ez", *(("yaw",) if turned else ()))}})
    see = lambda p, t: R.is_visible(c(p, "visible_fraction"), c(p, "image_area_fraction"), t)
    other = see("r", c("r", "truncated_fraction"))
    # distances once, as columns: the labels name them often
    d = d.withColumns({"gap_b": ground_gap("s", "r", turned), "gap_a": ground_gap("m", "r", turned)})
    before = (see("s", c("s", "truncated_fraction")) & other, c("r", "cx") - c("s", "cx"), c("r", "depth") - c("s", "depth"), F.col("gap_b"))
    after = (see("s", F.col("a_truncated")) & other, c("r", "cx") - F.col("a_cx"), c("r", "depth") - F.col("a_depth"), F.col("gap_a"))
    turn = lambda o: (o[0], -o[1], -o[2], o[3])
    d = d.withColumns({"seen_b": before[0], "seen_a": after[0], "dx_a": after[1], "dd_a": after[2]})
    d = d.withColumns({"fb": R.mask(*before, width), "fa": R.mask(*after, width), "rb": R.mask(*turn(before), width), "ra": R.mask(*turn(after), width)})
    # what holds the subject up may touch it
    free = ~F.coalesce(F.col("r_object_id") == F.col("s_support_id"), F.lit(False))
    return d.withColumns({"hits": free & collides("m", "r", turned), "z_common": z_overlap("m", "r"), "free": free})


def half_extents(prefix: str, turned: bool) -> tuple[Column, Column]:
    """Half of a box's extents along x and y, of a turned one those of its bounds."""
    ex, ey = c(prefix, "ex") / 2, c(prefix, "ey") / 2
    if not turned:
        return ex, ey
    cos, sin = (F.abs(f(F.radians(c(prefix, "yaw")))) for f in (F.cos, F.sin))
    return cos * ex + sin * ey, sin * ex + cos * ey


def _differs(axis: str) -> Column:
    return F.col("fb").bitwiseXOR(F.col("fa")).bitwiseAND(R.on_axis_bits(axis)) != 0


def _changes() -> Column:
    told = lambda sign, a, b, first, second: F.transform(R.named(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))), lambda r: F.concat_ws(":", F.concat(F.lit(sign), first.cast("string")), r, second.cast("string")))
    s, r = F.col("subject_id"), F.col("r_object_id")
    return F.concat(told("-", "fb", "fa", s, r), told("+", "fa", "fb", s, r), told("-", "rb", "ra", r, s), told("+", "ra", "rb", r, s))


def verify(objects: DataFrame, moves: DataFrame, room: tuple[float, float, float, float], strict: bool = False, key: tuple[str, ...] = ("request_id", "new_x", "new_y"), views: DataFrame | None = None) -> DataFrame:
    """A row a candidate: status, quality, leakage, relation_damage, errors and changes (sorted, joined by commas), and what scoring needs.

    In order: errors; not visible; source, then target not satisfied; converses that disagree; and, if ``strict``, changes of
    the target pair's other axes and of any other pair. Only pairs with the subject can change, as nothing else moves.
    With ``views`` (see ``move_pairs``) each scene has its own camera and room; boxes with a ``yaw`` are turned.
    """
    turned = "yaw" in objects.columns
    pairs = move_pairs(objects, moves, views=views)
    if views is not None:
        room = tuple(F.col(n) for n in VIEW[-4:])
    target = F.col("r_object_id") == F.col("reference_id")
    axis = R.lookup(R.AXIS, F.col("relation_before"))
    strayed = [_differs(a) & ~(target & (axis == a)) for a in R.AXES]
    supported = F.col("r_object_id") == F.col("s_support_id")
    holds = (F.abs(F.col("m_x") - F.col("r_x")) <= (F.col("r_ex") - F.col("m_ex")) / 2 + G.ROOM_TOLERANCE) & (F.abs(F.col("m_y") - F.col("r_y")) <= (F.col("r_ey") - F.col("m_ey")) / 2 + G.ROOM_TOLERANCE)
    if turned:
        plan = lambda p: G.footprint(c(p, "x"), c(p, "y"), c(p, "ex"), c(p, "ey"), c(p, "yaw"))
        holds = G.covers_convex(plan("r"), plan("m"))
    first = lambda e: F.max(F.when(target, e))
    common = ("scene_id", "subject_id", "reference_id", "relation_before", "relation_after")
    wide, deep = half_extents("m", turned)
    boundary = F.least(F.col("m_x") - wide - room[0], room[2] - F.col("m_x") - wide, F.col("m_y") - deep - room[1], room[3] - F.col("m_y") - deep)
    grouped = pairs.groupBy(*key, *common).agg(
        F.collect_list(F.when(F.col("hits"), F.concat(F.lit("collision:"), F.col("r_object_id").cast("string")))).alias("collisions"), F.max("hits").alias("collides"),
        F.max(F.when(supported, ~holds)).alias("support_invalid"), F.max(F.array_contains("held", F.col("subject_id"))).alias("has_child"),
        F.max(boundary < -G.ROOM_TOLERANCE if turned else ~inside_rectangle("m", room)).alias("outside"), F.max(~F.col("s_movable") | F.col("s_pinned")).alias("fixed"),
        *[first(F.col(n)).alias(n) for n in ("seen_b", "seen_a")], *[first(F.col(n)).alias(f"t_{n}") for n in ("fb", "fa", "rb", "ra")], *[first(F.col(n)).alias(n) for n in ("dx_a", "dd_a", "gap_a")],
        first(sum(((_differs(a) & (axis != a)).cast("int") for a in R.AXES), F.lit(0)) > 0).alias("collateral"),
        F.sum((~target & ((F.col("fb") != F.col("fa")) | (F.col("rb") != F.col("ra")))).cast("long")).alias("leaks"),
        F.array_sort(F.flatten(F.collect_list(_changes()))).alias("changed"), F.sum(sum((e.cast("long") for e in strayed), F.lit(0).cast("long"))).alias("items"),
        F.min(F.when(F.col("free") & (F.col("z_common") > G.CONTACT), F.col("gap_a"))).alias("clearance"), F.max(boundary).alias("boundary"),
        F.max("s_truncated_fraction").alias("truncated_before"), F.max("a_truncated").alias("truncated_after"),
        F.max("s_x").alias("old_x"), F.max("s_y").alias("old_y"), F.max("s_scene_size").alias("scene_size"),
        *([F.max(F.hypot(room[2] - room[0], room[3] - room[1])).alias("diagonal"), F.max("width").alias("image_width")] if views is not None else []),
    )
    wrong = {"outside_room": F.col("outside"), "subject_not_movable": F.col("fixed"), "subject_has_supported_objects": F.col("has_child"), "support_invalid": F.col("support_invalid")}
    errors = F.array_sort(F.concat(F.col("collisions"), F.array_compact(F.array(*[F.when(e, F.lit(n)) for n, e in wrong.items()]))))
    d = grouped.withColumn("errors", errors)
    # told apart from the list, so that nobody gathers it who does not ask for it
    invalid = F.col("collides") | reduce(lambda a, b: a | b, (F.coalesce(e, F.lit(False)) for e in wrong.values()))
    mask = {n: F.col(f"t_{n}") for n in ("fb", "fa", "rb", "ra")}
    status = (
        F.when(invalid, "INVALID_SCENE")
        .when(~F.col("seen_b") | ~F.col("seen_a"), "NOT_VISIBLE")
        .when(~R.has(mask["fb"], F.col("relation_before")), "AMBIGUOUS")
        .when(~R.has(mask["fa"], F.col("relation_after")) | R.has(mask["fa"], F.col("relation_before")), "AMBIGUOUS")
        .when((mask["rb"] != R.converse_mask(mask["fb"])) | (mask["ra"] != R.converse_mask(mask["fa"])), "UNSATISFIABLE")
    )
    if strict:
        status = status.when(F.col("collateral") | (F.col("leaks") > 0), "UNSATISFIABLE")
    d = d.withColumn("status", status.otherwise("SUCCESS"))
    good = F.col("status") == "SUCCESS"
    return d.withColumns({
        "quality": F.when(~good, "REJECTED").when(F.col("items") > 0, "LOW_LEAKAGE").otherwise("PURE"),
        "leakage": F.when(good, F.col("leaks")).otherwise(0), "relation_damage": F.when(good, F.col("items")).otherwise(0),
        "errors": F.array_join("errors", ","), "changed": F.when(good, F.array_join("changed", ",")).otherwise(""),
    })


def score(verified: DataFrame, room: tuple[float, float, float, float], weights: dict[str, float] = WEIGHTS, width: float = 640.0) -> DataFrame:
    """Adds translation, damage, visibility, safety and total to verified candidates."""
    own = "diagonal" in verified.columns  # of the scene's own room and image
    diagonal = F.col("diagonal") if own else F.hypot(F.lit(room[2] - room[0]), F.lit(room[3] - room[1]))
    width = F.col("image_width") if own else width
    moved = F.hypot(F.col("new_x") - F.col("old_x"), F.col("new_y") - F.col("old_y")) / F.greatest(diagonal, F.lit(1e-9))
    damage = F.least(F.lit(1.0), F.col("relation_damage") / F.greatest(3 * (F.col("scene_size") - 1) - 1, F.lit(1)))
    visibility = F.least(F.lit(1.0), F.abs(F.col("truncated_before") - F.col("truncated_after")) / F.greatest(F.abs("truncated_before"), F.lit(1e-6)))
    clearance = F.least(F.abs("boundary"), F.coalesce("clearance", F.abs("boundary"))) / F.greatest(0.02 * diagonal, F.lit(0.1))
    beyond = (
        F.when(F.col("relation_after").isin("left", "right"), F.abs(F.abs("dx_a") - width * R.WIDTH_SHARE) / (width * R.WIDTH_SHARE))
        .when(F.col("relation_after").isin("front", "behind"), F.abs(F.abs("dd_a") - R.DEPTH_M) / R.DEPTH_M)
        .when(F.col("relation_after") == "near", F.abs(R.NEAR_M - F.col("gap_a")) / R.NEAR_M)
        .otherwise(F.abs(F.col("gap_a") - R.FAR_M) / R.FAR_M)
    )
    d = verified.withColumns({"translation": moved, "damage": damage, "visibility": visibility, "safety": 1 / (1 + F.greatest(F.lit(0.0), F.least(clearance, beyond)))})
    return d.withColumn("total", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def grid_moves(requests: DataFrame, room: tuple[float, float, float, float], step: float) -> DataFrame:
    """Every request at every grid point of the room; points are multiples of ``step``."""
    axis = lambda lo, hi: F.transform(F.sequence(F.ceil(F.lit(lo) / step), F.floor(F.lit(hi) / step)), lambda i: F.round(i * F.lit(float(step)), 9))
    return requests.withColumn("new_x", F.explode(axis(room[0], room[2]))).withColumn("new_y", F.explode(axis(room[1], room[3])))


def best_candidates(scored: DataFrame, least: tuple[str, ...]) -> DataFrame:
    """Of each request the successful candidate that is least by the columns given, in order."""
    good = scored.filter("status = 'SUCCESS'")
    key = F.struct(*[F.col(k) for k in least])
    row = F.struct(*[F.col(k) for k in scored.columns])
    return good.groupBy("request_id").agg(F.min_by(row, key).alias("best")).select("best.*")


def solve(objects: DataFrame, requests: DataFrame, room: tuple[float, float, float, float], strict: bool = True, steps: tuple[float, ...] = (2.0,), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The best move of each request on a grid of the first step, refined by 3 x 3 points at each further one. Strict: the shortest without any other change; otherwise the cheapest. What the search finds is verified and scored once more, a row a request."""
    least = ("translation", "total", "new_x", "new_y") if strict else ("total", "translation", "new_x", "new_y")
    found = best_points(objects, requests, room, strict, steps, weights)
    return score(verify(objects, found, room, strict), room, weights).filter("status = 'SUCCESS'")
