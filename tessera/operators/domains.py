"""Moves that constraints allow, as unions of rectangles with an inner and an outer bound, and what follows for the shortest move.

A region is an array of closed rectangles struct(x0, x1, y0, y1) in the plane of moves. What is surely allowed is the
inner region, what is not surely forbidden the outer one; a constraint that cannot tell empties the inner region and leaves
the outer one. The bounds are in doubles; sums are not rounded outward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import relations as R

from .lineage import spread
from .pairs import c, side, z_overlap

REGION = "array<struct<x0:double,x1:double,y0:double,y1:double>>"


def rect(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y0.cast("double").alias("y0"), y1.cast("double").alias("y1"))


def nothing() -> Column:
    return F.array().cast(REGION)


def whole(region: Column) -> Column:
    """Without rectangles that are turned inside out."""
    return F.filter(region, lambda r: (r["x0"] <= r["x1"]) & (r["y0"] <= r["y1"]))


def meet(region: Column, q: Column) -> Column:
    """The part of a region in a rectangle."""
    return whole(F.transform(region, lambda r: rect(F.greatest(r["x0"], q["x0"]), F.least(r["x1"], q["x1"]), F.greatest(r["y0"], q["y0"]), F.least(r["y1"], q["y1"]))))


def subtract(region: Column, q: Column) -> Column:
    """The part of a region that is not inside a rectangle; its border stays."""

    def left_over(r: Column) -> Column:
        apart = (r["x1"] <= q["x0"]) | (r["x0"] >= q["x1"]) | (r["y1"] <= q["y0"]) | (r["y0"] >= q["y1"]) | (q["x0"] >= q["x1"]) | (q["y0"] >= q["y1"])
        lo, hi = F.greatest(r["x0"], q["x0"]), F.least(r["x1"], q["x1"])
        parts = F.array(rect(r["x0"], F.least(r["x1"], q["x0"]), r["y0"], r["y1"]), rect(F.greatest(r["x0"], q["x1"]), r["x1"], r["y0"], r["y1"]), rect(lo, hi, r["y0"], F.least(r["y1"], q["y0"])), rect(lo, hi, F.greatest(r["y0"], q["y1"]), r["y1"]))
        return F.when(apart, F.array(r)).otherwise(whole(parts))

    return F.flatten(F.transform(region, left_over))


def subtract_all(region: Column, rects: Column) -> Column:
    return F.aggregate(rects, region, subtract)


def widen(q: Column, by: Column | float) -> Column:
    return rect(q["x0"] - by, q["x1"] + by, q["y0"] - by, q["y1"] + by)


def nearest(region: Column) -> Column:
    """struct(d, x, y): the point of a region that is nearest to the origin, null for an empty one."""

    def point(r: Column) -> Column:
        x, y = F.greatest(r["x0"], F.least(r["x1"], F.lit(0.0))), F.greatest(r["y0"], F.least(r["y1"], F.lit(0.0)))
        return F.struct(F.hypot(x, y).alias("d"), x.alias("x"), y.alias("y"))

    return F.array_min(F.transform(region, point))


def holds(region: Column, x: Column, y: Column) -> Column:
    return F.exists(region, lambda r: (r["x0"] <= x) & (x <= r["x1"]) & (r["y0"] <= y) & (y <= r["y1"]))


def contact_rect(a: str, b: str) -> Column:
    """The moves of box a whose plan meets that of box b."""
    half = lambda e: (c(a, e) + c(b, e)) / 2
    dx, dy = c(b, "x") - c(a, "x"), c(b, "y") - c(a, "y")
    return rect(dx - half("ex"), dx + half("ex"), dy - half("ey"), dy + half("ey"))


def distance_requests(objects: DataFrame) -> DataFrame:
    """Every near or far relation with a subject that may move."""
    from .moves import all_requests

    return all_requests(objects).filter("relation_before IN ('near', 'far')")


def candidate_domain(objects: DataFrame, requests: DataFrame, room: tuple[float, float, float, float], reach: float) -> DataFrame:
    """A row a request: the inner and outer regions after each kind of constraint, in the order support, collision, target.

    The universe is the moves up to ``reach`` along each axis that keep the subject in the room.
    """
    names = ("object_id", "x", "y", "z", "ex", "ey", "ez", "clearance", "support_id")
    d = requests.join(side(objects, "s", names).withColumnRenamed("s_object_id", "subject_id"), ["scene_id", "subject_id"])
    others = d.join(side(objects, "r", names), "scene_id").filter("r_object_id <> subject_id")
    is_support, is_target = F.coalesce(F.col("r_object_id") == F.col("s_support_id"), F.lit(False)), F.col("r_object_id") == F.col("reference_id")
    q0 = contact_rect("s", "r")
    inset = rect(c("r", "x") - c("s", "x") - (c("r", "ex") - c("s", "ex")) / 2, c("r", "x") - c("s", "x") + (c("r", "ex") - c("s", "ex")) / 2, c("r", "y") - c("s", "y") - (c("r", "ey") - c("s", "ey")) / 2, c("r", "y") - c("s", "y") + (c("r", "ey") - c("s", "ey")) / 2)
    obstacle = ~is_support & (z_overlap() > 0)
    key = list(requests.columns)
    universe = rect(F.greatest(F.lit(-reach), room[0] + c("s", "ex") / 2 - c("s", "x")), F.least(F.lit(reach), room[2] - c("s", "ex") / 2 - c("s", "x")), F.greatest(F.lit(-reach), room[1] + c("s", "ey") / 2 - c("s", "y")), F.least(F.lit(reach), room[3] - c("s", "ey") / 2 - c("s", "y")))
    g = others.withColumns({"q0": q0, "inset": inset, "universe": universe}).groupBy(*key).agg(
        F.first("universe").alias("universe"), F.max(F.when(is_support, F.col("inset"))).alias("inset"), F.max(F.when(is_target, F.col("q0"))).alias("target"),
        F.array_sort(F.collect_list(F.when(obstacle, F.col("q0")))).alias("bare"), F.array_sort(F.collect_list(F.when(obstacle, widen(F.col("q0"), c("r", "clearance"))))).alias("grown"),
    )
    g = g.withColumn("all", whole(F.array("universe")))
    g = g.withColumn("supported", F.when(F.col("inset").isNull(), F.col("all")).otherwise(meet(F.col("all"), F.col("inset"))))
    g = g.withColumns({"free_outer": subtract_all(F.col("supported"), F.col("bare")), "free_inner": subtract_all(F.col("supported"), F.col("grown"))})
    near, t = F.col("relation_after") == "near", F.col("target")
    far_gap, near_gap = F.lit(R.FAR_M), F.lit(R.NEAR_M)
    inner = F.when(near, meet(F.col("free_inner"), widen(t, near_gap / 2))).when(F.col("relation_after") == "far", subtract(F.col("free_inner"), widen(t, far_gap))).otherwise(nothing())
    outer = F.when(near, meet(F.col("free_outer"), widen(t, near_gap))).when(F.col("relation_after") == "far", subtract(F.col("free_outer"), t)).otherwise(F.col("free_outer"))
    return g.withColumns({"inner": inner, "outer": outer})


def ledger(domain: DataFrame) -> DataFrame:
    """A row a request and constraint, in order: how many rectangles are left, and whether nothing can be."""
    steps = [("position", "all", "all"), ("support", "supported", "supported"), ("collision", "free_inner", "free_outer"), ("target", "inner", "outer")]
    rows = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("constraint"), F.size(i).alias("inner_cells"), F.size(o).alias("outer_cells")) for k, (n, i, o) in enumerate(steps)])
    return domain.select("request_id", F.explode(rows).alias("r")).select("request_id", "r.*").withColumn("empty", F.col("outer_cells") == 0)


def certify(domain: DataFrame, most_gap: float) -> DataFrame:
    """The shortest surely allowed move as witness, the shortest not surely forbidden one as lower bound, and what that proves."""
    d = domain.withColumns({"witness": nearest(F.col("inner")), "bound": nearest(F.col("outer"))})
    gap = F.col("witness.d") - F.col("bound.d")
    status = F.when(F.size("outer") == 0, "PROVEN_UNSAT").when(gap <= most_gap, "CERTIFIED_SUCCESS").otherwise("UNCERTIFIED")
    return d.withColumns({"upper": F.col("witness.d"), "lower": F.col("bound.d"), "gap": gap, "status": status})


def cardinal(x: Column, y: Column, quarters: Column) -> tuple[Column, Column]:
    """A point turned by quarter turns, exactly."""
    q = F.pmod(quarters, F.lit(4))
    return F.when(q == 0, x).when(q == 1, -y).when(q == 2, -x).otherwise(y), F.when(q == 0, y).when(q == 1, x).when(q == 2, -y).otherwise(-x)


def without_cardinal_yaw(objects: DataFrame) -> DataFrame:
    """Boxes turned by whole quarters as boxes along the axes; others have ``cardinal`` false and stay as they are."""
    q = F.col("yaw") / 90
    quarter = F.round(q).cast("long")
    odd = F.pmod(quarter, F.lit(2)) == 1
    even = q == F.round(q)
    return objects.withColumns({"cardinal": even, "_ex": F.when(even & odd, F.col("ey")).otherwise(F.col("ex")), "_ey": F.when(even & odd, F.col("ex")).otherwise(F.col("ey"))}).withColumns({"ex": F.col("_ex"), "ey": F.col("_ey"), "yaw": F.when(even, 0.0).otherwise(F.col("yaw"))}).drop("_ex", "_ey")


def rebase(objects: DataFrame, x: float, y: float, quarters: int) -> DataFrame:
    """The scene in the frame of a camera at (x, y) that is turned by quarters; extents are swapped for odd ones."""
    nx, ny = cardinal(F.col("x") - x, F.col("y") - y, F.lit(-quarters))
    swap = quarters % 2 == 1
    return objects.withColumns({"x": nx, "y": ny, "ex": F.col("ey" if swap else "ex"), "ey": F.col("ex" if swap else "ey")})


def pull_back(moves: DataFrame, quarters: int) -> DataFrame:
    """Moves (dx, dy) found in a turned frame, in the original one."""
    dx, dy = cardinal(F.col("dx"), F.col("dy"), F.lit(quarters))
    return moves.withColumns({"dx": dx, "dy": dy})


def replay_mismatches(stored: DataFrame, again: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests whose stored result is not the one found again, by a digest of all columns."""
    names = sorted(x for x in stored.columns if x != key)
    told = lambda d, n: d.select(key, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"), 256).alias(n))
    return told(stored, "stored").join(told(again, "again"), key, "full_outer").filter(~F.col("stored").eqNullSafe(F.col("again")))


def replay_counts(stored: DataFrame, again: DataFrame, key: str = "request_id") -> DataFrame:
    """One row: how many results are stored (``requests``), and how many requests have results that are not those found again (``mismatches``). Both are counted in one reading of each table; a request's results are compared whatever their order."""
    names = sorted(x for x in stored.columns if x != key)
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"), 256)
    told = lambda d, n: spread(d.select(key, digest.alias(n)), key).groupBy(key).agg(F.sort_array(F.collect_list(n)).alias(n))
    both = told(stored, "stored").join(told(again, "again"), key, "full_outer")
    many = F.when(F.col("stored").isNotNull(), F.size("stored"))
    return both.agg(F.coalesce(F.sum(many), F.lit(0).cast("long")).alias("requests"), F.count_if(~F.col("stored").eqNullSafe(F.col("again"))).alias("mismatches"))
