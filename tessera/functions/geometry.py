"""Plane geometry on columns: points are struct(x, y), polygons arrays of points in order. All expressions stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Areas and overlaps up to this are contact, not intersection.
CONTACT = 1e-9
ROOM_TOLERANCE = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def polygon(*points: tuple[float, float]) -> Column:
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def yaw_degrees(x: Column, y: Column, z: Column, w: Column) -> Column:
    """The turn about the vertical axis of a unit quaternion."""
    return F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def footprint(cx: Column, cy: Column, ex: Column, ey: Column, yaw: Column | None = None) -> Column:
    """The four corners of a box's plan, counter-clockwise; ``ex`` and ``ey`` are full extents, ``yaw`` is in degrees."""
    hx, hy = ex / 2, ey / 2
    corners = [(-hx, -hy), (hx, -hy), (hx, hy), (-hx, hy)]
    if yaw is None:
        return F.array(*[point(cx + a, cy + b) for a, b in corners])
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    return F.array(*[point(cx + a * c - b * s, cy + a * s + b * c) for a, b in corners])


def edges(poly: Column) -> Column:
    """array of struct(a, b): the sides in order."""
    following = lambda p: F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return let(poly, lambda p: F.zip_with(p, following(p), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def signed_area(poly: Column) -> Column:
    """Positive for counter-clockwise polygons."""
    return F.aggregate(edges(poly), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def canonical_ring(poly: Column) -> Column:
    """Counter-clockwise, from the least point by x, then y."""
    first = lambda p: F.struct(p.alias("p"), F.array_position(p, F.array_min(p)).cast("int").alias("at"))
    turned = let(let(poly, lambda p: F.when(signed_area(p) < 0, F.reverse(p)).otherwise(p)), first)
    return let(turned, lambda t: F.concat(F.slice(t["p"], t["at"], F.size(t["p"])), F.slice(t["p"], F.lit(1), t["at"] - 1)))


def cross(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def clip_half_plane(poly: Column, nx: Column, ny: Column, c: Column) -> Column:
    """The part of a convex polygon with ``nx * x + ny * y >= c``."""
    side = lambda p: nx * p["x"] + ny * p["y"] - c

    none = F.array().cast("array<struct<x:double,y:double>>")

    def crossing(e: Column, da: Column, db: Column) -> Column:
        return let(da / (da - db), lambda t: F.array(point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * t, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t)))

    def cut(e: Column) -> Column:
        kept = lambda d: F.when(d["a"] >= 0, F.array(e["a"])).otherwise(none)
        return let(F.struct(side(e["a"]).alias("a"), side(e["b"]).alias("b")), lambda d: F.concat(kept(d), F.when(((d["a"] > 0) & (d["b"] < 0)) | ((d["a"] < 0) & (d["b"] > 0)), crossing(e, d["a"], d["b"])).otherwise(none)))

    return F.flatten(F.transform(edges(poly), cut))


def clip(poly: Column, by: Column) -> Column:
    """The intersection of two convex counter-clockwise polygons."""

    def step(left: Column, e: Column) -> Column:
        return clip_half_plane(left, e["nx"], e["ny"], e["c"])

    def plane(e: Column) -> Column:
        nx, ny = e["a"]["y"] - e["b"]["y"], e["b"]["x"] - e["a"]["x"]
        return F.struct(nx.alias("nx"), ny.alias("ny"), (nx * e["a"]["x"] + ny * e["a"]["y"]).alias("c"))

    return F.aggregate(F.transform(edges(by), plane), poly, step)


def overlap_area(a: Column, b: Column) -> Column:
    return F.abs(signed_area(clip(a, b)))


def separation(a: Column, b: Column) -> Column:
    """The largest gap of the projections on the normals of both polygons' sides; above 0 exactly if convex polygons are apart."""

    # every value that is named more than once is bound: lambdas work out a column as often as it is named
    def normal(e: Column) -> Column:
        nx, ny = e["b"]["y"] - e["a"]["y"], e["a"]["x"] - e["b"]["x"]
        return F.struct(nx.alias("x"), ny.alias("y"), F.greatest(F.sqrt(nx * nx + ny * ny), F.lit(1e-300)).alias("size"))

    def along(sides: Column, p: Column, q: Column) -> Column:
        ends = lambda n, poly: let(F.transform(poly, lambda v: (n["x"] * v["x"] + n["y"] * v["y"]) / n["size"]), lambda r: F.struct(F.array_min(r).alias("lo"), F.array_max(r).alias("hi")))
        gap = lambda r: F.greatest(r["q"]["lo"] - r["p"]["hi"], r["p"]["lo"] - r["q"]["hi"])
        return F.array_max(F.transform(F.transform(sides, normal), lambda n: let(F.struct(ends(n, p).alias("p"), ends(n, q).alias("q")), gap)))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda f: F.greatest(along(edges(f["a"]), f["a"], f["b"]), along(edges(f["b"]), f["a"], f["b"])))


def point_segment_distance(p: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    share = lambda d: F.when(d["size"] > 0, ((p["x"] - e["a"]["x"]) * d["x"] + (p["y"] - e["a"]["y"]) * d["y"]) / F.greatest(d["size"], F.lit(1e-300))).otherwise(0.0)
    away = lambda d: let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share(d))), lambda t: F.hypot(p["x"] - (e["a"]["x"] + t * d["x"]), p["y"] - (e["a"]["y"] + t * d["y"])))
    return let(F.struct(dx.alias("x"), dy.alias("y"), (dx * dx + dy * dy).alias("size")), away)


def gap(a: Column, b: Column) -> Column:
    """The distance of two convex polygons; 0 if they touch or overlap."""
    near = lambda p, q: let(edges(q), lambda sides: F.array_min(F.flatten(F.transform(p, lambda v: F.transform(sides, lambda e: point_segment_distance(v, e))))))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda f: F.when(separation(f["a"], f["b"]) <= 0, 0.0).otherwise(F.least(near(f["a"], f["b"]), near(f["b"], f["a"]))))


def box_gap(dx: Column, dy: Column, ex: Column, ey: Column) -> Column:
    """The distance of two boxes along the axes: ``dx`` and ``dy`` between centres, ``ex`` and ``ey`` the sums of their full extents."""
    gx, gy = F.greatest(F.abs(dx) - ex / 2, F.lit(0.0)), F.greatest(F.abs(dy) - ey / 2, F.lit(0.0))
    return F.sqrt(gx * gx + gy * gy)


def point_polygon_distance(p: Column, poly: Column) -> Column:
    """0 in or on the polygon."""
    return F.when(covers_point(poly, p), 0.0).otherwise(F.array_min(F.transform(edges(poly), lambda e: point_segment_distance(p, e))))


def covers_point(poly: Column, p: Column, tolerance: float = 0.0) -> Column:
    """Whether a simple polygon has the point in it or on its boundary."""
    on = F.exists(edges(poly), lambda e: point_segment_distance(p, e) <= tolerance + 1e-12)
    crossings = F.filter(edges(poly), lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return on | (F.size(crossings) % 2 == 1)


def covers_convex(poly: Column, inner: Column, tolerance: float = ROOM_TOLERANCE) -> Column:
    """Whether a convex counter-clockwise polygon, widened by ``tolerance``, holds every corner of ``inner``."""
    return F.forall(inner, lambda p: F.forall(edges(poly), lambda e: cross(e["a"], e["b"], p) >= -tolerance * F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def z_overlap(az: Column, aez: Column, bz: Column, bez: Column) -> Column:
    """Positive for a common height, 0 for contact, negative for a gap."""
    return F.least(az + aez / 2, bz + bez / 2) - F.greatest(az - aez / 2, bz - bez / 2)


def boxes_intersect(a: Column, b: Column, dz: Column) -> Column:
    """Whether two boxes have a common volume, by footprints and overlap in height; contact is none."""
    return (overlap_area(a, b) > CONTACT) & (dz > CONTACT)


def relative_to(poly: Column, x: Column, y: Column) -> Column:
    return F.transform(poly, lambda p: point(p["x"] - x, p["y"] - y))


def translate(poly: Column, dx: Column, dy: Column) -> Column:
    return F.transform(poly, lambda p: point(p["x"] + dx, p["y"] + dy))


def bounds(poly: Column) -> Column:
    ends = lambda v: F.struct(F.array_min(v["x"]).alias("xmin"), F.array_min(v["y"]).alias("ymin"), F.array_max(v["x"]).alias("xmax"), F.array_max(v["y"]).alias("ymax"))
    axes = lambda poly: F.struct(F.transform(poly, lambda p: p["x"]).alias("x"), F.transform(poly, lambda p: p["y"]).alias("y"))
    return let(let(poly, axes), ends)


def diagonal(poly: Column) -> Column:
    b = bounds(poly)
    return F.hypot(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])


def erode_convex(container: Column, shape: Column) -> Column:
    """Where the origin of ``shape`` (corners relative to it) may stand so that a convex container holds it all."""

    def step(left: Column, e: Column) -> Column:
        nx, ny = e["a"]["y"] - e["b"]["y"], e["b"]["x"] - e["a"]["x"]
        reach = F.array_min(F.transform(shape, lambda p: nx * p["x"] + ny * p["y"]))
        return clip_half_plane(left, nx, ny, nx * e["a"]["x"] + ny * e["a"]["y"] - reach)

    return F.aggregate(edges(container), container, step)


def disk(radius: Column, sides: int = 128, outer: bool = False, guard: float = 1e-9) -> Column:
    """A regular polygon about the origin, within the disk or, with ``outer``, around it."""
    r = (radius + guard) / math.cos(math.pi / sides) if outer else F.greatest(radius - guard, F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: point(r * F.cos(k * (2 * math.pi / sides)), r * F.sin(k * (2 * math.pi / sides))))


def hull(points: Column) -> Column:
    """The convex hull, counter-clockwise from the least point, by a monotone chain over the sorted points."""
    kind = "array<struct<x:double,y:double>>"

    def chain(sorted_points: Column) -> Column:
        def push(out: Column, p: Column) -> Column:
            # drop the last points that do not turn left; each step of the fold drops at most one
            def trim(o: Column, _: Column) -> Column:
                n = F.size(o)
                back = (n >= 2) & (cross(F.element_at(o, -2), F.element_at(o, -1), p) <= 0)
                return F.when(F.coalesce(back, F.lit(False)), F.slice(o, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(o)

            return F.concat(F.aggregate(out, out, trim), F.array(p))  # no more can be dropped than there are

        return F.aggregate(sorted_points, F.array().cast(kind), push)

    # each value is bound once: a column that is used twice is computed twice inside of lambdas
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    but_last = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    both = lambda o: F.concat(bind(chain(o), but_last), bind(chain(F.reverse(o)), but_last))
    return bind(F.array_sort(F.array_distinct(points)), lambda o: F.when(F.size(o) < 3, o).otherwise(both(o)))


def hausdorff(a: Column, b: Column) -> Column:
    """The largest distance from a corner of one set (struct x, y, z) to the nearest of the other, both ways."""
    square = lambda v, w, k: (v[k] - w[k]) * (v[k] - w[k])
    far = lambda p, q: F.array_max(F.transform(p, lambda v: F.array_min(F.transform(q, lambda w: F.sqrt(square(v, w, "x") + square(v, w, "y") + square(v, w, "z"))))))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda f: F.greatest(far(f["a"], f["b"]), far(f["b"], f["a"])))


def region_payload(polygons: Column) -> Column:
    """A region's parts as canonical rings, least first, so that equal regions are told alike; empty for none."""
    return F.array_sort(F.transform(polygons, canonical_ring))
