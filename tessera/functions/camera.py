"""Camera arithmetic on columns: intrinsics, extrinsics, projection and its calibration on an observed view.

World axes are x, y, and z upward; the rows of a camera's matrix are right, up and forward, so that image rows grow
downward as ``v = cy - fy * up / forward``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def intrinsics(fov_degrees: Column, width: Column, height: Column, bounded: bool = True) -> Column:
    """array<double> of nine, row by row; the field of view is vertical and between 0 and 180 degrees, or an error, unless ``bounded`` is false: then the formula goes on (no camera has its negative lengths)."""
    f = height / (2 * F.tan(F.radians(fov_degrees) / 2))
    ok = (fov_degrees > 0) & (fov_degrees < 180)
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = F.array(f, zero, width / 2, zero, f, height / 2, zero, zero, one)
    return rows if not bounded else F.when(ok, rows).otherwise(F.raise_error(F.lit("the field of view must be between 0 and 180 degrees")))


def world_to_camera(x: Column, y: Column, z: Column, yaw_degrees: Column, horizon_degrees: Column) -> Column:
    """array<double> of sixteen, row by row: yaw turns from +y to +x, a positive horizon looks down."""
    a, h = F.radians(yaw_degrees), F.radians(horizon_degrees)
    rows = [
        (F.cos(a), -F.sin(a), F.lit(0.0)),
        (F.sin(a) * F.sin(h), F.cos(a) * F.sin(h), F.cos(h)),
        (F.sin(a) * F.cos(h), F.cos(a) * F.cos(h), -F.sin(h)),
    ]
    out = [v for r in rows for v in (*r, -(r[0] * x + r[1] * y + r[2] * z))]
    return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def transform(matrix: Column, x: Column, y: Column, z: Column) -> Column:
    """A point through a row-major 4 x 4 matrix; an error for a matrix of another size and for points at infinity."""
    row = lambda k: F.element_at(matrix, 4 * k + 1) * x + F.element_at(matrix, 4 * k + 2) * y + F.element_at(matrix, 4 * k + 3) * z + F.element_at(matrix, 4 * k + 4)
    w = row(3)
    out = F.struct((row(0) / w).alias("x"), (row(1) / w).alias("y"), (row(2) / w).alias("z"))
    return F.when(F.size(matrix) != 16, F.raise_error(F.lit("a matrix must have 16 values"))).when(w == 0, F.raise_error(F.lit("the point is at infinity"))).otherwise(out)


def affine_row(matrix: Column, row: int, z: Column) -> Column:
    """struct(x, y, c): a row of the matrix as a function of x and y at a fixed height."""
    at = lambda k: F.element_at(matrix, 4 * row + k)
    return F.struct(at(1).alias("x"), at(2).alias("y"), (at(3) * z + at(4)).alias("c"))


def evaluate(form: Column, x: Column, y: Column) -> Column:
    return form["x"] * x + form["y"] * y + form["c"]


def project(k: Column, right: Column, up: Column, forward: Column) -> Column:
    """struct(u, v), null at depths that are not positive."""
    at = lambda i: F.element_at(k, i)
    return F.when(forward > 0, F.struct((at(1) * right / forward + at(3)).alias("u"), (at(6) - at(5) * up / forward).alias("v")))


def calibrate(k: Column, matrix: Column, x: Column, y: Column, z: Column, bbox: Column, depth: Column) -> Column:
    """What the observed view differs by from the pinhole's: struct(right, up, forward, du, dv, dd), null if the point is not in front."""
    forms = [affine_row(matrix, i, z) for i in range(3)]
    seen = project(k, *[evaluate(f, x, y) for f in forms])
    u, v = (bbox["xmin"] + bbox["xmax"]) / 2, (bbox["ymin"] + bbox["ymax"]) / 2
    return F.when(seen.isNotNull(), F.struct(forms[0].alias("right"), forms[1].alias("up"), forms[2].alias("forward"), (u - seen["u"]).alias("du"), (v - seen["v"]).alias("dv"), (depth - evaluate(forms[2], x, y)).alias("dd")))


def truncated(bbox: Column, width: Column, height: Column) -> Column:
    """The share of a box that lies outside the image; null for an empty box."""
    clip = lambda lo, hi, most: F.greatest(F.lit(0.0), F.least(hi, most) - F.greatest(lo, F.lit(0.0)))
    area = F.greatest(F.lit(0.0), bbox["xmax"] - bbox["xmin"]) * F.greatest(F.lit(0.0), bbox["ymax"] - bbox["ymin"])
    return F.when(area > 0, 1 - clip(bbox["xmin"], bbox["xmax"], width) * clip(bbox["ymin"], bbox["ymax"], height) / area)


def projected_view(k: Column, calibration: Column, bbox: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The view after a move to (x, y): struct(bbox, depth, truncated); null if the depth is not positive. Other fractions do not change."""
    forms = [calibration[n] for n in ("right", "up", "forward")]
    seen = project(k, *[evaluate(f, x, y) for f in forms])
    depth = evaluate(forms[2], x, y) + calibration["dd"]
    u, v = seen["u"] + calibration["du"], seen["v"] + calibration["dv"]
    hw, hh = (bbox["xmax"] - bbox["xmin"]) / 2, (bbox["ymax"] - bbox["ymin"]) / 2
    moved = F.struct((u - hw).alias("xmin"), (v - hh).alias("ymin"), (u + hw).alias("xmax"), (v + hh).alias("ymax"))
    return F.when(seen.isNotNull() & (depth > 0), F.struct(moved.alias("bbox"), depth.alias("depth"), truncated(moved, width, height).alias("truncated")))


def box_corners(center: Column, extent: Column, yaw_degrees: Column) -> Column:
    """The eight corners, struct(x, y, z), of a box turned about the vertical."""
    cs, sn = F.cos(F.radians(yaw_degrees)), F.sin(F.radians(yaw_degrees))
    out = []
    for i in (-0.5, 0.5):
        for j in (-0.5, 0.5):
            for m in (-0.5, 0.5):
                a, b = extent["x"] * i, extent["y"] * j
                out.append(F.struct((center["x"] + a * cs - b * sn).alias("x"), (center["y"] + a * sn + b * cs).alias("y"), (center["z"] + extent["z"] * m).alias("z")))
    return F.array(*out)


def image_bounds(k: Column, matrix: Column, corners: Column, least_depth: float = 1e-6) -> Column:
    """The image box of the corners that are in front of the camera; an error if none is."""
    seen = F.filter(F.transform(corners, lambda p: transform(matrix, p["x"], p["y"], p["z"])), lambda p: p["z"] > least_depth)
    at = lambda i: F.element_at(k, i)
    us, vs = F.transform(seen, lambda p: at(1) * p["x"] / p["z"] + at(3)), F.transform(seen, lambda p: at(6) - at(5) * p["y"] / p["z"])
    out = F.struct(F.array_min(us).alias("xmin"), F.array_min(vs).alias("ymin"), F.array_max(us).alias("xmax"), F.array_max(vs).alias("ymax"))
    return F.when(F.size(seen) == 0, F.raise_error(F.lit("no corner is in front of the camera"))).otherwise(out)


def box_from_corners(corners: Column, yaw_degrees: Column) -> Column:
    """struct(center, extent): the mean of the corners and their ranges in the frame of the yaw."""
    n = F.size(corners)
    mean = lambda a: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[a]) / n
    cs, sn = F.cos(F.radians(yaw_degrees)), F.sin(F.radians(yaw_degrees))
    across = F.transform(corners, lambda p: p["x"] * cs + p["y"] * sn)
    along = F.transform(corners, lambda p: p["y"] * cs - p["x"] * sn)
    up = F.transform(corners, lambda p: p["z"])
    size = lambda v: F.array_max(v) - F.array_min(v)
    return F.struct(F.struct(mean("x").alias("x"), mean("y").alias("y"), mean("z").alias("z")).alias("center"), F.struct(size(across).alias("x"), size(along).alias("y"), size(up).alias("z")).alias("extent"))


def swap_up_axis(p: Column) -> Column:
    """From y upward to z upward."""
    return F.struct(p["x"].alias("x"), p["z"].alias("y"), p["y"].alias("z"))


def euler_to_quaternion(degrees: Column) -> Column:
    """Turns of a y-upward frame (about z, then x, then y) as a unit quaternion of the z-upward frame."""
    half = {a: F.radians(degrees[a]) / 2 for a in "xyz"}
    s, c = {a: F.sin(v) for a, v in half.items()}, {a: F.cos(v) for a, v in half.items()}
    x = c["y"] * s["x"] * c["z"] + s["y"] * c["x"] * s["z"]
    y = s["y"] * c["x"] * c["z"] - c["y"] * s["x"] * s["z"]
    z = c["y"] * c["x"] * s["z"] - s["y"] * s["x"] * c["z"]
    w = c["y"] * c["x"] * c["z"] + s["y"] * s["x"] * s["z"]
    return F.struct((-x).alias("x"), (-z).alias("y"), (-y).alias("z"), w.alias("w"))


def quaternion_residual(a: Column, b: Column) -> Column:
    """The angle between two turns in degrees; infinite where one has no length."""
    dot = sum((a[k] * b[k] for k in "xyzw"), F.lit(0.0))
    size = F.sqrt(sum((a[k] * a[k] for k in "xyzw"), F.lit(0.0))) * F.sqrt(sum((b[k] * b[k] for k in "xyzw"), F.lit(0.0)))
    return F.when(size > 0, F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot) / size)))).otherwise(F.lit(float("inf")))




def area_lower_bound(us: Column, vs: Column, width: Column, height: Column) -> Column:
    """A share of the image that a projected box has at least, its corners' columns and rows each known as struct(lo, hi)."""
    span = lambda b: F.greatest(F.lit(0.0), F.array_max(F.transform(b, lambda i: i["lo"])) - F.array_min(F.transform(b, lambda i: i["hi"])))
    return F.when((F.size(us) > 0) & (F.size(vs) > 0) & (width > 0) & (height > 0), span(us) * span(vs) / (width * height))
