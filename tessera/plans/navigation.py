"""Where every movable object may stand by what an agent on a grid of half a metre proves free; boxes are turned as in ``convex``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import navigation as N
from tessera.sources.fixture import ROOM

from .convex import TURNED, turned_objects

STEP, RADIUS, CLEARANCE, SLAB = 0.5, 0.4, 0.05, 0.25


def _rooms(objects: DataFrame) -> DataFrame:
    return objects.select("scene_id").distinct().withColumns({name: F.lit(v) for name, v in zip(N.ROOM, ROOM, strict=True)})


def navigation_points(spark: SparkSession, sf: str) -> DataFrame:
    """How many places of the agent each scene has, and the sums of their grid indices."""
    d = turned_objects(spark, sf)
    p = N.grid_points(d, _rooms(d), STEP, RADIUS)
    index = lambda a: F.sum(F.round(F.col(a) / STEP).cast("long"))
    return p.groupBy("scene_id").agg(F.count("*").alias("points"), index("x").alias("sum_i"), index("y").alias("sum_j"))


def navigation_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Per movable object the area of its region from both sides, and the inner bound's runs and Euler number."""
    found = N.scene_areas(turned_objects(spark, sf), F.expr("movable AND NOT pinned"), ROOM, STEP, RADIUS, CLEARANCE, SLAB)
    return found.select("scene_id", "subject_id", F.round("inner_area", 5).alias("inner_area"), F.round("outer_area", 5).alias("outer_area"), "euler")


_POINTS = f"""{TURNED},
bent AS (SELECT *, ex / 2 AS a, ey / 2 AS b, CASE WHEN yaw % 180 > 90 THEN yaw % 180 - 180 ELSE yaw % 180 END AS t FROM turned),
feet AS (SELECT *, CASE WHEN abs(t) = 90 THEN 0 ELSE cos(radians(t)) END AS c, CASE WHEN t = 0 THEN 0 ELSE sin(radians(t)) END AS s FROM bent),
bound_feet AS (SELECT *, a * c + b * abs(s) AS wide, a * abs(s) + b * c AS high, a * s - sign(s) * b * c AS top FROM feet),
grid AS (SELECT scene_id, i, j, i * {STEP} AS gx, j * {STEP} AS gy FROM (SELECT DISTINCT scene_id FROM objects), range(-1, 18) AS p(i), range(-1, 18) AS q(j)),
points AS (SELECT scene_id, i, j, gx::DOUBLE AS x, gy::DOUBLE AS y FROM grid g WHERE NOT EXISTS (
    SELECT 1 FROM bound_feet f WHERE f.scene_id = g.scene_id AND abs(gx - f.x) < f.wide + {RADIUS} - 5e-10 AND abs(gy - f.y) < f.high + {RADIUS} - 5e-10))
"""

_REACH = "least(CASE WHEN c > 0 THEN (a - ({v}) * s) / c END, CASE WHEN s <> 0 THEN (b + sign(s) * ({v}) * c) / abs(s) END)"
_STRIP = _REACH.format(v=f"greatest(least(top, least(({{k}} + 1) * {SLAB}, high)), greatest(({{k}} - 1) * {SLAB}, -high))")
_AT = f"CASE WHEN abs(k) * {SLAB} <= high THEN {_REACH.format(v=f'{{k}} * {SLAB}')} END"
_N = int((ROOM[3] - ROOM[1]) / SLAB)
_REGIONS = f"""{_POINTS},
sweep AS (
    SELECT scene_id, x, k AS i, {ROOM[1]} + k * {SLAB} - y AS lo, {ROOM[1]} + (k + 1) * {SLAB} - y AS hi
    FROM points, range(-1, {_N + 1}) AS r(k) WHERE {ROOM[1]} + (k + 1) * {SLAB} - y > -{RADIUS} - 0.2 AND {ROOM[1]} + k * {SLAB} - y < {RADIUS} + 0.2),
halves AS (
    SELECT scene_id, 'inner' AS bound, x, i, sqrt({RADIUS * RADIUS} - greatest(abs(lo), abs(hi)) ** 2) - 1e-9 AS half FROM sweep WHERE greatest(abs(lo), abs(hi)) < {RADIUS}
    UNION ALL SELECT scene_id, 'outer', x, i, sqrt({RADIUS * RADIUS} - greatest(lo, -hi, 0) ** 2) + 1e-9 FROM sweep WHERE greatest(lo, -hi, 0) < {RADIUS}),
slabs AS (SELECT scene_id, bound, i FROM (SELECT DISTINCT scene_id FROM objects), (VALUES ('inner'), ('outer')) AS b(bound), range(-1, {_N + 1}) AS r(i)),
covered AS (
    SELECT scene_id, bound, i, greatest(x - half, {ROOM[0] - CLEARANCE}) AS x0, least(x + half, {ROOM[2] + CLEARANCE}) AS x1 FROM halves
    UNION ALL SELECT scene_id, bound, i, e, e FROM slabs, (VALUES ({ROOM[0] - CLEARANCE}::DOUBLE), ({ROOM[2] + CLEARANCE}::DOUBLE)) AS v(e)),
holes AS (SELECT * FROM (SELECT scene_id, bound, i, max(x1) OVER (PARTITION BY scene_id, bound, i ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h0, x0 AS h1 FROM covered) WHERE h1 > h0),
blocked AS (
    SELECT scene_id, bound, i - k AS j, h0 - {CLEARANCE} - 1e-9 AS x0, h1 + {CLEARANCE} + 1e-9 AS x1 FROM holes, range(-1, 2) AS r(k) WHERE bound = 'inner'
    UNION ALL SELECT scene_id, bound, i, h0 - {CLEARANCE} + 1e-9, h1 + {CLEARANCE} - 1e-9 FROM holes WHERE bound = 'outer'),
subjects AS (SELECT scene_id, object_id AS subject_id, a, b, c, s, wide, high, top, {ROOM[0]} + wide AS l0, {ROOM[2]} - wide AS l1, {ROOM[1]} + high AS m0, {ROOM[3]} - high AS m1 FROM bound_feet WHERE movable AND NOT pinned),
taken AS (
    SELECT scene_id, subject_id, bound, j - k AS i, l0, l1, x0 - ({_STRIP.format(k="k")} + 1e-9) AS t0, x1 + ({_STRIP.format(k="(-k)")} + 1e-9) AS t1
    FROM subjects JOIN blocked USING (scene_id), range(-8, 9) AS r(k) WHERE bound = 'inner' AND abs(k) <= ceil(high / {SLAB})
    UNION ALL SELECT scene_id, subject_id, bound, j - k, l0, l1, x0 - ({_AT.format(k="k")} - 1e-9), x1 + ({_AT.format(k="(-k)")} - 1e-9)
    FROM subjects JOIN blocked USING (scene_id), range(-8, 9) AS r(k) WHERE bound = 'outer' AND abs(k) * {SLAB} <= high),
ends AS (
    SELECT scene_id, subject_id, bound, i, greatest(t0, l0) AS x0, least(t1, l1) AS x1 FROM taken WHERE greatest(t0, l0) < least(t1, l1) AND i BETWEEN 0 AND {_N - 1}
    UNION ALL SELECT scene_id, subject_id, bound, i, l0, l0 FROM subjects JOIN slabs USING (scene_id) WHERE i BETWEEN 0 AND {_N - 1}
    UNION ALL SELECT scene_id, subject_id, bound, i, l1, l1 FROM subjects JOIN slabs USING (scene_id) WHERE i BETWEEN 0 AND {_N - 1}),
free AS (SELECT * FROM (SELECT scene_id, subject_id, bound, i, max(x1) OVER (PARTITION BY scene_id, subject_id, bound, i ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x0, x0 AS x1 FROM ends) WHERE x1 > x0),
runs AS (
    SELECT f.*, least({ROOM[1]} + (i + 1) * {SLAB}, m1) - greatest({ROOM[1]} + i * {SLAB}, m0) AS tall FROM free f JOIN subjects USING (scene_id, subject_id)
    WHERE least({ROOM[1]} + (i + 1) * {SLAB}, m1) > greatest({ROOM[1]} + i * {SLAB}, m0)),
contacts AS (
    SELECT p.scene_id, p.subject_id, count(*) AS n FROM runs p JOIN runs q ON p.scene_id = q.scene_id AND p.subject_id = q.subject_id AND q.i = p.i + 1
    WHERE p.bound = 'inner' AND q.bound = 'inner' AND least(p.x1, q.x1) - greatest(p.x0, q.x0) > 1e-9 GROUP BY 1, 2),
areas AS (
    SELECT scene_id, subject_id, coalesce(sum((x1 - x0) * tall) FILTER (bound = 'inner'), 0) AS inner_area, coalesce(sum((x1 - x0) * tall) FILTER (bound = 'outer'), 0) AS outer_area,
        count(*) FILTER (bound = 'inner') AS n FROM runs GROUP BY 1, 2)
"""

QUERIES = {
    "navigation_points": (navigation_points, f"WITH {_POINTS} SELECT scene_id, count(*) AS points, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j FROM points GROUP BY 1"),
    "navigation_regions": (navigation_regions, f"WITH {_REGIONS} SELECT scene_id, subject_id, round(inner_area, 5) AS inner_area, round(outer_area, 5) AS outer_area, (areas.n - coalesce(contacts.n, 0))::BIGINT AS euler FROM areas LEFT JOIN contacts USING (scene_id, subject_id)"),
}
