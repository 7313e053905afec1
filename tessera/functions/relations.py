"""Spatial relations between two objects seen by one camera, as column expressions.

Fixed values of the relation semantics: left and right need 5 % of the image width between the centres, front and
behind 0.20 m of depth, near at most 0.50 m and far at least 1.50 m between footprints; between these an axis is
ambiguous. An object counts as visible from 0.20 visible, 0.0025 of the image and at most 0.50 truncated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("behind", "far", "front", "left", "near", "right")
AXES = ("depth", "distance", "horizontal")
AXIS = {"left": "horizontal", "right": "horizontal", "front": "depth", "behind": "depth", "near": "distance", "far": "distance"}
OPPOSITE = {"left": "right", "right": "left", "front": "behind", "behind": "front", "near": "far", "far": "near"}
CONVERSE = OPPOSITE | {"near": "near", "far": "far"}
WIDTH_SHARE, DEPTH_M, NEAR_M, FAR_M, TOLERANCE = 0.05, 0.20, 0.50, 1.50, 1e-9
MIN_VISIBLE, MIN_AREA, MAX_TRUNCATED = 0.20, 0.0025, 0.50


def lookup(mapping: dict, relation: Column) -> Column:
    """The value that a relation has in AXIS, OPPOSITE or CONVERSE."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), relation)


def is_visible(visible: Column, area: Column, truncated: Column) -> Column:
    """All three bounds are inclusive; a missing view is not visible."""
    return F.coalesce((visible >= MIN_VISIBLE) & (area >= MIN_AREA) & (truncated <= MAX_TRUNCATED), F.lit(False))


def _result(satisfied: Column, margin: Column, status: Column) -> Column:
    return F.struct(satisfied.alias("satisfied"), margin.cast("double").alias("margin"), status.alias("status"))


def observe(relation: str, both_visible: Column, dx: Column, dd: Column, gap: Column, width: Column | float = 640.0) -> Column:
    """struct(satisfied, margin, status) of one relation.

    ``dx`` and ``dd`` are the reference's image centre and depth minus the subject's; ``gap`` is the distance of the
    footprints. Visibility gates all relations. The margin of a directional relation is the distance beyond the
    threshold whichever way it points, so that the opposite relation has the same one.
    """
    if relation in ("near", "far"):
        dead = (gap > NEAR_M) & (gap < FAR_M)
        satisfied = gap <= NEAR_M if relation == "near" else gap >= FAR_M
        margin = F.abs(F.lit(NEAR_M) - gap) if relation == "near" else F.abs(gap - FAR_M)
        told = F.when(dead, _result(F.lit(False), F.lit(0.0), F.lit("AMBIGUOUS"))).otherwise(_result(satisfied, margin, F.lit("SUCCESS")))
    else:
        delta, threshold = (dx, F.lit(width) * WIDTH_SHARE) if AXIS[relation] == "horizontal" else (dd, F.lit(DEPTH_M))
        signed = delta if relation in ("left", "front") else -delta
        at = F.abs(F.abs(delta) - threshold) <= TOLERANCE
        beyond = F.abs(delta) - threshold
        told = F.when((F.abs(delta) < threshold) & ~at, _result(F.lit(False), beyond, F.lit("AMBIGUOUS"))).otherwise(
            _result((signed >= threshold) | (at & (signed > 0)), F.when(at, 0.0).otherwise(beyond), F.lit("SUCCESS"))
        )
    return F.when(both_visible, told).otherwise(_result(F.lit(False), F.lit(0.0), F.lit("NOT_VISIBLE")))


def observe_all(both_visible: Column, dx: Column, dd: Column, gap: Column, width: Column | float = 640.0) -> Column:
    """array of struct(relation, satisfied, margin, status), in the order of RELATIONS."""
    rows = []
    for r in RELATIONS:
        o = observe(r, both_visible, dx, dd, gap, width)
        rows.append(F.struct(F.lit(r).alias("relation"), o["satisfied"].alias("satisfied"), o["margin"].alias("margin"), o["status"].alias("status")))
    return F.array(*rows)


def holds(relation: str, both_visible: Column, dx: Column, dd: Column, gap: Column, width: Column | float = 640.0) -> Column:
    """``observe(...)["satisfied"]`` without the rest; false where it is null."""
    if relation in ("near", "far"):
        told = gap <= NEAR_M if relation == "near" else gap >= FAR_M
    else:
        delta, threshold = (dx, F.lit(width) * WIDTH_SHARE) if AXIS[relation] == "horizontal" else (dd, F.lit(DEPTH_M))
        signed = delta if relation in ("left", "front") else -delta
        told = (signed >= threshold) | ((F.abs(F.abs(delta) - threshold) <= TOLERANCE) & (signed > 0))
    return F.coalesce(both_visible & told, F.lit(False))


def mask(both_visible: Column, dx: Column, dd: Column, gap: Column, width: Column | float = 640.0) -> Column:
    """The satisfied relations as a number: bit k for the k-th of RELATIONS. Plain arithmetic, which Spark compiles, unlike lambdas on arrays."""
    bits = [F.when(holds(r, both_visible, dx, dd, gap, width), 1 << k).otherwise(0) for k, r in enumerate(RELATIONS)]
    return sum(bits[1:], bits[0])


def bits(*relations: str) -> int:
    return sum(1 << RELATIONS.index(r) for r in relations)


def on_axis_bits(axis: str) -> int:
    return bits(*[r for r in RELATIONS if AXIS[r] == axis])


def named(found: Column) -> Column:
    """The sorted array of the relations of a mask."""
    every = [[r for k, r in enumerate(RELATIONS) if m >> k & 1] for m in range(1 << len(RELATIONS))]
    return F.get(F.array(*[F.array(*map(F.lit, names)) if names else F.array().cast("array<string>") for names in every]), found)


def has(found: Column, relation: Column) -> Column:
    """Whether a mask has the relation that a column names."""
    return found.bitwiseAND(lookup({r: bits(r) for r in RELATIONS}, relation)) != 0


def converse_mask(found: Column) -> Column:
    """The mask of the converses."""
    every = [bits(*[CONVERSE[r] for k, r in enumerate(RELATIONS) if m >> k & 1]) for m in range(1 << len(RELATIONS))]
    return F.get(F.array(*map(F.lit, every)), found)


def labels(both_visible: Column, dx: Column, dd: Column, gap: Column, width: Column | float = 640.0) -> Column:
    """The sorted array of satisfied relations."""
    return named(mask(both_visible, dx, dd, gap, width))


def converses(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda r: lookup(CONVERSE, r)))


def on_axis(found: Column, axis: str) -> Column:
    return F.array_intersect(found, F.array(*[F.lit(r) for r in RELATIONS if AXIS[r] == axis]))
