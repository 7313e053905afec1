"""Planning: slots and batches, endpoint lists, moves that constraints allow, and deterministic schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry as G
from tessera.functions import relations as R

from .lineage import spread
from .pairs import c, ordered_pairs, side, z_overlap
from .roster import candidate_key

STRESS_SEEDS, STRESS_DIRECTIONS, STRESS_SLOTS, STRESS_SAT = (2026080200, 2026080210), ("fb", "lr", "nf"), 100, 60
#: Slots of a seed and direction that are transformed, by outcome.
STRESS_TRANSFORMED = {"SAT": 18, "UNSAT": 12}


def _with_slot(ordered: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    """relation, ``ids`` and slot_index of each request: the n-th of each relation goes to slot n.

    Requests are shuffled once, narrow, to the block of their relation, round and digest, and ranked and counted there. What
    is before a block follows from a row a block, made of the same shuffle; no window has to hold a whole relation.
    """
    key = ["relation", "round", "block"]
    # the bytes of the digest have the order of its digits and half their size
    d = ordered.select("relation", "round", F.substring("digest", 1, 3).alias("block"), F.unhex("digest").alias("at"), *ids)
    # as the joins below ask for, and said here so that all readings of the shuffle are alike
    d = d.filter("relation IS NOT NULL AND round IS NOT NULL AND block IS NOT NULL")
    block = Window.partitionBy(*key)
    # in the order of the ids too, so that both readings of the shuffle need the same columns of it
    d = d.withColumn("rank", F.row_number().over(block.orderBy("at", *ids)))
    last = F.row_number().over(block.orderBy(F.col("rank").desc())) == 1
    blocks = d.withColumn("last", last).filter("last").select(*key, F.col("rank").cast("long").alias("here"))
    sizes = blocks.groupBy("relation", "round").agg(F.sum("here").alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("relation").orderBy("round")) - F.col("size")).drop("size")
    within = F.sum("here").over(Window.partitionBy("relation", "round").orderBy("block")) - F.col("here")
    before = blocks.withColumn("within", within).join(sizes, ["relation", "round"]).select(*key, (F.col("before") + F.col("within")).alias("before"))
    return d.join(before, key).select("relation", *ids, (F.col("before") + F.col("rank") - 1).alias("slot_index"))


def slots(ordered: DataFrame) -> DataFrame:
    """A row a slot: its relations, whether it has all six, and what it lacks."""
    bit = R.lookup({r: R.bits(r) for r in R.RELATIONS}, F.col("relation"))
    # a slot has six rows at most, of as many tasks: nothing is gained by adding up before they meet
    d = spread(_with_slot(ordered).select("slot_index", bit.alias("bit")), "slot_index").groupBy("slot_index").agg(F.bit_or("bit").alias("r"))
    every = R.bits(*R.RELATIONS)
    names = lambda m: F.array_join(R.named(m), ",")
    return d.select("slot_index", names(F.col("r")).alias("relations"), F.when(F.col("r") == every, "ready").otherwise("incomplete").alias("status"), names(F.lit(every).bitwiseXOR(F.col("r"))).alias("missing"))


def batches(ordered: DataFrame) -> DataFrame:
    """A slot's requests, at most one a relation, in order of their key; the batch's id is their digest. Incomplete slots form batches too."""
    d = spread(_with_slot(ordered, ("scene_id", "s_object_id", "r_object_id")), "slot_index").groupBy("slot_index").agg(F.array_sort(F.collect_list(candidate_key())).alias("requests"))
    return d.select("slot_index", F.size("requests").cast("long").alias("size"), F.concat(F.lit("batch-"), F.sha2(F.array_join("requests", ",").cast("binary"), 256)).alias("batch_id"), "requests")


def interleave(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Two ranked lists (scene_id, x, y, rank) dealt in turn; the first owns points of both; ``most`` a scene."""
    d = first.withColumn("o", F.lit(0)).unionByName(second.withColumn("o", F.lit(1)))
    own = d.groupBy("scene_id", "x", "y").agg(F.min(F.struct("o", "rank")).alias("m")).select("scene_id", "x", "y", "m.*")
    ranked = own.withColumn("position", F.row_number().over(Window.partitionBy("scene_id").orderBy("rank", "o")).cast("long")).filter(F.col("position") <= most)
    return ranked.withColumn("origin", F.when(F.col("o") == 0, "native").otherwise("legacy"))


def obstacle_partition(objects: DataFrame, reach: float) -> DataFrame:
    """Of each movable subject how many others cannot be touched: apart in height, or beyond the reach and the sums of half extents."""
    d = ordered_pairs(objects, ("x", "y", "z", "ex", "ey", "ez", "movable")).filter("s_movable")
    wide = reach + (c("s", "ex") + c("s", "ey")) / 2 + (c("r", "ex") + c("r", "ey")) / 2
    apart = (z_overlap() <= 0) | (F.abs(c("s", "x") - c("r", "x")) > wide) | (F.abs(c("s", "y") - c("r", "y")) > wide)
    return d.groupBy("scene_id", F.col("s_object_id").alias("subject_id")).agg(F.count_if(apart).alias("disjoint"), F.count_if(~apart).alias("kept"))


def support_domain(objects: DataFrame, margin: float = 0.0) -> DataFrame:
    """The rectangle of centres for which a box's plan stays on its support's, less a margin; possibly empty."""
    held = objects.filter("support_id IS NOT NULL").select("scene_id", "object_id", "support_id", "ex", "ey")
    d = held.join(side(objects, "h", ("object_id", "x", "y", "ex", "ey")).withColumnRenamed("h_object_id", "support_id"), ["scene_id", "support_id"])
    lo = lambda a, e: F.col(f"h_{a}") - F.col(f"h_{e}") / 2 + F.col(e) / 2 + margin
    hi = lambda a, e: F.col(f"h_{a}") + F.col(f"h_{e}") / 2 - F.col(e) / 2 - margin
    d = d.withColumns({"x_lo": lo("x", "ex"), "x_hi": hi("x", "ex"), "y_lo": lo("y", "ey"), "y_hi": hi("y", "ey")})
    return d.withColumn("empty", (F.col("x_lo") > F.col("x_hi")) | (F.col("y_lo") > F.col("y_hi")))


def collision_rectangles(objects: DataFrame, universe: float) -> DataFrame:
    """For each subject and other at its height, the moves (within ±universe) left by the plain obstacle (outer) and by the one widened by its clearance (inner), as areas."""
    d = ordered_pairs(objects, ("x", "y", "z", "ex", "ey", "ez", "movable", "clearance")).filter(F.col("s_movable") & (z_overlap() > 0))

    def taken(wider: Column) -> Column:
        span = lambda a, e: F.greatest(F.least(c("r", a) - c("s", a) + (c("s", e) + c("r", e)) / 2 + wider, F.lit(universe)) - F.greatest(c("r", a) - c("s", a) - (c("s", e) + c("r", e)) / 2 - wider, F.lit(-universe)), F.lit(0.0))
        return span("x", "ex") * span("y", "ey")

    whole = 4 * universe * universe
    return d.withColumns({"outer_area": whole - taken(F.lit(0.0)), "inner_area": whole - taken(c("r", "clearance"))})


def distance_brackets(objects: DataFrame, t: float) -> DataFrame:
    """Whether the present place is surely (inner) or possibly (outer) near or far, by rectangles in and around the rounded ones."""
    d = ordered_pairs(objects, ("x", "y", "ex", "ey"))
    gx = F.greatest(F.abs(c("s", "x") - c("r", "x")) - (c("s", "ex") + c("r", "ex")) / 2, F.lit(0.0))
    gy = F.greatest(F.abs(c("s", "y") - c("r", "y")) - (c("s", "ey") + c("r", "ey")) / 2, F.lit(0.0))
    d = d.withColumns({"gx": gx, "gy": gy})
    within = lambda r: (F.col("gx") <= r) & (F.col("gy") <= r)
    return d.withColumns({"near_inner": within(t / 2), "near_outer": within(t), "far_inner": ~((F.col("gx") < t) & (F.col("gy") < t)), "far_outer": (F.col("gx") > 0) | (F.col("gy") > 0)})


def _two(b) -> tuple[Column, Column]:
    return tuple(F.col(x) if isinstance(x, str) else x for x in b)


def bracket_and(a, b) -> tuple[Column, Column]:
    """Inner and outer of an intersection."""
    (ai, ao), (bi, bo) = _two(a), _two(b)
    return ai & bi, ao & bo


def bracket_or(a, b) -> tuple[Column, Column]:
    (ai, ao), (bi, bo) = _two(a), _two(b)
    return ai | bi, ao | bo


def bracket_not(inner, outer) -> tuple[Column, Column]:
    """What is not possibly in is surely out, and the other way round."""
    i, o = _two((inner, outer))
    return ~o, ~i


def rectilinear_areas(objects: DataFrame, unit: float = 1e-4) -> DataFrame:
    """Areas covered by any, by several and by a single footprint of a scene, exact on a grid of integers made of the sides."""
    at = lambda e: F.round(e / unit).cast("long")
    r = objects.select("scene_id", at(F.col("x") - F.col("ex") / 2).alias("x0"), at(F.col("x") + F.col("ex") / 2).alias("x1"), at(F.col("y") - F.col("ey") / 2).alias("y0"), at(F.col("y") + F.col("ey") / 2).alias("y1"))
    lines = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(a, b)))))
    d = r.groupBy("scene_id").agg(lines("x0", "x1").alias("xs"), lines("y0", "y1").alias("ys"), F.collect_list(F.struct("x0", "x1", "y0", "y1")).alias("boxes"))
    spans = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.struct(F.element_at(v, i).alias("lo"), F.element_at(v, i + 1).alias("hi")))
    d = d.withColumn("h", F.explode(spans(F.col("xs")))).withColumn("v", F.explode(spans(F.col("ys"))))
    over = F.size(F.filter("boxes", lambda b: (b["x0"] <= F.col("h.lo")) & (b["x1"] >= F.col("h.hi")) & (b["y0"] <= F.col("v.lo")) & (b["y1"] >= F.col("v.hi"))))
    d = d.select("scene_id", ((F.col("h.hi") - F.col("h.lo")) * (F.col("v.hi") - F.col("v.lo"))).alias("a"), over.alias("k"))
    area = lambda on: F.sum(F.when(on, F.col("a")).otherwise(0)) * (unit * unit)
    return d.groupBy("scene_id").agg(area(F.col("k") > 0).alias("union_area"), area(F.col("k") > 1).alias("overlap_area"), area(F.col("k") == 1).alias("alone_area"))


def interval_bounds(objects: DataFrame, target: float = 0.5) -> DataFrame:
    """Weighted interval sums, the least normalised margin with its deficit, and how far the best upper bound is from the best lower one."""
    w = 1 / (F.col("object_id") + 1)
    lo, hi = F.greatest(F.lit(0.0), F.col("x") - 4, -F.col("x") - F.col("ex")), F.abs("x") + F.col("ex")
    margin = (F.col("ez") - 0.35) / 0.35
    return objects.groupBy("scene_id").agg(F.sum(w * lo).alias("lo"), F.sum(w * hi).alias("hi"), F.min(margin).alias("slack"), F.greatest(F.lit(0.0), target - F.min(margin)).alias("deficit"), (F.min(hi) - F.min(lo)).alias("gap"))


def absolute_delta(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    """The range of |a - b| for two intervals."""
    return F.greatest(F.lit(0.0), a_lo - b_hi, b_lo - a_hi), F.greatest(a_hi - b_lo, b_hi - a_lo)


def cell_distance(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column) -> tuple[Column, Column]:
    """The least and greatest distance from the origin to a rectangle."""
    near = lambda lo, hi: F.greatest(F.lit(0.0), lo, -hi)
    far = lambda lo, hi: F.greatest(F.abs(lo), F.abs(hi))
    return F.hypot(near(x_lo, x_hi), near(y_lo, y_hi)), F.hypot(far(x_lo, x_hi), far(y_lo, y_hi))


def stress_schedule(spark: SparkSession) -> DataFrame:
    """Every seed, direction and slot with its outcome and whether it is transformed: the slots with the least digests."""
    d = spark.range(*STRESS_SEEDS).withColumnRenamed("id", "seed").withColumn("direction", F.explode(F.array(*[F.lit(x) for x in STRESS_DIRECTIONS]))).withColumn("raw_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STRESS_SLOTS - 1).cast("long"))))
    d = d.withColumn("outcome", F.when(F.col("raw_slot") < STRESS_SAT, "SAT").otherwise("UNSAT"))
    digest = F.sha2(F.concat_ws("|", "seed", "direction", "raw_slot").cast("binary"), 256)
    rank = F.row_number().over(Window.partitionBy("seed", "direction", "outcome").orderBy(digest))
    most = F.when(F.col("outcome") == "SAT", STRESS_TRANSFORMED["SAT"]).otherwise(STRESS_TRANSFORMED["UNSAT"])
    return d.withColumn("transformed", rank <= most)


def turn(objects: DataFrame, cx: float, cy: float) -> DataFrame:
    """The scene turned by 90 degrees about a point, counter-clockwise."""
    return objects.withColumns({"x": cx - (F.col("y") - cy), "y": cy + (F.col("x") - cx), "ex": F.col("ey"), "ey": F.col("ex")})


def mirror(objects: DataFrame, cx: float) -> DataFrame:
    return objects.withColumn("x", 2 * cx - F.col("x"))


def box_contact(a_footprint: Column, b_footprint: Column, z_gap: Column) -> Column:
    """PROVEN_SEPARATED, PROVEN_CLOSED_INTERSECTION or UNKNOWN for two upright boxes, by the gaps along height and the four side normals."""
    gap = G.separation(a_footprint, b_footprint)
    return F.when((z_gap > 0) | (gap > G.CONTACT), "PROVEN_SEPARATED").when((z_gap <= 0) & (gap <= -G.CONTACT), "PROVEN_CLOSED_INTERSECTION").otherwise("UNKNOWN")
