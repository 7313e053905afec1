import random

from pyspark.sql import functions as F

from tessera.operators import domains as X
from tessera.sources.fixture import ROOM, scene_objects

SF = "/root/testdata/sf0.001"


def lit_rect(q):
    return X.rect(*(F.lit(float(v)) for v in q))


def test_regions_against_points(spark):
    r = random.Random(1)
    box = lambda: (lambda a, b, c, d: (min(a, b), max(a, b), min(c, d), max(c, d)))(*(r.randint(-6, 6) for _ in range(4)))
    for _ in range(6):
        cut, keep = [box() for _ in range(3)], box()
        region = X.meet(X.subtract_all(F.array(lit_rect((-5, 5, -5, 5))), F.array(*map(lit_rect, cut))), lit_rect(keep))
        pts = [(x + 0.5, y + 0.5) for x in range(-6, 6) for y in range(-6, 6)]
        row = spark.range(1).select(F.array(*[X.holds(region, F.lit(x), F.lit(y)) for x, y in pts]).alias("h"), X.nearest(region).alias("n")).first()
        inside = lambda q, p: q[0] < p[0] < q[1] and q[2] < p[1] < q[3]
        expected = [-5 <= x <= 5 and -5 <= y <= 5 and not any(inside(q, (x, y)) for q in cut) and inside(keep, (x, y)) for x, y in pts]
        assert row.h == expected
        if any(expected):
            assert row.n.d <= min((x * x + y * y) ** 0.5 for (x, y), e in zip(pts, expected, strict=True) if e)


def test_witnesses_are_allowed_and_bounds_hold(spark):
    d = scene_objects(spark, SF).filter("scene_id < 400").cache()
    found = X.certify(X.candidate_domain(d, X.distance_requests(d), ROOM, 6.0), 1.0).collect()
    objects = {}
    for o in d.collect():
        objects.setdefault(o.scene_id, {})[o.object_id] = o
    assert {f.status for f in found} >= {"CERTIFIED_SUCCESS"}
    for f in found:
        s, others = objects[f.scene_id][f.subject_id], objects[f.scene_id]

        def fine(dx, dy, s=s, others=others, f=f):
            x, y = s.x + dx, s.y + dy
            gap = {k: (max(abs(x - o.x) - (s.ex + o.ex) / 2, 0), max(abs(y - o.y) - (s.ey + o.ey) / 2, 0)) for k, o in others.items() if k != f.subject_id}
            dist = (gap[f.reference_id][0] ** 2 + gap[f.reference_id][1] ** 2) ** 0.5
            clear = all(max(gap[k]) > -1e-9 and (k == s.support_id or max(abs(x - o.x) - (s.ex + o.ex) / 2, abs(y - o.y) - (s.ey + o.ey) / 2) >= -1e-9) for k, o in others.items() if k != f.subject_id)
            return clear and (dist <= 0.5 + 1e-9 if f.relation_after == "near" else dist >= 1.5 - 1e-9)

        if f.witness is not None:
            assert fine(f.witness.x, f.witness.y) and f.lower <= f.upper + 1e-9


def test_turns_undo(spark):
    d = spark.createDataFrame([(1.5, -2.0)], "dx double, dy double")
    for q in range(4):
        x, y = X.cardinal(F.col("dx"), F.col("dy"), F.lit(-q))
        assert tuple(X.pull_back(d.select(x.alias("dx"), y.alias("dy")), q).first()) == (1.5, -2.0)
