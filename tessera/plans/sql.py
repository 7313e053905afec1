"""Pieces of DuckDB SQL that the checks of several queries share."""

from __future__ import annotations

from tessera.functions.relations import AXES, AXIS, CONVERSE, OPPOSITE, RELATIONS
from tessera.sources.fixture import OBJECTS


def visible(p: str, truncated: str | None = None) -> str:
    return f"({p}.visible_fraction >= 0.2::DOUBLE AND {p}.image_area_fraction >= 0.0025::DOUBLE AND {truncated or p + '.truncated_fraction'} <= 0.5::DOUBLE)"


def gap(ax: str, ay: str, aex: str, aey: str, b: str) -> str:
    side = lambda a, x, e: f"greatest(abs({a} - {b}.{x}) - ({e} + {b}.{'ex' if x == 'x' else 'ey'}) / 2, 0::DOUBLE)"
    gx, gy = side(ax, "x", aex), side(ay, "y", aey)
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def satisfied(relation: str, seen: str, dx: str, dd: str, g: str) -> str:
    if relation == "near":
        return f"({seen} AND {g} <= 0.5::DOUBLE)"
    if relation == "far":
        return f"({seen} AND {g} >= 1.5::DOUBLE)"
    delta, t = (dx, "32::DOUBLE") if AXIS[relation] == "horizontal" else (dd, "0.2::DOUBLE")
    signed = delta if relation in ("left", "front") else f"-({delta})"
    return f"({seen} AND ({signed} >= {t} OR (abs(abs({delta}) - {t}) <= 1e-9 AND {signed} > 0)))"


def dead(relation: str, dx: str, dd: str, g: str) -> str:
    if AXIS[relation] == "distance":
        return f"({g} > 0.5::DOUBLE AND {g} < 1.5::DOUBLE)"
    delta, t = (dx, "32::DOUBLE") if AXIS[relation] == "horizontal" else (dd, "0.2::DOUBLE")
    return f"(abs({delta}) < {t} AND abs(abs({delta}) - {t}) > 1e-9)"


def labels(seen: str, dx: str, dd: str, g: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {satisfied(r, seen, dx, dd, g)} THEN '{r}' END" for r in RELATIONS) + "], lambda v: v IS NOT NULL)"


def lookup(mapping: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def on_axis(found: str, axis: str) -> str:
    return f"list_filter({found}, lambda v: {' OR '.join(f'v = {r!r}' for r in RELATIONS if AXIS[r] == axis)})"


PAIRS = f"""{OBJECTS},
pairs AS (
    SELECT s.scene_id, s.object_id AS s_id, r.object_id AS r_id, s.category AS s_category, r.category AS r_category, s.scene_size,
        s.x AS sx, s.y AS sy, s.z AS sz, s.ex AS sex, s.ey AS sey, s.ez AS sez, r.x AS rx, r.y AS ry, r.z AS rz, r.ex AS rex, r.ey AS rey, r.ez AS rez,
        s.movable AS s_movable, s.pinned AS s_pinned, {visible("s")} AND {visible("r")} AS seen, r.cx - s.cx AS dx, r.depth - s.depth AS dd, {gap("s.x", "s.y", "s.ex", "s.ey", "r")} AS gap
    FROM objects s JOIN objects r ON s.scene_id = r.scene_id AND s.object_id <> r.object_id),
labelled AS (SELECT *, {labels("seen", "dx", "dd", "gap")} AS labels FROM pairs)
"""
OBSERVED = f"""{PAIRS},
observed AS (""" + " UNION ALL ".join(
    f"""SELECT scene_id, s_id, r_id, '{r}' AS relation, {satisfied(r, "seen", "dx", "dd", "gap")} AS satisfied,
        CASE WHEN NOT seen THEN 'NOT_VISIBLE' WHEN {dead(r, "dx", "dd", "gap")} THEN 'AMBIGUOUS' ELSE 'SUCCESS' END AS status,
        CASE WHEN NOT seen THEN 0::DOUBLE """
    + (
        f"""WHEN {dead(r, "dx", "dd", "gap")} THEN 0::DOUBLE ELSE abs({'0.5::DOUBLE - gap' if r == 'near' else 'gap - 1.5::DOUBLE'}) END"""
        if AXIS[r] == "distance"
        else (lambda d, t: f"WHEN abs(abs({d}) - {t}) <= 1e-9 THEN 0::DOUBLE ELSE abs({d}) - {t} END")(*(("dx", "32::DOUBLE") if AXIS[r] == "horizontal" else ("dd", "0.2::DOUBLE")))
    )
    + " AS margin FROM pairs"
    for r in RELATIONS
) + ")\n"
CLOSURE = f"""{PAIRS},
closure AS (
    WITH RECURSIVE up(scene_id, child, ancestor) AS (
        SELECT scene_id, object_id, support_id FROM objects WHERE support_id IS NOT NULL
        UNION SELECT up.scene_id, up.child, o.support_id FROM up JOIN objects o ON o.scene_id = up.scene_id AND o.object_id = up.ancestor WHERE o.support_id IS NOT NULL)
    SELECT * FROM up)
"""
INVENTORY = f"""{CLOSURE},
cyclic AS (SELECT DISTINCT scene_id, child FROM closure WHERE child = ancestor),
holders AS (SELECT DISTINCT scene_id, support_id FROM objects WHERE support_id IS NOT NULL),
facts AS (
    SELECT o.*, count(*) OVER (PARTITION BY o.scene_id, o.category) = 1 AS unique_category, h.support_id IS NOT NULL AS has_child,
        CASE WHEN y.child IS NOT NULL THEN 'CYCLIC' WHEN o.support_id IS NULL THEN 'FLOOR' ELSE 'RECEPTACLE' END AS support_kind
    FROM objects o LEFT JOIN holders h ON h.scene_id = o.scene_id AND h.support_id = o.object_id LEFT JOIN cyclic y ON y.scene_id = o.scene_id AND y.child = o.object_id),
inventory AS (
    SELECT *, CASE WHEN NOT movable THEN 'REJECTED_NOT_MOVABLE' WHEN pinned THEN 'REJECTED_PINNED' WHEN has_child THEN 'REJECTED_HAS_DEPENDENT_CHILD' WHEN support_kind = 'CYCLIC' THEN 'REJECTED_UNKNOWN_SUPPORT'
            WHEN support_kind = 'RECEPTACLE' THEN 'ELIGIBLE_RECEPTACLE_DOMAIN' ELSE 'ELIGIBLE_FLOOR_INNER_DOMAIN' END AS subject_state,
        unique_category AND least(ex, ey, ez) > 0 AS reference_eligible FROM facts)
"""
CANDIDATES = f"""{INVENTORY},
candidates AS (
    SELECT l.scene_id, l.s_id, l.r_id, l.s_category, l.r_category, s.support_kind, s.split, q.relation,
        CASE WHEN NOT s.unique_category THEN 'REJECTED_AMBIGUOUS_SUBJECT' WHEN NOT r.unique_category THEN 'REJECTED_AMBIGUOUS_REFERENCE' WHEN s.subject_state LIKE 'REJECTED%' THEN 'REJECTED_SUBJECT'
            WHEN NOT r.reference_eligible THEN 'REJECTED_REFERENCE' WHEN c.child IS NOT NULL THEN 'REJECTED_DEPENDENCY' WHEN NOT seen THEN 'REJECTED_NOT_VISIBLE'
            WHEN CASE WHEN q.axis = 'horizontal' THEN abs(dx) < 32::DOUBLE - 1e-9 WHEN q.axis = 'depth' THEN abs(dd) < 0.2::DOUBLE - 1e-9 ELSE gap > 0.5::DOUBLE AND gap < 1.5::DOUBLE END THEN 'REJECTED_AMBIGUOUS'
            WHEN NOT list_contains(labels, q.relation) THEN 'REJECTED_NOT_OBSERVED' ELSE 'PENDING' END AS state
    FROM labelled l JOIN inventory s ON s.scene_id = l.scene_id AND s.object_id = l.s_id JOIN inventory r ON r.scene_id = l.scene_id AND r.object_id = l.r_id
    LEFT JOIN closure c ON c.scene_id = l.scene_id AND c.child = l.s_id AND c.ancestor = l.r_id
    CROSS JOIN (VALUES {", ".join(f"('{r}', '{AXIS[r]}')" for r in RELATIONS)}) q(relation, axis))
"""
KEY = "concat_ws(':', scene_id, s_id, r_id, rel_before)"
REQUESTS = f"""{PAIRS},
requests AS (
    SELECT l.scene_id, s_id, r_id, u.relation AS rel_before, {lookup(OPPOSITE, "u.relation")} AS rel_after
    FROM labelled l, unnest(l.labels) AS u(relation)
    WHERE s_movable AND NOT s_pinned AND NOT EXISTS (SELECT 1 FROM objects h WHERE h.scene_id = l.scene_id AND h.support_id = l.s_id))
"""


def verified(moves: str, strict: bool = False) -> str:
    """CTEs up to ``scored`` over a CTE that has scene_id, s_id, r_id, rel_before, rel_after, nx, ny."""
    a_seen = f"{visible('s', 'a_trunc')} AND {visible('o')}"
    b_seen = f"{visible('s')} AND {visible('o')}"
    differs = lambda axis: f"({on_axis('fb', axis)} <> {on_axis('fa', axis)})"
    target_axis = lookup(AXIS, "rel_before")
    items = "list_filter([" + ", ".join(f"CASE WHEN {differs(a)} AND NOT (o_id = r_id AND {target_axis} = '{a}') THEN least(s_id, o_id) || '|' || greatest(s_id, o_id) || ':{a}' END" for a in AXES) + "], lambda v: v IS NOT NULL)"
    minus = lambda sign, p, q, x, y: f"list_transform(list_filter({p}, lambda v: NOT list_contains({q}, v)), lambda v: '{sign}' || {x} || ':' || v || ':' || {y})"
    conv = lambda f: f"list_sort(list_transform({f}, lambda v: {lookup(CONVERSE, 'v')}))"
    strict_case = "WHEN collateral OR leaks > 0 THEN 'UNSATISFIABLE'" if strict else ""
    return f"""
    v1 AS (SELECT m.*, s.x AS sx, s.y AS sy, s.ex AS sex, s.ey AS sey, s.z AS sz, s.ez AS sez, s.cx AS scx, s.depth AS sdepth, s.scene_size AS size_, s.support_id AS sup, s.movable AS mov, s.pinned AS pin, s.truncated_fraction AS b_trunc,
            s.visible_fraction AS s_vis, s.image_area_fraction AS s_area, s.xmin AS sxmin, s.xmax AS sxmax, s.ymin AS symin, s.ymax AS symax,
            ny + 2::DOUBLE + (s.depth - (s.y + 2::DOUBLE)) AS a_depth,
            (nx - 4::DOUBLE) * 320::DOUBLE / (CASE WHEN ny > -2 THEN ny + 2::DOUBLE END) + 320::DOUBLE + (s.cx - ((s.x - 4::DOUBLE) * 320::DOUBLE / (s.y + 2::DOUBLE) + 320::DOUBLE)) AS a_cx,
            (s.ymin + s.ymax) / 2 + 320::DOUBLE * (1.5::DOUBLE - s.z) / (CASE WHEN ny > -2 THEN ny + 2::DOUBLE END) - 320::DOUBLE * (1.5::DOUBLE - s.z) / (s.y + 2::DOUBLE) AS a_cy
        FROM {moves} m JOIN objects s ON s.scene_id = m.scene_id AND s.object_id = m.s_id),
    v2 AS (SELECT *, a_cx - (sxmax - sxmin) / 2 AS axmin, a_cx + (sxmax - sxmin) / 2 AS axmax, a_cy - (symax - symin) / 2 AS aymin, a_cy + (symax - symin) / 2 AS aymax FROM v1),
    v3 AS (SELECT *, CASE WHEN a_cx IS NULL OR (axmax - axmin) * (aymax - aymin) <= 0 THEN 1 ELSE 1 - greatest(0::DOUBLE, least(axmax, 640::DOUBLE) - greatest(axmin, 0::DOUBLE)) * greatest(0::DOUBLE, least(aymax, 480::DOUBLE) - greatest(aymin, 0::DOUBLE)) / ((axmax - axmin) * (aymax - aymin)) END AS a_trunc FROM v2),
    v4 AS (SELECT v3.*, o.object_id AS o_id, o.x AS ox, o.y AS oy, o.ex AS oex, o.ey AS oey, {b_seen.replace("s.visible_fraction", "s_vis").replace("s.image_area_fraction", "s_area").replace("s.truncated_fraction", "b_trunc")} AS seen_b,
            {a_seen.replace("s.visible_fraction", "s_vis").replace("s.image_area_fraction", "s_area")} AS seen_a, o.cx - scx AS dxb, o.depth - sdepth AS ddb, o.cx - a_cx AS dxa, o.depth - a_depth AS dda,
            {gap("sx", "sy", "sex", "sey", "o")} AS gb, {gap("nx", "ny", "sex", "sey", "o")} AS ga,
            least(sz + sez / 2, o.z + o.ez / 2) - greatest(sz - sez / 2, o.z - o.ez / 2) AS zc,
            greatest(least(nx + sex / 2, o.x + o.ex / 2) - greatest(nx - sex / 2, o.x - o.ex / 2), 0::DOUBLE) * greatest(least(ny + sey / 2, o.y + o.ey / 2) - greatest(ny - sey / 2, o.y - o.ey / 2), 0::DOUBLE) AS area,
            coalesce(o.object_id <> sup, true) AS free
        FROM v3 JOIN objects o ON o.scene_id = v3.scene_id AND o.object_id <> v3.s_id),
    v5 AS (SELECT *, {labels("seen_b", "dxb", "ddb", "gb")} AS fb, {labels("seen_a", "dxa", "dda", "ga")} AS fa, {labels("seen_b", "-dxb", "-ddb", "gb")} AS rb, {labels("seen_a", "-dxa", "-dda", "ga")} AS ra FROM v4),
    v6 AS (SELECT scene_id, s_id, r_id, rel_before, rel_after, nx, ny,
            list('collision:' || o_id) FILTER (WHERE free AND area > 1e-9 AND zc > 1e-9) AS hits,
            bool_or(NOT (abs(nx - ox) <= (oex - sex) / 2 + 1e-6 AND abs(ny - oy) <= (oey - sey) / 2 + 1e-6)) FILTER (WHERE o_id = sup) AS bad_support,
            bool_or(NOT (nx - sex / 2 >= -1 - 1e-6 AND nx + sex / 2 <= 9 + 1e-6 AND ny - sey / 2 >= -1 - 1e-6 AND ny + sey / 2 <= 9 + 1e-6)) AS outside, bool_or(NOT mov OR pin) AS fixed,
            any_value(seen_b) FILTER (WHERE o_id = r_id) AS tsb, any_value(seen_a) FILTER (WHERE o_id = r_id) AS tsa,
            any_value(fb) FILTER (WHERE o_id = r_id) AS tfb, any_value(fa) FILTER (WHERE o_id = r_id) AS tfa, any_value(rb) FILTER (WHERE o_id = r_id) AS trb, any_value(ra) FILTER (WHERE o_id = r_id) AS tra,
            any_value(dxa) FILTER (WHERE o_id = r_id) AS tdx, any_value(dda) FILTER (WHERE o_id = r_id) AS tdd, any_value(ga) FILTER (WHERE o_id = r_id) AS tg,
            bool_or({" OR ".join(f"({differs(a)} AND {target_axis} <> '{a}')" for a in AXES)}) FILTER (WHERE o_id = r_id) AS collateral,
            count(*) FILTER (WHERE o_id <> r_id AND (fb <> fa OR rb <> ra)) AS leaks,
            list_sort(flatten(list({minus("-", "fb", "fa", "s_id", "o_id")} || {minus("+", "fa", "fb", "s_id", "o_id")} || {minus("-", "rb", "ra", "o_id", "s_id")} || {minus("+", "ra", "rb", "o_id", "s_id")}))) AS changed,
            list_sort(flatten(list({items}))) AS items, min(ga) FILTER (WHERE free AND zc > 1e-9) AS clear,
            max(least(nx - sex / 2 + 1, 9 - nx - sex / 2, ny - sey / 2 + 1, 9 - ny - sey / 2)) AS boundary, max(b_trunc) AS tb, max(a_trunc) AS ta, max(sx) AS ox_, max(sy) AS oy_, max(size_) AS size_
        FROM v5 GROUP BY ALL),
    v7 AS (SELECT *, list_sort(coalesce(hits, []) || list_filter([CASE WHEN outside THEN 'outside_room' END, CASE WHEN fixed THEN 'subject_not_movable' END,
            CASE WHEN EXISTS (SELECT 1 FROM objects h WHERE h.scene_id = v6.scene_id AND h.support_id = v6.s_id) THEN 'subject_has_supported_objects' END, CASE WHEN bad_support THEN 'support_invalid' END], lambda v: v IS NOT NULL)) AS errs FROM v6),
    v8 AS (SELECT *, CASE WHEN len(errs) > 0 THEN 'INVALID_SCENE' WHEN NOT tsb OR NOT tsa THEN 'NOT_VISIBLE' WHEN NOT list_contains(tfb, rel_before) THEN 'AMBIGUOUS'
            WHEN NOT list_contains(tfa, rel_after) OR list_contains(tfa, rel_before) THEN 'AMBIGUOUS' WHEN trb <> {conv("tfb")} OR tra <> {conv("tfa")} THEN 'UNSATISFIABLE' {strict_case} ELSE 'SUCCESS' END AS status FROM v7),
    scored AS (SELECT *, CASE WHEN status <> 'SUCCESS' THEN 'REJECTED' WHEN len(items) > 0 THEN 'LOW_LEAKAGE' ELSE 'PURE' END AS quality,
            CASE WHEN status = 'SUCCESS' THEN leaks ELSE 0 END AS leakage, CASE WHEN status = 'SUCCESS' THEN len(items) ELSE 0 END AS relation_damage,
            array_to_string(errs, ',') AS errors, CASE WHEN status = 'SUCCESS' THEN array_to_string(changed, ',') ELSE '' END AS changes,
            sqrt((nx - ox_) * (nx - ox_) + (ny - oy_) * (ny - oy_)) / sqrt(200::DOUBLE) AS translation,
            least(1::DOUBLE, (CASE WHEN status = 'SUCCESS' THEN len(items) ELSE 0 END) / greatest(3 * (size_ - 1) - 1, 1)) AS damage,
            least(1::DOUBLE, abs(tb - ta) / greatest(abs(tb), 1e-6)) AS visibility,
            1 / (1 + greatest(0::DOUBLE, least(least(abs(boundary), coalesce(clear, abs(boundary))) / greatest(0.02::DOUBLE * sqrt(200::DOUBLE), 0.1::DOUBLE),
                CASE WHEN rel_after IN ('left', 'right') THEN abs(abs(tdx) - 32::DOUBLE) / 32 WHEN rel_after IN ('front', 'behind') THEN abs(abs(tdd) - 0.2::DOUBLE) / 0.2::DOUBLE WHEN rel_after = 'near' THEN abs(0.5::DOUBLE - tg) / 0.5::DOUBLE ELSE abs(tg - 1.5::DOUBLE) / 1.5::DOUBLE END))) AS safety FROM v8)
    """
