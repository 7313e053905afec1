"""The roster: inventories, the cascade of candidate states, seeded order, quotas, rejections and summaries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import relations as R

from .lineage import checkpointed
from .pairs import ordered_pairs, support_closure, with_relations

SEED = 20260723
#: Quotas: requests in all, for each relation, scene, subject, and pair of categories.
QUOTAS = {"total": 60, "relation": 10, "scene": 60, "subject": 18, "pair": 12}


def first_true(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds; a null condition does not."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def support_edges(objects: DataFrame) -> DataFrame:
    return objects.filter("support_id IS NOT NULL").select("scene_id", F.col("object_id").alias("child"), F.col("support_id").alias("parent"))


def ancestors(edges: Column, child: Column) -> Column:
    """What holds a child up, directly or not, by its scene's array of struct(child, parent); a member of a cycle is among its own ancestors. As ``support_closure``, for one object."""
    above = lambda x: F.transform(F.filter(edges, lambda e: e["child"] == x), lambda e: e["parent"])
    follow = lambda found, _: F.array_union(found, F.flatten(F.transform(found, above)))
    first = F.array_distinct(above(child))
    return F.when(F.exists(edges, lambda e: e["child"] == child), F.aggregate(F.sequence(F.lit(1), F.size(edges)), first, follow)).otherwise(first)


def cyclic_objects(objects: DataFrame) -> DataFrame:
    """Objects that hold themselves up: (scene_id, object_id)."""
    return support_closure(support_edges(objects)).filter("child = ancestor").select("scene_id", F.col("child").alias("object_id"))


def without_cyclic_support(objects: DataFrame) -> DataFrame:
    """The objects, the support of every member of a cycle made null."""
    return objects.join(cyclic_objects(objects).withColumn("cyclic", F.lit(True)), ["scene_id", "object_id"], "left").withColumn("support_id", F.when(F.col("cyclic").isNull(), F.col("support_id"))).drop("cyclic")


def object_inventory(objects: DataFrame) -> DataFrame:
    """A row an object: support_kind, subject_state, reference_eligible, reason."""
    # a scene's edges go along with each of its objects, so that nothing is joined and nothing leaves its scene
    scene = Window.partitionBy("scene_id")
    edge = F.struct(F.col("object_id").alias("child"), F.col("support_id").alias("parent"))
    d = objects.withColumns({"edges": F.collect_list(F.when(F.col("support_id").isNotNull(), edge)).over(scene), "categories": F.collect_list(F.struct("category")).over(scene)})
    # and so do its categories: a window of each category would sort all objects once more
    d = d.withColumn("unique_category", F.size(F.filter("categories", lambda e: e["category"].eqNullSafe(F.col("category")))) == 1).drop("categories")
    d = d.withColumn("ancestors", ancestors(F.col("edges"), F.col("object_id")))
    # a scene without a number is no scene, and its objects hold none of each other
    known = F.col("scene_id").isNotNull()
    d = d.withColumns({"has_child": known & F.exists("edges", lambda e: e["parent"] == F.col("object_id")), "cyclic": known & F.array_contains("ancestors", F.col("object_id"))})
    d = d.withColumn("support_kind", first_true((F.col("cyclic"), "CYCLIC"), (F.col("support_id").isNull(), "FLOOR"), otherwise="RECEPTACLE"))
    state = first_true(
        (~F.col("movable"), "REJECTED_NOT_MOVABLE"), (F.col("pinned"), "REJECTED_PINNED"), (F.col("has_child"), "REJECTED_HAS_DEPENDENT_CHILD"),
        (F.col("support_kind") == "CYCLIC", "REJECTED_UNKNOWN_SUPPORT"), (F.col("support_kind") == "RECEPTACLE", "ELIGIBLE_RECEPTACLE_DOMAIN"), otherwise="ELIGIBLE_FLOOR_INNER_DOMAIN",
    )
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in {"REJECTED_NOT_MOVABLE": "object:not_movable", "REJECTED_PINNED": "object:pinned", "REJECTED_HAS_DEPENDENT_CHILD": "object:has_dependent_child", "REJECTED_UNKNOWN_SUPPORT": "object:support_cyclic"}.items() for x in kv]), F.col("subject_state"))
    view = R.is_visible(F.col("visible_fraction"), F.col("image_area_fraction"), F.col("truncated_fraction"))
    d = d.withColumn("subject_state", state).withColumn("reason", reason)
    return d.withColumns({"qualifying_view": view, "reference_eligible": F.col("unique_category") & (F.least("ex", "ey", "ez") > 0)}).drop("has_child", "cyclic", "edges")


def candidate_inventory(objects: DataFrame) -> DataFrame:
    """A row a (subject, reference, relation): state and reason. ``PENDING`` ones await selection."""
    inventory = object_inventory(objects)
    names = ("category", "x", "y", "ex", "ey", "cx", "depth", "visible_fraction", "image_area_fraction", "truncated_fraction", "subject_state", "reference_eligible", "unique_category", "support_id", "support_kind", "split", "ancestors")
    pairs = with_relations(ordered_pairs(inventory, names))
    pairs = pairs.withColumn("depends", F.array_contains("s_ancestors", F.col("r_object_id"))).drop("s_ancestors", "r_ancestors")
    d = pairs.withColumn("relation", F.explode(F.array(*[F.lit(r) for r in R.RELATIONS])))
    axis = R.lookup(R.AXIS, F.col("relation"))
    dead = F.when(axis == "horizontal", F.abs("dx") < 32.0 - R.TOLERANCE).when(axis == "depth", F.abs("dd") < R.DEPTH_M - R.TOLERANCE).otherwise((F.col("gap") > R.NEAR_M) & (F.col("gap") < R.FAR_M))
    state = first_true(
        (~F.col("s_unique_category"), "REJECTED_AMBIGUOUS_SUBJECT"), (~F.col("r_unique_category"), "REJECTED_AMBIGUOUS_REFERENCE"),
        (F.col("s_subject_state").startswith("REJECTED"), "REJECTED_SUBJECT"), (~F.col("r_reference_eligible"), "REJECTED_REFERENCE"), (F.col("depends"), "REJECTED_DEPENDENCY"),
        (~F.col("seen"), "REJECTED_NOT_VISIBLE"), (dead, "REJECTED_AMBIGUOUS"), (~F.array_contains("labels", F.col("relation")), "REJECTED_NOT_OBSERVED"), otherwise="PENDING",
    )
    return d.withColumn("state", state)


def candidate_key() -> Column:
    return F.concat_ws(":", "scene_id", "s_object_id", "r_object_id", "relation")


def seeded_order(candidates: DataFrame, seed: int = SEED) -> DataFrame:
    """Pending candidates ranked within relation, categories, support kind and scene by a seeded digest, and the groups within a relation by theirs."""
    group = ["relation", "s_category", "r_category", "s_support_kind", "scene_id"]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), candidate_key()).cast("binary"), 256)
    d = candidates.filter("state = 'PENDING'").withColumn("digest", digest).withColumn("group_digest", F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(g).cast("string") for g in group]).cast("binary"), 256))
    return d.withColumn("round", F.row_number().over(Window.partitionBy(*group).orderBy("digest", "s_object_id", "r_object_id")).cast("long"))


def _select(quotas: dict[str, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[tuple, int] = {}
        chosen = []
        for i, r in enumerate(pdf.sort_values(VISIT, kind="stable", ignore_index=True).itertuples(index=False)):
            keys = {"total": ("t",), "relation": ("r", r.relation), "scene": ("s", r.scene_id), "subject": ("o", r.scene_id, r.s_object_id), "pair": ("p", r.s_category, r.r_category)}
            if all(seen.get(k, 0) < quotas[q] for q, k in keys.items()):
                chosen.append((len(chosen), r.relation, r.scene_id, r.s_object_id, r.r_object_id, r.s_category, r.r_category))
                for k in keys.values():
                    seen[k] = seen.get(k, 0) + 1
        return pd.DataFrame(chosen, columns=["selection_index", "relation", "scene_id", "s_object_id", "r_object_id", "s_category", "r_category"])

    return run


VISIT = ["relation", "round", "group_digest", "digest"]
#: Candidates of a relation that selection visits at first; Spark takes so many of each task before they are shuffled.
LOOK = 1000


def within_reach(ordered: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Without the candidates that selection is sure to pass over, which leaves a number that the quotas alone bound.

    A quota that is met stays met, and at most ``total`` candidates are taken, so only so many scenes, subjects and pairs
    of categories can ever meet theirs. Of those that share keys, one can differ from the earlier ones only by the keys
    that are not shared; counting what those can turn away bounds how many of each group need a look.
    """
    total = min(quotas["total"], quotas["relation"] * len(R.RELATIONS))
    full = {k: total // quotas[k] for k in ("pair", "subject", "scene")}
    pair_subject = quotas["pair"]
    pair_scene = quotas["pair"] + full["subject"] * pair_subject
    pair = quotas["pair"] + full["subject"] * pair_subject + full["scene"] * pair_scene
    subject = quotas["subject"] + full["pair"] * pair_subject
    scene = quotas["scene"] + full["pair"] * pair_scene + full["subject"] * subject
    relation = quotas["relation"] + full["pair"] * pair + full["subject"] * subject + full["scene"] * scene
    of_pair, of_subject = ["s_category", "r_category"], ["scene_id", "s_object_id"]
    for keys, most in ((of_pair + of_subject, pair_subject), ([*of_pair, "scene_id"], pair_scene), (of_pair, pair), (of_subject, subject), (["scene_id"], scene), ([], relation)):
        rank = F.row_number().over(Window.partitionBy("relation", *keys).orderBy(*VISIT[1:]))
        ordered = ordered.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return ordered


def _settled(first: DataFrame, chosen: DataFrame, quotas: dict[str, int]) -> bool:
    """Whether the candidates after the ``first`` of each relation are sure to be turned down: none are left, or the relation's quota is met, or with those before it the one in all."""
    taken = {r.relation: r.n for r in chosen.groupBy("relation").agg(F.count("*").alias("n")).collect()}
    before = 0
    for relation, n in sorted((r.relation, r.n) for r in first.groupBy("relation").agg(F.count("*").alias("n")).collect()):
        before += taken.get(relation, 0)
        if n >= LOOK and taken.get(relation, 0) < quotas["relation"] and before < quotas["total"]:
            return False
    return True


def select_with_quotas(candidates: DataFrame, quotas: dict[str, int] = QUOTAS, seed: int = SEED) -> DataFrame:
    """Round-robin selection: relations in the order of their names, one of each group in a round, each taken if no quota is met.

    What is taken depends on all that was taken before, so candidates are visited in one task: the first ``LOOK`` of each
    relation, of which each task sends no more than that. A quota that is met stays met; where those do not meet their
    relation's, all candidates within reach are visited, whose number depends on the quotas alone. A row each that is
    taken, with its selection_index.
    """
    ordered = seeded_order(candidates, seed).select(*VISIT, "scene_id", "s_object_id", "r_object_id", "s_category", "r_category")
    schema = "selection_index long, relation string, scene_id long, s_object_id long, r_object_id long, s_category string, r_category string"
    rank = F.row_number().over(Window.partitionBy("relation").orderBy(*VISIT[1:]))
    first = checkpointed(ordered.withColumn("_rank", rank).filter(F.col("_rank") <= LOOK).drop("_rank"))
    chosen = checkpointed(first.groupBy().applyInPandas(_select(quotas), schema))
    return chosen if _settled(first, chosen, quotas) else within_reach(ordered, quotas).groupBy().applyInPandas(_select(quotas), schema)


def cap_prefix(sources: DataFrame, cap: int) -> DataFrame:
    """Sources (source_index, n) accepted in order while the running number of their candidates stays within the cap; a rejected one uses nothing up."""
    step = lambda acc, x: F.when(acc["used"] + x["n"] <= cap, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["ok"], F.array(x["source_index"])).alias("ok"))).otherwise(acc)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ok"))
    ok = sources.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("source_index", "n"))).alias("l")).select("shard", F.aggregate("l", start, step)["ok"].alias("ok"))
    return sources.join(ok, "shard").withColumn("accepted", F.array_contains("ok", F.col("source_index"))).drop("ok")


def _rejections(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    inventory, candidates = object_inventory(objects), candidate_inventory(objects)
    a = inventory.filter("subject_state LIKE 'REJECTED%'").select(F.lit("object_subject").alias("stage"), "scene_id", F.col("reason"))
    b = inventory.filter("NOT reference_eligible").select(F.lit("object_reference").alias("stage"), "scene_id", F.lit("object:reference_ineligible").alias("reason"))
    c = candidates.filter("state LIKE 'REJECTED%'").select(F.lit("candidate").alias("stage"), "scene_id", F.concat(F.lit("candidate:"), F.lower(F.substring("state", 10, 64))).alias("reason"))
    return a, b, c


def rejections(objects: DataFrame) -> DataFrame:
    """All that was turned down, by stage: object_subject, object_reference, candidate."""
    return reduce(DataFrame.unionByName, _rejections(objects))


def rejection_counts(objects: DataFrame) -> DataFrame:
    """How many rejections, and in how many scenes, by stage and reason. Each stage is counted by scene, where it is, before stages meet."""
    by_scene = [d.groupBy("scene_id", "stage", "reason").agg(F.count("*").alias("here")) for d in _rejections(objects)]
    return reduce(DataFrame.unionByName, by_scene).groupBy("stage", "reason").agg(F.sum("here").alias("n"), F.count("scene_id").alias("scenes"))


def summary(candidates: DataFrame) -> DataFrame:
    """Counts by state, by relation and in all: by scene first, where its candidates are, so that no scene is counted twice and none has to be told apart later."""
    scene = candidates.groupBy("scene_id", "state", "relation").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    sets = F.array(*[F.struct(a.alias("a"), b.alias("b"), F.lit(g).alias("g")) for g, (a, b) in enumerate(((F.col("state"), none), (none, F.col("relation")), (none, none)))])
    scene = scene.withColumn("s", F.explode(sets)).groupBy("scene_id", F.col("s.a").alias("state"), F.col("s.b").alias("relation"), F.col("s.g").alias("g")).agg(F.sum("n").alias("n"))
    return scene.groupBy("state", "relation", "g").agg(F.sum("n").alias("candidates"), F.count("scene_id").alias("scenes")).drop("g")
