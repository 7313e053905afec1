"""URL filter: rules first, then gradient-boosted trees on lexical features of the URL.

The URLs that a rule judges are the labelled ones. Statistics of host suffixes are taken over all of them, for a
labelled URL over those of other folds; the trees are fitted with numpy on the driver, on at most ``TRAIN_ROWS`` of them, and then written out as SQL
expressions, so that all URLs are scored without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs that the trees are fitted on, in order of a hash of the URL.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK = 24, 3, 24, 0.3, 1.0
#: Parts of the labelled URLs, by a hash of the URL: the suffix statistics of one are taken over the others, so that no label is among its own features.
FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features by name; a null URL has those of an empty one."""
    url = F.coalesce(url, F.lit(""))
    size = F.length(url)
    chars = F.array_distinct(F.filter(F.split(host, ""), lambda c: c != ""))

    def part(c: Column) -> Column:
        share = (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host)
        return -share * F.log2(share)

    out = {
        "url_length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": F.size(F.split(host, r"\.")),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(size, F.lit(1)),
        "entropy": F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, x: a + x),
        "parameters": F.length(F.regexp_replace(url, "[^=]", "")),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
    }
    return {k: v.cast("double") for k, v in out.items()}


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list]:
    """Boosted trees under log loss: the first score, and trees as nested (feature, threshold, low, high) or a leaf's number."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    first = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    score, grown = np.full(len(y), first), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best, gain = None, 1e-6
        if left:
            for f, e in enumerate(edges):
                if len(e):
                    b = binned[f, rows]
                    gl, hl = (np.cumsum(np.bincount(b, w[rows], len(e) + 1))[:-1] for w in (g, h))
                    gains = gl**2 / (hl + SHRINK) + (gs - gl) ** 2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
                    if gains[k := int(gains.argmax())] > gain:
                        best, gain = (f, k), gains[k]
        if best is None:
            value = float(-RATE * gs / (hs + SHRINK))
            score[rows] += value
            return value
        f, k = best
        low = binned[f, rows] <= k
        return f, float(edges[f][k]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grown.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return first, grown


def tree_score(first: float, trees: list, names: list[str]) -> Column:
    """The sum of the trees as one expression."""

    def tell(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(F.col(names[t[0]]) <= t[1], tell(t[2])).otherwise(tell(t[3]))

    return sum((tell(t) for t in trees), F.lit(first))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row a row of ``df``: id, host, path, rule, verdict, score (the trees' probability of ``block``).

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees.
    Repeated rows are judged alike. Without labelled URLs all others are allowed; if all labels agree, they are
    the others' verdict too. An empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "told": verdict, "suffix": F.substring_index("host", ".", -1)})
    base = base.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    names = list(lexical(F.col("url"), F.col("host"), F.col("path")))
    block = (F.col("told") == "block").cast("double")
    base = base.withColumn("fold", F.when(F.col("told").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS))))
    held = base.filter("told IS NOT NULL").groupBy("suffix", "fold").agg(F.count("*").cast("double").alias("n"), F.sum(block).alias("blocked"))
    known = held.groupBy("suffix").agg(F.sum("n").alias("suffix_n"), F.sum("blocked").alias("suffix_blocked"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "blocked")))).alias("own"))
    full = base.join(known, "suffix", "left")
    left = lambda of, name: F.coalesce(of, F.lit(0.0)) - F.coalesce(F.element_at("own", F.col("fold"))[name], F.lit(0.0))
    full = full.withColumns({"suffix_n": left(F.col("suffix_n"), "n"), "suffix_blocked": left(F.col("suffix_blocked"), "blocked")})
    full = full.withColumns({"suffix_rows": F.log1p("suffix_n"), "suffix_rate": (F.col("suffix_blocked") + 0.5) / (F.col("suffix_n") + 1.0)})
    names += ["suffix_rows", "suffix_rate"]
    train = full.filter("told IS NOT NULL").withColumn("y", block).orderBy(F.xxhash64("url"), "id").limit(train_rows).select(*names, "y").toPandas()
    if len(train):
        x = train[names].to_numpy(float)
        score = tree_score(*grow_trees(x, train.y.to_numpy(float)), names)
    else:
        score = F.lit(-1.0)
    prob = 1 / (1 + F.exp(-score))
    return full.withColumn("score", prob).select("id", "host", "path", "rule", F.coalesce("told", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict, score."""
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
