"""Secret scan with corpus-wide ownership frequency, by built-in functions only.

Candidates are found in every whole text: three base kinds (assign, access, hex) and tokens, long runs of key
characters that mix letters and digits. Each candidate's value is hashed; over the whole corpus the distinct owners
and repositories of each hash are counted. Values that many owners hold are copied examples; a value that few owners
hold looks live. Live tokens that no base span covers are added as spans of the kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value that more owners than this hold is a copied example.
MAX_OWNERS = 1


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Matches in order as (start, rank of kind, end, kind, value); code points, end exclusive. The pieces between the matches give the places."""
    rank = KINDS.index(kind)
    parts = F.split(text, pattern, -1)
    found = F.arrays_zip(F.transform(parts, lambda p: F.length(p)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    found = F.filter(found, lambda x: x["hit"].isNotNull())
    span = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(found, begin, step, lambda acc: acc["out"])


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row a document: id, base (array of base spans), owned (array of added spans), n_live, n_copied.

    A null text is empty and has no spans; null owners or repositories count as one owner or repository each.
    Rows that repeat id and text have the same spans. An empty table gives no rows. Only candidates and their
    hashes are shuffled, combined by owner and repository in each task first.
    """
    spark = docs.sparkSession
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]))
    some = F.col("text").rlike(rf"{ASSIGN}|AKIA[A-Z0-9]{{16}}|{HEX}|{TOKEN}")
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), owner.alias("owner"), repo.alias("repo")).withColumn("some", some)
    t = F.col("text")
    assign = F.filter(_spans(t, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(_spans(t, "access", ACCESS), lambda s: F.length(s["value"]) >= 20)
    base = F.array_sort(F.concat(assign, access, _spans(t, "hex", HEX)))
    token = F.filter(_spans(t, "owned", TOKEN), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    d = d.select("id", "owner", "repo", F.when(F.col("some"), F.md5(t.cast("binary"))).otherwise("").alias("text_key"), F.when(F.col("some"), base).otherwise(none).alias("base"), F.when(F.col("some"), token).otherwise(none).alias("token"))
    free = F.filter("token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    d = cut(d.withColumn("token", F.when(F.size("token") > 0, free).otherwise(F.col("token"))), "secret-spans")
    spans = d.select("id", "text_key", "owner", "repo", F.explode(F.concat("base", "token")).alias("span")).withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    held = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repos"))
    judged = spans.join(held, "hash").withColumn("live", F.col("owners") <= max_owners)
    key = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id_key"), "text_key"]
    # an added span matters only where it is live; the sets make rows that repeat id and text one
    by_doc = judged.groupBy(*key).agg(
        F.collect_set(F.when(F.col("live") & (F.col("span.kind") == "owned"), F.col("span"))).alias("owned"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("span")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("live"), F.col("span")))).cast("long").alias("n_copied"),
    )
    out = d.withColumn("id_key", key[0]).join(by_doc, ["id_key", "text_key"], "left")
    return out.select("id", "base", F.coalesce("owned", none).alias("owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "owned"))).alias("spans"), "n_live", "n_copied",
    )


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """A list of (start, rank, end, kind, value) in DuckDB; ``keep`` filters by hit ``h`` and value ``v``."""
    p, rank = pattern.replace("'", "''"), KINDS.index(kind)
    value = f"regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0})"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, '{p}')) + 1), lambda i: {{
        'start': coalesce(list_sum(list_transform(regexp_split_to_array(text, '{p}')[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i - 1], lambda x: length(x))), 0)::BIGINT,
        'rank': {rank}, 'size': length(regexp_extract_all(text, '{p}')[i]), 'kind': '{kind}', 'value': {value}[i]}}), lambda s: {keep})"""


def op9_sql() -> str:
    told = "array_to_string(list_transform({0}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size)), ',')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
    s AS (SELECT doc_id, owner,
        list_sort({_sql_spans("assign", ASSIGN, "length(s.value) >= 6")} || {_sql_spans("access", ACCESS, "length(s.value) >= 20")} || {_sql_spans("hex", HEX, "true")}) AS base,
        {_sql_spans("owned", TOKEN, "regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]')")} AS token FROM d),
    f AS (SELECT doc_id, owner, base, list_filter(token, lambda s: len(list_filter(base, lambda b: b.start < s.start + s.size AND s.start < b.start + b.size)) = 0) AS token FROM s),
    held AS (SELECT value, count(DISTINCT owner) AS owners FROM (SELECT owner, unnest(base || token).value AS value FROM f) GROUP BY value),
    live AS (SELECT list(value) AS values FROM held WHERE owners <= {MAX_OWNERS}),
    m AS (SELECT f.*, list_filter(base || token, lambda s: list_contains(coalesce(live.values, []), s.value)) AS alive FROM f, live)
    SELECT doc_id, len(list_filter(base, lambda s: s.kind = 'assign')) AS n_assign, len(list_filter(base, lambda s: s.kind = 'access')) AS n_access, len(list_filter(base, lambda s: s.kind = 'hex')) AS n_hex,
        sha256({told.format("base")}) AS base_sha256, {told.format("list_sort(base || list_filter(alive, lambda s: s.kind = 'owned'))")} AS spans,
        len(alive)::BIGINT AS n_live, (len(base) + len(token) - len(alive))::BIGINT AS n_copied
    FROM m
    """
