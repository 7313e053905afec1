"""The published dataset: records, report, manifest and checksums, written once, read back and derived anew."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import canonical_json_text

RECORD = "record_version int, request_id string, scene_id long, subject_id long, reference_id long, relation_before string, relation_after string, new_x double, new_y double, total double"
FILES = ("checksums.sha256", "manifest.json", "records.jsonl", "report.json")


class UnsupportedArtifactVersion(ValueError):
    """A dataset, record or report of another version; older ones are refused, not converted."""


@dataclass(frozen=True)
class DatasetManifest:
    manifest_version: int
    config_sha256: str
    record_count: int
    records_sha256: str
    report_sha256: str
    dataset_tree_sha256: str


@dataclass(frozen=True)
class GenerationReport:
    report_version: int
    frozen_requests: int
    planned_requests: int
    planning_rejected: int
    accepted_requests: int
    execution_rejected: int
    terminal_reasons: dict[str, int]

    def __post_init__(self) -> None:
        if self.frozen_requests != self.planned_requests + self.planning_rejected:
            raise ValueError("frozen requests must be the planned and the rejected ones")
        if self.planned_requests != self.accepted_requests + self.execution_rejected:
            raise ValueError("planned requests must be the accepted and the rejected ones")
        if sum(self.terminal_reasons.values()) != self.planning_rejected + self.execution_rejected:
            raise ValueError("every rejection must have one reason")


def terminal_reasons(outcomes: DataFrame) -> DataFrame:
    """Counts by reason of the outcomes (stage, accepted, reason) that were not accepted."""
    return outcomes.filter("NOT accepted").groupBy(F.concat_ws(":", "stage", "reason").alias("reason")).agg(F.count("*").alias("n"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of closed counts over outcomes: planning rejects some requests, execution some of the rest."""
    planned = F.col("stage") != "planning"
    return outcomes.agg(
        F.count("*").alias("frozen_requests"), F.count_if(planned).alias("planned_requests"), F.count_if(~planned).alias("planning_rejected"),
        F.count_if("accepted").alias("accepted_requests"), F.count_if(planned & ~F.col("accepted")).alias("execution_rejected"),
    )


def attempt_closure(planned: DataFrame, attempts: DataFrame) -> DataFrame:
    """Planned requests without an attempt, attempts without a request, and requests with several: all empty for a closed batch."""
    p = planned.select("request_id").withColumn("p", F.lit(True))
    a = attempts.groupBy("request_id").agg(F.count("*").alias("attempts"))
    return p.join(a, "request_id", "full_outer").select("request_id", F.when(F.col("p").isNull(), "unplanned").when(F.col("attempts").isNull(), "missing").when(F.col("attempts") > 1, "repeated").alias("finding")).filter("finding IS NOT NULL")


def missing_references(rows: DataFrame, column: str, known: DataFrame, key: str, kind: str) -> DataFrame:
    """Findings (kind, value) for values that no known row has."""
    return rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value")).distinct()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def _sha(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def _lines(records: DataFrame, path: Path) -> int:
    """Writes records as lines in order of their id, a block at a time; returns how many."""
    n = 0
    with path.open("w", encoding="utf-8", newline="\n") as out:
        for r in records.orderBy("request_id").toLocalIterator():
            out.write(canonical_json_text(r.asDict(recursive=True)) + "\n")
            n += 1
    return n


def tree_digest(config_sha256: str, records_sha256: str, assets: tuple[str, ...] = ()) -> str:
    return hashlib.sha256("\n".join([config_sha256, records_sha256, *sorted(assets)]).encode()).hexdigest()


def publish_dataset(records: DataFrame, outcomes: DataFrame, config_sha256: str, root: str | Path) -> DatasetManifest:
    """Writes the index beside its final name and renames it there; an existing dataset is never replaced."""
    root = Path(root)
    if root.exists() and any(root.iterdir()):
        raise FileExistsError(f"already published: {root}")
    staging = root.with_name(root.name + ".staging")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    try:
        n = _lines(records, staging / "records.jsonl")
        reasons = {r.reason: r.n for r in terminal_reasons(outcomes).collect()}
        told = GenerationReport(1, **report(outcomes).first().asDict(), terminal_reasons=reasons)
        if told.accepted_requests != n:
            raise ValueError("there must be a record for every accepted request")
        records_sha = _sha(staging / "records.jsonl")
        tree = tree_digest(config_sha256, records_sha)
        (staging / "report.json").write_text(canonical_json_text(told.__dict__ | {"dataset_tree_sha256": tree}) + "\n", "utf-8")
        manifest = DatasetManifest(1, config_sha256, n, records_sha, _sha(staging / "report.json"), tree)
        (staging / "manifest.json").write_text(canonical_json_text(manifest.__dict__) + "\n", "utf-8")
        names = [f for f in FILES if f != "checksums.sha256"]
        (staging / "checksums.sha256").write_text("".join(f"{_sha(staging / f)}  {f}\n" for f in names), "utf-8")
        if root.exists():
            root.rmdir()
        os.rename(staging, root)
        return manifest
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A checksum ledger as (sha256, name); lines that are malformed, out of order or repeated have ``fine`` false."""
    d = spark.read.text(path).select(F.regexp_extract("value", "^([0-9a-f]{64})  ", 1).alias("sha256"), F.regexp_extract("value", "^[0-9a-f]{64}  (.+)$", 1).alias("name"), F.monotonically_increasing_id().alias("line"))
    return d.withColumn("fine", (F.col("sha256") != "") & F.coalesce(F.lag("name").over(Window.partitionBy(F.lit(1)).orderBy("line")) < F.col("name"), F.lit(True))).drop("line")


def read_dataset_records(spark: SparkSession, root: str | Path) -> DataFrame:
    """The records in order; a repeated id, another version or a line that is not canonical fails the read."""
    lines = spark.read.text(str(Path(root) / "records.jsonl"))
    d = lines.select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    other = d.filter("record_version <> 1").limit(1).count()
    if other:
        raise UnsupportedArtifactVersion("records of another version")
    if d.groupBy("request_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a request has several records")
    return d.orderBy("request_id")


def verify_dataset(spark: SparkSession, root: str | Path, derive: DataFrame | None = None) -> DatasetManifest:
    """Checks the set of files, every checksum, the manifest and, if ``derive`` is given, that the records derived anew are the same."""
    root = Path(root)
    if (found := tuple(sorted(p.name for p in root.iterdir()))) != FILES:
        raise ValueError(f"the files must be {', '.join(FILES)}; they are {', '.join(found)}")
    values = json.loads((root / "manifest.json").read_text("utf-8"))
    if values.get("manifest_version") != 1:
        raise UnsupportedArtifactVersion(f"manifest version {values.get('manifest_version')}")
    manifest = DatasetManifest(**values)
    ledger = {r.name: r.sha256 for r in read_ledger(spark, str(root / "checksums.sha256")).collect() if r.fine}
    if ledger != {f: _sha(root / f) for f in FILES if f != "checksums.sha256"}:
        raise ValueError("a file is not what its checksum says")
    if manifest.records_sha256 != ledger["records.jsonl"] or manifest.report_sha256 != ledger["report.json"] or manifest.dataset_tree_sha256 != tree_digest(manifest.config_sha256, manifest.records_sha256):
        raise ValueError("the manifest does not fit its files")
    records = read_dataset_records(spark, root)
    if records.count() != manifest.record_count:
        raise ValueError("the number of records is not the manifest's")
    if derive is not None and differences(records, derive.select(records.columns)).limit(1).count():
        raise ValueError("the records derived anew differ")
    return manifest


def inspect_dataset(spark: SparkSession, root: str | Path) -> dict:
    """The number of records, and how many there are of each target relation."""
    counts = read_dataset_records(spark, root).groupBy("relation_after").count().collect()
    return {"record_count": sum(r["count"] for r in counts), "relation_after": {r.relation_after: r["count"] for r in sorted(counts)}}
