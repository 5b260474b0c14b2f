"""JSON event sets and runner manifests, and a writer that shows a set of tables only when all are complete."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import Rejected, decode_events, is_blank, members

MANIFEST = "action_budget int, candidates array<struct<candidate_id:string,scenario_label:string,target:struct<cluster_id:string,resource_kind:string,resource_uid:string>,verification_key:string,action_event_ids:array<string>,frozen_outcome:struct<execution_status:string,result:string>>>, background array<struct<event_id:string,scenario_label:string>>"


EVENT_SET = "tenant_id string, engagement_id string, arrival long, json string, file_error string"


def _cut_event_set(text: str) -> list[dict]:
    """The events of one file as they stand there, byte for byte, or one row that says why the file is refused."""
    try:
        top = {k: (begin, end) for k, begin, end in members(text, 0, len(text))}
        if set(top) != {"trusted_context", "events"} or text[top["events"][0]] != "[":
            raise Rejected("EVENT_SET")
        context = [(k, json.loads(text[begin:end])) for k, begin, end in members(text, *top["trusted_context"])]
        if sorted(k or "" for k, _ in context) != ["engagement_id", "tenant_id"] or any(not isinstance(v, str) or is_blank(v) for _, v in context):
            raise Rejected("TRUSTED_CONTEXT")
        return [dict(context) | {"arrival": i, "json": text[begin:end]} for i, (_, begin, end) in enumerate(members(text, *top["events"]))]
    except Rejected as e:
        return [{"file_error": f"FILE_{e}"}]
    except ValueError:
        return [{"file_error": "FILE_MALFORMED"}]


def read_event_set(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event of the event-set files under ``path``, decoded strictly, with the trusted context stamped.

    A file is cut into its events without being parsed, so numbers keep their digits, and a bad event is one row with its
    reject_reason. A file that is no event set is one row whose reject_reason begins with FILE_. A file is read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EVENT_SET.split(", ")]
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = _cut_event_set(text)
                for s in range(0, len(rows), 1000):
                    part = rows[s : s + 1000]
                    columns = [pa.array([r.get(n) for r in part], pa.int64() if n == "arrival" else pa.string()) for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), *columns], ["file", *names])

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = decode_events(text.mapInArrow(run, f"file string, {EVENT_SET}"))
    return found.withColumn("reject_reason", F.coalesce("file_error", "reject_reason")).drop("file_error")


# The members of a manifest and of its parts.
MANIFEST_FIELDS = {"": {"action_budget", "candidates", "background"}, "candidates": {"candidate_id", "scenario_label", "target", "verification_key", "action_event_ids", "frozen_outcome"}, "target": {"cluster_id", "resource_kind", "resource_uid"}, "frozen_outcome": {"execution_status", "result"}, "background": {"event_id", "scenario_label"}}


def _manifest_error(text: str) -> str | None:
    """Why a manifest is refused: bad JSON, a key that stands twice, or a member that it does not have."""

    def look(begin: int, end: int, part: str) -> None:
        found = members(text, begin, end)
        if text[begin:end].lstrip()[0] == "[":
            for _, b, e in found:
                if text[b] == "{":
                    look(b, e, part)
            return
        if part in MANIFEST_FIELDS and {k for k, _, _ in found} - MANIFEST_FIELDS[part]:
            raise Rejected("UNKNOWN_FIELD")
        for k, b, e in found:
            if text[b] in "{[":
                look(b, e, k or "")

    try:
        json.loads(text)
        look(0, len(text), "")
    except Rejected as e:
        return f"MANIFEST_{e}"
    except (ValueError, RecursionError):
        return "MANIFEST_MALFORMED"
    return None


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest: budget, candidates and background, or reject_reason and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = [_manifest_error(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], ["value", "reject_reason"])

    text = spark.read.text(path, wholetext=True).mapInArrow(run, "value string, reject_reason string")
    parsed = F.when(F.col("reject_reason").isNull(), F.from_json("value", MANIFEST))
    return text.select(parsed.alias("m"), "reject_reason").select("m.*", "reject_reason")


def planner_view(manifest: DataFrame) -> DataFrame:
    """What a planner may see of the candidates: no labels, no outcomes, no event ids."""
    return manifest.select("action_budget", F.explode("candidates").alias("c")).select("action_budget", "c.candidate_id", "c.target.cluster_id", "c.target.resource_kind", "c.target.resource_uid", "c.verification_key")


def write_all(tables: dict[str, DataFrame], root: str) -> str:
    """Writes a version with every table under ``root`` and then its marker; readers follow complete versions only."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    spark.createDataFrame([(sorted(tables),)], "tables array<string>").coalesce(1).write.json(f"{version}/_complete")
    return version


def read_all(spark: SparkSession, version: str) -> dict[str, DataFrame]:
    """The tables of a complete version; raises if its marker is missing."""
    names = spark.read.json(f"{version}/_complete").first()["tables"]
    return {n: spark.read.parquet(f"{version}/{n}") for n in names}
