"""Rules of an experiment's bundle: its events and its runner's manifest, as sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the runner that no event may carry.
RUNNER_TOKEN = "F-(STILL|FIXED|REGRESS|UNTESTED|INCONCLUSIVE|NEW)|T-[ABC]"


def _found(df: DataFrame, rule: str, item) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def _twice(df: DataFrame, rule: str, item: str) -> DataFrame:
    return _found(df.groupBy(item).agg(F.count("*").alias("n")).where("n > 1"), rule, F.col(item))


def event_violations(events: DataFrame) -> DataFrame:
    """(rule, item) over events with source_event_id, source_stream_id, source_sequence and payload, its canonical JSON."""
    place = events.withColumn("place", F.concat_ws("#", "source_stream_id", "source_sequence"))
    leak = events.where(F.col("payload").rlike(RUNNER_TOKEN))
    return reduce(DataFrame.unionByName, [_twice(events, "DUPLICATE_EVENT", "source_event_id"), _twice(place, "DUPLICATE_POSITION", "place"), _found(leak, "RUNNER_TOKEN", F.col("source_event_id"))])


def manifest_violations(manifest: DataFrame, events: DataFrame, expected: list[str]) -> DataFrame:
    """(rule, item) over manifests (:func:`factloom.sources.bundle.read_manifest`) against the events they name.

    expected: the candidates that a manifest must have, no more and no fewer. A null id is an unknown event.
    """
    candidates = manifest.select(F.explode("candidates").alias("c")).select("c.*")
    actions = candidates.select("candidate_id", F.explode("action_event_ids").alias("id"))
    background = manifest.select(F.explode("background").alias("b")).select(F.col("b.event_id").alias("id"))
    known = events.select(F.col("source_event_id").alias("id")).distinct()
    wanted = manifest.select(F.explode(F.array(*[F.lit(e) for e in expected])).alias("candidate_id")).distinct()
    given = candidates.select("candidate_id").distinct()
    unknown = lambda df, rule: _found(df.join(known, "id", "left_anti"), rule, F.coalesce("id", F.lit("-")))
    parts = [
        _found(manifest.where(F.coalesce(F.col("action_budget") <= 0, F.lit(True))), "BUDGET", F.col("action_budget")),
        _twice(candidates, "DUPLICATE_CANDIDATE", "candidate_id"),
        _found(given.exceptAll(wanted), "UNEXPECTED_CANDIDATE", F.col("candidate_id")),
        _found(wanted.exceptAll(given), "MISSING_CANDIDATE", F.col("candidate_id")),
        _found(candidates.where("frozen_outcome.execution_status is null"), "NO_OUTCOME", F.col("candidate_id")),
        _found(candidates.where("coalesce(size(action_event_ids), 0) <= 0"), "NO_ACTIONS", F.col("candidate_id")),
        unknown(actions.select("id"), "UNKNOWN_ACTION"),
        _twice(actions, "REUSED_ACTION", "id"),
        unknown(background, "UNKNOWN_BACKGROUND"),
        _twice(background, "DUPLICATE_BACKGROUND", "id"),
        _found(background.distinct().join(actions.select("id").distinct(), "id", "left_semi"), "ACTION_AND_BACKGROUND", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, parts)
