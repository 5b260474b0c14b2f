"""Knowledge boundaries: the guard and the selection of visible facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_COLUMNS = ["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "occurred_at", "event_id", "cluster_id", "resource_kind", "resource_uid", "verification_key", "vuln_class", "location", "check_version", "relevant_context_hash", "compatibility_policy_version", "execution_status", "result"]


def guard(positions: DataFrame, engagements: DataFrame) -> DataFrame:
    """Adds boundary_error to each position: it must name a stream of the tenant and equal its finalized limit."""
    known = engagements.select("tenant_id", "source_stream_id", F.col("last_data_sequence").alias("limit"), F.lit(True).alias("known"))
    error = F.when(F.col("known").isNull(), "UNKNOWN_STREAM").when(F.col("limit").isNull(), "NOT_FINALIZED").when(F.col("limit") != F.col("last_data_sequence"), "WRONG_POSITION")
    return positions.join(known, ["tenant_id", "source_stream_id"], "left").withColumn("boundary_error", error).drop("limit", "known")


def select_facts(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Occurrences and attempts at or below the boundary; the position filters before anything is ordered by time.

    positions has a row for each stream of the boundary, far fewer than events; the optimizer broadcasts it while small.
    """
    facts = log.where("event_type <> 'asset_observation'").join(positions.select("tenant_id", "source_stream_id", "last_data_sequence"), ["tenant_id", "source_stream_id"])
    kind = F.when(F.col("event_type") == "finding_observation", "finding_occurrence").otherwise("test_attempt")
    return facts.where("source_sequence <= last_data_sequence").select(*FACT_COLUMNS, kind.alias("fact_kind"))


def guarded_facts(log: DataFrame, positions: DataFrame, engagements: DataFrame) -> DataFrame:
    """:func:`select_facts` behind :func:`guard`: a tenant with any position in error gets no facts at all."""
    bad = guard(positions, engagements).where("boundary_error is not null").select("tenant_id").distinct()
    return select_facts(log, positions.join(bad, "tenant_id", "left_anti"))


def boundary_rows(spark: SparkSession, positions: dict[str, int], tenant_id: str) -> DataFrame:
    """A boundary given as stream and limit pairs, as rows; a stream cannot be given twice, and limits are positive."""
    if not positions or any(n <= 0 or not s.strip() for s, n in positions.items()):
        raise ValueError("a boundary needs streams with positive limits")
    arrays = spark.createDataFrame([(tenant_id, list(positions), list(positions.values()))], "tenant_id string, s array<string>, n array<long>")
    return arrays.select("tenant_id", F.explode(F.arrays_zip("s", "n")).alias("p")).select("tenant_id", F.col("p.s").alias("source_stream_id"), F.col("p.n").alias("last_data_sequence"))


def repeated_streams(positions: DataFrame) -> DataFrame:
    """Streams that a boundary names more than once; a valid one has none."""
    return positions.groupBy("tenant_id", "source_stream_id").agg(F.count("*").alias("n")).where("n > 1")
