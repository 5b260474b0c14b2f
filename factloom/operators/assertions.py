"""What must hold, as rows of refusals and as jobs that stop: nothing is asked of the driver beforehand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boundary, posture

REFUSAL = ["tenant_id", "code", "detail"]


def required(df: DataFrame, refusals: DataFrame) -> DataFrame:
    """``df``, from a job that fails with code and detail of a refusal if there is any.

    Refusals are counted, and each count raises where it is found, in whichever task; none is gathered. The message needs
    the count, so the optimizer cannot raise below the joins and filters that make a row a refusal. Without refusals
    the rows are those of ``df``.
    """
    counted = refusals.groupBy(*REFUSAL).agg(F.count("*").alias("times"))
    stop = F.raise_error(F.concat_ws(" ", *[F.col(c) for c in REFUSAL], F.concat(F.lit("x"), F.col("times").cast("string"))))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.unionByName(counted.where(stop.isNull()).select(*nothing))


def _refused(df: DataFrame, code: str | Column, detail: Column) -> DataFrame:
    return df.select("tenant_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), detail.cast("string").alias("detail"))


def not_exactly_one(df: DataFrame, by: list[str], expected: DataFrame, code: str) -> DataFrame:
    """Refusals of the groups of ``expected`` (columns ``by``, tenant_id among them) that have no row in ``df``, or several."""
    seen = df.groupBy(*by).agg(F.count("*").alias("n"))
    wrong = expected.select(*by).distinct().join(seen, by, "left").where(F.coalesce("n", F.lit(0)) != 1)
    return _refused(wrong, code, F.concat_ws("|", *by))


def report_refusals(positions: DataFrame, engagements: DataFrame, facts: DataFrame, folded: DataFrame, current: str) -> DataFrame:
    """Why a tenant gets no memory report: (tenant_id, code, detail), no row if it gets one.

    positions: tenant_id, source_stream_id, last_data_sequence, what is asked. engagements: with finalized limits
    (:func:`factloom.operators.ingest.finalize`). UNKNOWN_STREAM, NOT_FINALIZED, WRONG_POSITION and REPEATED_STREAM are of the
    boundary; NO_CURRENT_ENGAGEMENT if it has no stream of ``current``; UNREPRESENTED_DETECTION if an attempt detected
    what no visible finding stands for; REPEATED_FINDING if a finding would stand twice in the report.
    """
    guarded = boundary.guard(positions, engagements).where("boundary_error is not null")
    own = engagements.where(F.col("engagement_id") == current).select("tenant_id", "source_stream_id")
    asked = positions.select("tenant_id", "source_stream_id").distinct()
    without = asked.select("tenant_id").distinct().join(asked.join(own, ["tenant_id", "source_stream_id"]).select("tenant_id"), "tenant_id", "left_anti")
    twice = folded.groupBy(*posture.FINDING).agg(F.count("*").alias("n")).where("n > 1")
    parts = [
        _refused(guarded, F.col("boundary_error"), F.col("source_stream_id")),
        _refused(boundary.repeated_streams(positions), "REPEATED_STREAM", F.col("source_stream_id")),
        _refused(without, "NO_CURRENT_ENGAGEMENT", F.lit(current)),
        _refused(posture.detected_unrepresented(facts), "UNREPRESENTED_DETECTION", F.col("source_event_id")),
        _refused(twice, "REPEATED_FINDING", F.concat_ws("|", *posture.FINDING)),
    ]
    return reduce(DataFrame.unionByName, parts)


def lost_facts(facts: DataFrame, joined: DataFrame) -> DataFrame:
    """Refusals of facts that a join by keys has lost or doubled."""
    keys = ["tenant_id", "source_event_id", "fact_kind"]
    return not_exactly_one(joined, keys, facts, "LOST_OR_DOUBLED_FACT")
