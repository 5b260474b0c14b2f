"""Coverage pairs, the posture fold in closed form, and the rules on detected attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import ASSET, BASELINE, FINDING

COVERAGE = [*ASSET, *BASELINE]
#: The version of the compatibility policy that both sides must have.
POLICY = 1
ORDER = ["occurred_at", "source_stream_id", "source_sequence", "source_event_id"]


def findings_of(facts: DataFrame) -> DataFrame:
    return facts.where("fact_kind = 'finding_occurrence'").select(*FINDING, *BASELINE).distinct()


def coverage_pairs(facts: DataFrame) -> DataFrame:
    """Each compatible (finding, attempt): an equi-join on tenant, asset and baseline, both of policy version 1."""
    attempts = facts.where(f"fact_kind = 'test_attempt' and compatibility_policy_version = {POLICY}").drop("vuln_class", "location")
    return attempts.join(findings_of(facts), COVERAGE)


def resolving(pairs: DataFrame) -> DataFrame:
    return pairs.where("execution_status = 'completed' and result = 'not_detected'")


def evidence(facts: DataFrame) -> DataFrame:
    """Occurrences (O) and compatible attempts (N negative, D detected, I incomplete) by finding."""
    kind = F.when(F.col("execution_status") != "completed", "I").when(F.col("result") == "not_detected", "N").otherwise("D")
    pairs = coverage_pairs(facts).withColumn("kind", kind)
    occurrences = facts.where("fact_kind = 'finding_occurrence'").withColumn("kind", F.lit("O"))
    columns = [*FINDING, "verification_key", "engagement_id", "source_event_id", "source_stream_id", "source_sequence", "occurred_at", "kind"]
    return occurrences.select(*columns).unionByName(pairs.select(*columns))


def fold(facts: DataFrame, current_engagement: str) -> DataFrame:
    """One row for each finding: classification, assessment, exposure. One exchange by finding, one sort, no Python."""
    w = Window.partitionBy(*FINDING).orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = evidence(facts).withColumn("c", F.col("engagement_id") == current_engagement)
    e = e.withColumn("seen", F.coalesce(F.max(F.col("kind") == "O").over(before), F.lit(False))).withColumn("prev", F.last(F.when(F.col("kind").isin("O", "N"), F.col("kind")), ignorenulls=True).over(before))
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    o, n, c = F.col("kind") == "O", F.col("kind") == "N", F.col("c")
    at = F.struct(*ORDER)
    decisive = F.col("kind").isin("O", "N")
    flags = e.groupBy(*FINDING).agg(
        F.min(F.when(o, F.col("verification_key"))).alias("verification_key"),
        any_(o & c & ~F.col("seen")).alias("new"),
        any_(o & c & F.col("seen") & (F.col("prev") == "N")).alias("regressed"),
        any_(n & c & F.col("seen")).alias("resolved"),
        any_(o & c & F.col("seen") & (F.col("prev") == "O")).alias("open"),
        any_((F.col("kind") == "I") & c).alias("inconclusive"),
        F.max_by("kind", F.when(decisive & c, at)).alias("last_current"),
        F.max_by("kind", F.when(decisive, at)).alias("last"),
        any_(decisive & c).alias("decided"),
    )
    classification = F.when(F.col("new"), "NEW").when(F.col("regressed"), "REGRESSED").when(F.col("resolved"), "VERIFIED_RESOLVED").when(F.col("open"), "STILL_OPEN").when(F.col("inconclusive"), "INCONCLUSIVE").otherwise("NOT_RETESTED")
    assessment = F.when(F.col("decided"), F.when(F.col("last_current") == "O", "DETECTED").otherwise("NOT_DETECTED")).when(F.col("inconclusive"), "INCONCLUSIVE").otherwise("NOT_RETESTED")
    exposure = F.when(F.col("last") == "O", "OPEN").otherwise("VERIFIED_RESOLVED")
    return flags.select(*FINDING, "verification_key", classification.alias("classification"), assessment.alias("assessment"), exposure.alias("exposure"))


def detected_without_occurrence(facts: DataFrame) -> DataFrame:
    """Completed detected attempts paired with a finding that has no occurrence in their engagement."""
    detected = coverage_pairs(facts).where("execution_status = 'completed' and result = 'detected'")
    there = facts.where("fact_kind = 'finding_occurrence'").select(*FINDING, "engagement_id").distinct()
    return detected.join(there, [*FINDING, "engagement_id"], "left_anti").select(*FINDING, "source_event_id")


def detected_unrepresented(facts: DataFrame) -> DataFrame:
    """Completed detected attempts that no visible finding covers."""
    detected = facts.where("fact_kind = 'test_attempt' and execution_status = 'completed' and result = 'detected'")
    return detected.join(findings_of(facts).where(F.col("compatibility_policy_version") == POLICY).select(*COVERAGE).distinct(), COVERAGE, "left_anti").select("tenant_id", "source_event_id")
