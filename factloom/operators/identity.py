"""Assets, observations, findings and their baselines, by natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import stable_id


ASSET = ["tenant_id", "cluster_id", "resource_kind", "resource_uid"]


def assets(events: DataFrame) -> DataFrame:
    """Every authoritative deployment that any event names, with an id that is a function of its key."""
    named = events.where(F.col("resource_uid").isNotNull()).select(*ASSET).distinct()
    return named.withColumn("canonical_asset_id", stable_id(F.col("tenant_id"), F.col("cluster_id"), F.col("resource_kind"), F.col("resource_uid")))


def new_assets(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The assets that events name and ``stored`` has not: insert if absent."""
    return assets(events).join(stored.select(*ASSET), ASSET, "left_anti")


def observations(observed: DataFrame) -> DataFrame:
    """Adds outcome and basis: RESOLVED with a uid; else AMBIGUOUS if an earlier resolved one of the same tenant, cluster
    and kind has the same dns or any equal label; else REJECTED.

    observed: tenant_id, cluster_id, resource_kind, source_event_id, resource_uid, dns, labels (map, may be null), arrival.
    The earliest resolved arrival of each dns and of each label pair is an aggregate; no observation is compared with
    another.
    """
    scope = ["tenant_id", "cluster_id", "resource_kind"]
    resolved = observed.where("resource_uid is not null")
    by_dns = resolved.where("dns is not null").groupBy(*scope, "dns").agg(F.min("arrival").alias("dns_from"))
    pairs = lambda df, *names: df.select(*scope, *names, F.explode("labels").alias("label", "value"))
    by_label = pairs(resolved, "arrival").groupBy(*scope, "label", "value").agg(F.min("arrival").alias("label_from"))
    loose = pairs(observed.where("resource_uid is null"), "source_event_id", "arrival").join(by_label, [*scope, "label", "value"])
    by_event = loose.groupBy("tenant_id", "source_event_id", "arrival").agg(F.min("label_from").alias("label_from"))
    seen = observed.join(by_dns, [*scope, "dns"], "left").join(by_event, ["tenant_id", "source_event_id", "arrival"], "left")
    weak = F.coalesce(F.col("dns_from") < F.col("arrival"), F.lit(False)) | F.coalesce(F.col("label_from") < F.col("arrival"), F.lit(False))
    outcome = F.when(F.col("resource_uid").isNotNull(), "RESOLVED").when(weak, "AMBIGUOUS").otherwise("REJECTED")
    basis = F.when(F.col("outcome") == "RESOLVED", "AUTHORITATIVE_DEPLOYMENT_KEY").when(F.col("outcome") == "AMBIGUOUS", "WEAK_SIGNAL_COLLISION")
    return seen.withColumn("outcome", outcome).withColumn("basis", basis).drop("dns_from", "label_from")


FINDING = [*ASSET, "vuln_class", "location"]
BASELINE = ["verification_key", "check_version", "relevant_context_hash", "compatibility_policy_version"]


def baselines(occurrences: DataFrame) -> DataFrame:
    """One row for each finding: the baseline of its first arrival and how many occurrences it has."""
    first = F.min_by(F.struct(*BASELINE, "source_event_id"), "arrival")
    return occurrences.groupBy(*FINDING).agg(first.alias("b"), F.count("*").alias("n_occurrences")).select(*FINDING, *[f"b.{c}" for c in BASELINE], F.col("b.source_event_id").alias("first_event_id"), "n_occurrences")


def baseline_conflicts(occurrences: DataFrame) -> DataFrame:
    """Occurrences whose baseline differs from that of their finding's first arrival."""
    w = Window.partitionBy(*FINDING).orderBy("arrival")
    marked = occurrences.withColumn("b0", F.first(F.struct(*BASELINE)).over(w))
    return marked.where(F.struct(*BASELINE) != F.col("b0")).drop("b0")


def finding_decisions(occurrences: DataFrame) -> DataFrame:
    """Adds finding_id and reject_reason: FINDING_BASELINE_CONFLICT where the baseline is not that of the first arrival."""
    w = Window.partitionBy(*FINDING).orderBy("arrival")
    same = F.struct(*BASELINE).eqNullSafe(F.first(F.struct(*BASELINE)).over(w))
    return occurrences.withColumn("finding_id", stable_id(*[F.col(c) for c in FINDING])).withColumn("reject_reason", F.when(~same, "FINDING_BASELINE_CONFLICT"))


def attempts(events: DataFrame) -> DataFrame:
    """What is recorded of attempts: their asset by its natural key and the coverage fields; they never make findings."""
    asset = stable_id(*[F.col(c) for c in ASSET]).alias("canonical_asset_id")
    return events.where("event_type = 'test_attempt'").select("tenant_id", "source_event_id", asset, *BASELINE, "execution_status", "result")
