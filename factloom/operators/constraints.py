"""The rules of the seven tables as data, and one pass over the tables that finds every violation.

Each row gives an entry for each row rule that it breaks and for each key that it owns or refers to. One aggregate by
(rule, key), with partial sums before the shuffle, tells doubled keys and keys that nobody owns; no table is read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import identity
from .journal import joined

# What each column of the tables may hold, and which columns are keys.
NONBLANK = {
    "engagements": ["tenant_id", "engagement_id", "source_stream_id"],
    "source_events": ["tenant_id", "engagement_id", "source_event_id", "source_stream_id"],
    "assets": ["tenant_id", "cluster_id", "resource_uid"],
    "asset_observations": ["tenant_id", "cluster_id"],
    "findings": ["tenant_id", "vuln_class", "normalized_location_signature", "verification_key", "check_version"],
    "finding_occurrences": ["tenant_id"],
    "test_attempts": ["tenant_id", "verification_key", "check_version"],
}
NULL_OR_NONBLANK = {"asset_observations": ["resource_uid", "pod_uid", "pod_name", "ip_address", "dns", "banner"]}
POSITIVE = {"source_events": ["source_sequence"]}
NULL_OR_POSITIVE = {"engagements": ["last_data_sequence"]}
HEX = {"source_events": ["canonical_source_hash"], "findings": ["relevant_context_hash"], "test_attempts": ["relevant_context_hash"]}
ONE = {"source_events": ["schema_version"], "asset_observations": ["resolution_policy_version"], "findings": ["match_key_version", "compatibility_policy_version"], "test_attempts": ["compatibility_policy_version"]}
VALUES = {
    "source_events": {"event_type": ["asset_observation", "finding_observation", "test_attempt", "engagement_completed"]},
    "assets": {"resource_kind": ["Deployment"]},
    "asset_observations": {"resource_kind": ["Deployment"]},
    "test_attempts": {"execution_status": ["completed", "failed", "blocked", "partial", "skipped"]},
}
NULL_OR_VALUES = {"test_attempts": {"result": ["detected", "not_detected", "inconclusive"]}}
SIGNALS = ["pod_uid", "pod_name", "ip_address", "dns", "banner"]
UNIQUE = [
    ("engagements", ["tenant_id", "engagement_id"]),
    ("engagements", ["source_stream_id"]),
    ("source_events", ["tenant_id", "source_event_id"]),
    ("source_events", ["tenant_id", "source_stream_id", "source_sequence"]),
    ("assets", ["tenant_id", "canonical_asset_id"]),
    ("assets", ["tenant_id", "cluster_id", "resource_kind", "resource_uid"]),
    ("asset_observations", ["tenant_id", "source_event_id"]),
    ("findings", ["tenant_id", "finding_id"]),
    ("findings", ["tenant_id", "canonical_asset_id", "vuln_class", "normalized_location_signature", "match_key_version"]),
    ("finding_occurrences", ["tenant_id", "source_event_id"]),
    ("test_attempts", ["tenant_id", "source_event_id"]),
]
#: Table, columns, the table that owns them. A reference with a null applies to nothing.
FOREIGN = [
    ("source_events", ["tenant_id", "engagement_id", "source_stream_id"], "engagements"),
    ("asset_observations", ["tenant_id", "source_event_id"], "source_events"),
    ("asset_observations", ["tenant_id", "canonical_asset_id", "cluster_id", "resource_kind", "resource_uid"], "assets"),
    ("findings", ["tenant_id", "canonical_asset_id"], "assets"),
    ("finding_occurrences", ["tenant_id", "source_event_id"], "source_events"),
    ("finding_occurrences", ["tenant_id", "finding_id"], "findings"),
    ("test_attempts", ["tenant_id", "source_event_id"], "source_events"),
    ("test_attempts", ["tenant_id", "canonical_asset_id"], "assets"),
]
TABLES = list(NONBLANK)
MARKER = "source_events one marker"


def row_rules(table: str) -> dict[str, Column]:
    """Rules of single rows by name, as what must be true; null is false."""
    c, found = F.col, {}
    found |= {f"{n} nonblank": c(n).rlike(r"\S") for n in NONBLANK[table]}
    found |= {f"{n} null or nonblank": c(n).isNull() | c(n).rlike(r"\S") for n in NULL_OR_NONBLANK.get(table, [])}
    found |= {f"{n} positive": c(n) > 0 for n in POSITIVE.get(table, [])}
    found |= {f"{n} null or positive": c(n).isNull() | (c(n) > 0) for n in NULL_OR_POSITIVE.get(table, [])}
    found |= {f"{n} hex": c(n).rlike("^[0-9a-f]{64}$") & ~c(n).contains("\n") for n in HEX.get(table, [])}
    found |= {f"{n} is 1": c(n) == 1 for n in ONE.get(table, [])}
    found |= {f"{n} listed": c(n).isin(v) for n, v in VALUES.get(table, {}).items()}
    found |= {f"{n} null or listed": c(n).isNull() | c(n).isin(v) for n, v in NULL_OR_VALUES.get(table, {}).items()}
    if table == "test_attempts":
        found["outcome pairing"] = ((c("execution_status") == "completed") & c("result").isNotNull() & c("result").isin("detected", "not_detected")) | ((c("execution_status") != "completed") & (c("result").isNull() | (c("result") == "inconclusive")))
    if table == "asset_observations":
        known, unknown = c("canonical_asset_id").isNotNull() & c("resource_uid").isNotNull(), c("canonical_asset_id").isNull() & c("resource_uid").isNull()
        found["resolution pairing"] = ((c("resolution_outcome") == "RESOLVED") & known & (c("resolution_basis") == "AUTHORITATIVE_DEPLOYMENT_KEY")) | ((c("resolution_outcome") == "AMBIGUOUS") & unknown & (c("resolution_basis") == "WEAK_SIGNAL_COLLISION"))
        found["signal present"] = reduce(Column.__or__, [c(n).isNotNull() for n in SIGNALS]) | (F.size("labels") > 0)
    return {f"{table}.{n}": ok for n, ok in found.items()}


def _name(table: str, columns: list[str], owner: str | None = None) -> str:
    return f"{table} ({', '.join(columns)}) " + (f"in {owner}" if owner else "unique")


def rules() -> list[tuple[str, str]]:
    """Names and kinds (row, unique, foreign) of all rules."""
    found = [(n, "row") for t in TABLES for n in row_rules(t)]
    return found + [(_name(*u), "unique") for u in UNIQUE] + [(MARKER, "unique")] + [(_name(*f), "foreign") for f in FOREIGN]


def _entries(table: str) -> list[Column]:
    entry = lambda rule, key, owns, refers: F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(owns).alias("owns"), F.lit(refers).alias("refers"))
    out = [F.when(~F.coalesce(ok, F.lit(False)), entry(n, F.lit(None), 1, 0)) for n, ok in row_rules(table).items()]
    out += [entry(_name(t, c), joined(*c), 1, 0) for t, c in UNIQUE if t == table]
    if table == "source_events":
        out.append(F.when(F.col("event_type") == "engagement_completed", entry(MARKER, joined("tenant_id", "source_stream_id"), 1, 0)))
    for t, c, owner in FOREIGN:
        if owner == table:
            out.append(entry(_name(t, c, owner), joined(*c), 1, 0))
        if t == table:
            out.append(F.when(reduce(Column.__and__, [F.col(n).isNotNull() for n in c]), entry(_name(t, c, owner), joined(*c), 0, 1)))
    return out


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, kind, n_violations) for every rule: rows that break it, keys that stand twice, keys without an owner.

    tables: any of the seven by name; one that is missing is empty. Empty tables break no rule of their own.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = [df.select(F.explode(F.array_compact(F.array(*_entries(t)))).alias("e")).select("e.*") for t, df in tables.items()]
    seen = reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(F.sum("owns").alias("owns"), F.sum("refers").alias("refers"))
    kinds = F.broadcast(spark.createDataFrame(rules(), "rule string, kind string"))
    found = F.when(F.col("kind") == "row", F.col("owns")).when(F.col("kind") == "unique", (F.col("owns") > 1).cast("long")).otherwise(((F.col("refers") > 0) & (F.col("owns") == 0)).cast("long"))
    sums = seen.join(kinds, "rule").withColumn("bad", found).groupBy("rule").agg(F.sum("bad").alias("bad"))
    return kinds.join(sums, "rule", "left").select("rule", "kind", F.coalesce("bad", F.lit(0)).alias("n_violations"))


def refusals(found: DataFrame) -> DataFrame:
    """Broken rules as :func:`factloom.operators.assertions.required` takes them."""
    return found.where("n_violations > 0").select(F.lit("-").alias("tenant_id"), F.lit("CONSTRAINT").alias("code"), F.concat_ws(" ", "rule", "n_violations").alias("detail"))


def seven_tables(log: DataFrame, engagements: DataFrame, observed: DataFrame, parents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The seven tables of a log.

    log: with canonical_source_hash. engagements: tenant_id, engagement_id, source_stream_id, last_data_sequence. observed: what
    :func:`factloom.operators.identity.observations` takes. parents: the log that assets and findings are taken from, if not
    ``log``.
    """
    base = log if parents is None else parents
    asset = identity.assets(base)
    asset_id = lambda df: identity.stable_id(*[F.col(c) for c in identity.ASSET])
    finding_id = identity.stable_id(*[F.col(c) for c in identity.FINDING])
    occurrence = log.where("event_type = 'finding_observation'")
    own = base.where("event_type = 'finding_observation'").withColumn("arrival", F.col("event_id"))
    first = identity.baselines(own).select("tenant_id", finding_id.alias("finding_id"), asset_id(own).alias("canonical_asset_id"), "vuln_class", F.col("location").alias("normalized_location_signature"), F.lit(1).alias("match_key_version"), *identity.BASELINE)
    none = {n: F.lit(None).cast("string").alias(n) for n in ("pod_uid", "pod_name", "ip_address", "banner")}
    seen = identity.observations(observed).where("outcome <> 'REJECTED'")
    seen = seen.select("tenant_id", "source_event_id", F.when(F.col("resource_uid").isNotNull(), asset_id(seen)).alias("canonical_asset_id"), "cluster_id", "resource_kind", "resource_uid", "dns", "labels", *none.values(), F.col("outcome").alias("resolution_outcome"), F.lit(1).alias("resolution_policy_version"), F.col("basis").alias("resolution_basis"))
    return {
        "engagements": engagements.select("tenant_id", "engagement_id", "source_stream_id", "last_data_sequence"),
        "source_events": log.select("tenant_id", "engagement_id", "source_event_id", "event_type", "source_stream_id", "source_sequence", F.lit(1).alias("schema_version"), "occurred_at", "canonical_source_hash"),
        "assets": asset,
        "asset_observations": seen,
        "findings": first,
        "finding_occurrences": occurrence.select("tenant_id", "source_event_id", finding_id.alias("finding_id")),
        "test_attempts": identity.attempts(log),
    }
