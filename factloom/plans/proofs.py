"""Queries that prove something of a log: rules of the tables, refusals of reports, digests of whole row sets. With DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import multiset
from ..operators import assertions, boundary, bundle_rules, constraints, ingest, posture
from ..sources.adapter import deliveries, event_hash
from ..streaming import inbox
from . import oracle, queries

ROW = ["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "event_type", "cluster_id", "resource_uid", "verification_key", "check_version", "relevant_context_hash", "compatibility_policy_version", "execution_status", "result"]
DELIVERED = ["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "content"]


def _planted(log: DataFrame) -> DataFrame:
    """The log with damages of every kind that the rules of the tables know."""
    at = lambda n, r: F.col("event_id") % n == r
    put = lambda name, when, value: F.when(when, value).otherwise(F.col(name))
    return log.withColumns(
        {
            "source_event_id": put("source_event_id", at(101, 1), " "),
            "source_sequence": put("source_sequence", at(103, 2), F.lit(0).cast("long")),
            "engagement_id": put("engagement_id", at(113, 5), "eng-none"),
            "check_version": put("check_version", at(97, 3), ""),
            "resource_kind": put("resource_kind", (F.col("event_type") == "test_attempt") & at(109, 4), "Pod"),
            "result": put("result", (F.col("execution_status") == "completed") & at(11, 6), "inconclusive"),
            "relevant_context_hash": put("relevant_context_hash", at(107, 3), F.upper("relevant_context_hash")),
            "event_type": F.when(at(83, 8), "engagement_completed").when(at(79, 9), "mystery").otherwise(F.col("event_type")),
            "canonical_source_hash": F.when(at(89, 7), "x").otherwise(event_hash()),
        }
    )


def table_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the seven tables over a damaged log whose findings and assets lack some parents."""
    run = queries.Run(spark, d)
    log = run.work.table(_planted(run.log), "planted")
    parents = run.log.where("k % 4 <> 1 and resource_uid not like '%7'")
    return constraints.violations(constraints.seven_tables(log, queries.limits(run.log), queries._observed(log), parents))


def report_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries with an unknown stream, one that is not finalized, a wrong position, a repeated stream and no current
    engagement; detections that nothing represents; findings that stand twice."""
    run = queries.Run(spark, d)
    known = run.positions
    wrong = F.when(F.col("source_stream_id") == "stream-1-2", F.col("last_data_sequence") - 1).otherwise(F.col("last_data_sequence"))
    asked = known.withColumn("last_data_sequence", wrong).where("source_stream_id <> 'stream-1-3'")
    extra = known.where("source_stream_id = 'stream-0-1'").withColumn("source_stream_id", F.lit("stream-none"))
    asked = asked.unionByName(extra).unionByName(known.where("source_stream_id = 'stream-0-2'"))
    folded = run.folded.unionByName(run.folded.where("vuln_class = 'vuln-3'"))
    return assertions.report_refusals(asked, ingest.finalize(run.log, queries.markers(run.log)), run.facts, folded, queries.CURRENT)


def lost_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that a join by asset loses where assets are only those that findings name."""
    run = queries.Run(spark, d)
    named = run.facts.where("fact_kind = 'finding_occurrence'").select(*posture.ASSET).distinct()
    return assertions.lost_facts(run.facts, run.facts.join(named, posture.ASSET))


def guarded_report_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by tenant and kind, from a job that stops if a limit is not the finalized one."""
    run = queries.Run(spark, d)
    done = ingest.finalize(run.log, queries.limits(run.log))
    wrong = boundary.guard(run.positions, done).where("boundary_error is not null").select("tenant_id", F.col("boundary_error").alias("code"), F.col("source_stream_id").alias("detail"))
    return assertions.required(run.facts, wrong).groupBy("tenant_id", "fact_kind").agg(F.count("*").alias("n_facts"))


def row_multiset(spark: SparkSession, d: str) -> DataFrame:
    """A collision-safe digest of each tenant's whole rows in any order."""
    return multiset.multiset_digest(queries.event_log(spark, d), ["tenant_id"], ROW)


def replay_digest(spark: SparkSession, d: str) -> DataFrame:
    """Whether a replay of everything leaves the accepted rows as they were, and their digest."""
    run = queries.Run(spark, d)
    base = run.work.table(deliveries(run.log).where("arrival < 1000000000"), "base")
    again = base.unionByName(base.withColumn("arrival", F.col("arrival") + 1_000_000_000))
    kept = lambda df: inbox.replay(df).where("decision = 'ACCEPTED'")
    return multiset.same_rows(kept(base), kept(again), ["tenant_id"], DELIVERED)


def bundle_events(spark: SparkSession, d: str) -> DataFrame:
    """Ids and positions that stand twice, and payloads that carry a runner's token, in the damaged log."""
    label = F.when(F.col("event_id") % 61 == 10, "F-NEW")
    payload = F.to_json(F.struct("resource_uid", "vuln_class", label.alias("label")))
    return bundle_rules.event_violations(_planted(queries.event_log(spark, d)).withColumn("payload", payload))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (table_constraints, report_refusals, lost_facts, guarded_report_facts, row_multiset, replay_digest, bundle_events)}


PLANT = """
plant AS (SELECT * REPLACE (CASE WHEN event_id % 101 = 1 THEN ' ' ELSE source_event_id END AS source_event_id,
  CASE WHEN event_id % 103 = 2 THEN 0 ELSE source_sequence END AS source_sequence, CASE WHEN event_id % 113 = 5 THEN 'eng-none' ELSE engagement_id END AS engagement_id,
  CASE WHEN event_id % 97 = 3 THEN '' ELSE check_version END AS check_version, CASE WHEN event_type = 'test_attempt' AND event_id % 109 = 4 THEN 'Pod' ELSE resource_kind END AS resource_kind,
  CASE WHEN execution_status = 'completed' AND event_id % 11 = 6 THEN 'inconclusive' ELSE result END AS result,
  CASE WHEN event_id % 107 = 3 THEN upper(relevant_context_hash) ELSE relevant_context_hash END AS relevant_context_hash,
  CASE WHEN event_id % 83 = 8 THEN 'engagement_completed' WHEN event_id % 79 = 9 THEN 'mystery' ELSE event_type END AS event_type),
  CASE WHEN event_id % 89 = 7 THEN 'x' ELSE sha256('') END AS canonical_source_hash FROM log)"""

SEVEN = """
par AS (SELECT * FROM log WHERE k % 4 <> 1 AND resource_uid NOT LIKE '%7'),
t_engagements AS (SELECT tenant_id, engagement_id, source_stream_id, max(source_sequence) - max(source_sequence) // 10 AS last_data_sequence FROM log GROUP BY ALL),
t_source_events AS (SELECT *, 1 AS schema_version FROM plant),
t_assets AS (SELECT DISTINCT tenant_id, cluster_id, resource_kind, resource_uid, ASSET AS canonical_asset_id FROM par),
t_asset_observations AS (SELECT tenant_id, source_event_id, CASE WHEN resource_uid IS NOT NULL THEN tenant_id || '|' || cluster_id || '|Deployment|' || resource_uid END AS canonical_asset_id, cluster_id, 'Deployment' AS resource_kind, resource_uid, dns,
  NULL::VARCHAR AS pod_uid, NULL::VARCHAR AS pod_name, NULL::VARCHAR AS ip_address, NULL::VARCHAR AS banner, outcome AS resolution_outcome, 1 AS resolution_policy_version, basis AS resolution_basis FROM seen WHERE outcome <> 'REJECTED'),
t_findings AS (SELECT tenant_id, FINDING AS finding_id, ASSET AS canonical_asset_id, vuln_class, location AS normalized_location_signature, 1 AS match_key_version, min_by(verification_key, event_id) AS verification_key,
  min_by(check_version, event_id) AS check_version, min_by(relevant_context_hash, event_id) AS relevant_context_hash, min_by(compatibility_policy_version, event_id) AS compatibility_policy_version
  FROM par WHERE event_type = 'finding_observation' GROUP BY tenant_id, cluster_id, resource_kind, resource_uid, vuln_class, location),
t_finding_occurrences AS (SELECT tenant_id, source_event_id, FINDING AS finding_id FROM plant WHERE event_type = 'finding_observation'),
t_test_attempts AS (SELECT *, ASSET AS canonical_asset_id FROM plant WHERE event_type = 'test_attempt')"""


def _rules_sql() -> str:
    c, q = constraints, lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
    holds = []
    for t in c.TABLES:
        found = {f"{n} nonblank": f"regexp_matches({n}, '[^\\s]')" for n in c.NONBLANK[t]}
        found |= {f"{n} null or nonblank": f"{n} IS NULL OR regexp_matches({n}, '[^\\s]')" for n in c.NULL_OR_NONBLANK.get(t, [])}
        found |= {f"{n} positive": f"{n} > 0" for n in c.POSITIVE.get(t, [])} | {f"{n} null or positive": f"{n} IS NULL OR {n} > 0" for n in c.NULL_OR_POSITIVE.get(t, [])}
        found |= {f"{n} hex": f"regexp_full_match({n}, '[0-9a-f]{{64}}')" for n in c.HEX.get(t, [])} | {f"{n} is 1": f"{n} = 1" for n in c.ONE.get(t, [])}
        found |= {f"{n} listed": f"{n} IN {q(v)}" for n, v in c.VALUES.get(t, {}).items()} | {f"{n} null or listed": f"{n} IS NULL OR {n} IN {q(v)}" for n, v in c.NULL_OR_VALUES.get(t, {}).items()}
        if t == "test_attempts":
            found["outcome pairing"] = "CASE WHEN execution_status = 'completed' THEN coalesce(result, '') IN ('detected', 'not_detected') ELSE coalesce(result, 'inconclusive') = 'inconclusive' END"
        if t == "asset_observations":
            found["resolution pairing"] = "concat_ws('/', resolution_outcome, resolution_basis, resource_uid IS NULL, canonical_asset_id IS NULL) IN ('RESOLVED/AUTHORITATIVE_DEPLOYMENT_KEY/false/false', 'AMBIGUOUS/WEAK_SIGNAL_COLLISION/true/true')"
            found["signal present"] = "true"
        holds += [f"SELECT '{t}.{n}' AS rule, 'row' AS kind, count(*) FILTER (NOT coalesce({ok}, false)) AS n_violations FROM t_{t}" for n, ok in found.items()]
    for t, columns in c.UNIQUE:
        holds.append(f"SELECT '{t} ({', '.join(columns)}) unique', 'unique', count(*) FROM (SELECT 1 FROM t_{t} GROUP BY {', '.join(columns)} HAVING count(*) > 1)")
    holds.append("SELECT 'source_events one marker', 'unique', count(*) FROM (SELECT 1 FROM t_source_events WHERE event_type = 'engagement_completed' GROUP BY tenant_id, source_stream_id HAVING count(*) > 1)")
    for t, columns, owner in c.FOREIGN:
        there = " AND ".join(f"{n} IS NOT NULL" for n in columns)
        holds.append(f"SELECT '{t} ({', '.join(columns)}) in {owner}', 'foreign', count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM t_{t} WHERE {there}) ANTI JOIN t_{owner} USING ({', '.join(columns)})")
    return " UNION ALL ".join(holds)


def sql(observed: str, asked: str, row_json: str, unrepresented: str) -> dict[str, str]:
    """observed, asked, row_json, unrepresented: parts of the other queries' SQL."""
    asset = "(tenant_id || '|' || cluster_id || '|' || resource_kind || '|' || resource_uid)"
    finding = asset[:-1] + " || '|' || vuln_class || '|' || location)"
    seven = SEVEN.replace("FINDING", finding).replace("ASSET", asset)
    lanes = lambda text: "count(*) AS n_rows, " + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(sha256({text}), {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS lane_{i + 1}" for i in range(4))
    post = oracle.fold("true", "eng-3", "post")
    delivered = "'{\"tenant_id\":\"' || tenant_id || '\",\"engagement_id\":\"' || engagement_id || '\",\"source_stream_id\":\"' || source_stream_id || '\",\"source_sequence\":' || source_sequence || ',\"source_event_id\":\"' || source_event_id || '\",\"content\":\"' || content || '\"}'"
    return {
        "table_constraints": oracle._with(oracle.LOG, PLANT, observed.replace("FROM log ", "FROM plant "), seven) + _rules_sql(),
        "report_refusals": oracle._with(oracle.LOG, asked, post)
        + "SELECT tenant_id, CASE WHEN lim IS NULL THEN 'UNKNOWN_STREAM' WHEN source_stream_id = 'stream-2-1' THEN 'NOT_FINALIZED' ELSE 'WRONG_POSITION' END AS code, source_stream_id AS detail FROM ask LEFT JOIN pos USING (tenant_id, source_stream_id) WHERE source_stream_id <> 'stream-1-3' AND (lim IS NULL OR source_stream_id = 'stream-2-1' OR lim <> last_data_sequence)"
        " UNION ALL SELECT tenant_id, 'REPEATED_STREAM', source_stream_id FROM pos WHERE source_stream_id = 'stream-0-2' UNION ALL SELECT DISTINCT tenant_id, 'NO_CURRENT_ENGAGEMENT', 'eng-3' FROM pos WHERE tenant_id = 'tenant-1'"
        f" UNION ALL SELECT tenant_id, 'UNREPRESENTED_DETECTION', source_event_id FROM ({unrepresented}) UNION ALL SELECT tenant_id, 'REPEATED_FINDING', {finding} FROM post WHERE vuln_class = 'vuln-3'",
        "lost_facts": oracle._with(oracle.LOG) + "SELECT tenant_id, 'LOST_OR_DOUBLED_FACT' AS code, tenant_id || '|' || source_event_id || '|' || fact_kind AS detail FROM facts ANTI JOIN (SELECT DISTINCT tenant_id, cluster_id, resource_uid FROM facts WHERE fact_kind = 'finding_occurrence') USING (tenant_id, cluster_id, resource_uid)",
        "guarded_report_facts": oracle._with(oracle.LOG) + "SELECT tenant_id, fact_kind, count(*) AS n_facts FROM facts GROUP BY ALL",
        "row_multiset": oracle._with(oracle.LOG) + "SELECT tenant_id, " + lanes(f"'{{' || {row_json} || '}}'") + " FROM log GROUP BY ALL",
        "replay_digest": oracle._with(oracle.LOG, oracle.DELIVERIES) + "SELECT tenant_id, true AS same, " + lanes(delivered) + " FROM b GROUP BY tenant_id",
        "bundle_events": oracle._with(oracle.LOG, PLANT)
        + "SELECT 'DUPLICATE_EVENT' AS rule, source_event_id AS item FROM plant GROUP BY source_event_id HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_POSITION', source_stream_id || '#' || source_sequence FROM plant GROUP BY source_stream_id, source_sequence HAVING count(*) > 1 UNION ALL SELECT 'RUNNER_TOKEN', source_event_id FROM plant WHERE event_id % 61 = 10",
    }
