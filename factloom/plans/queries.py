"""The named queries: operators applied to the whole ``events`` table, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import arms, boundary, identity, ingest, planning, posture, reporting
from ..sources.adapter import deliveries, event_hash, event_log, journal_deliveries, raw_attempts, with_markers
from ..sources.staging import Staging
from ..streaming import inbox

CURRENT = "eng-3"
BUDGET = 3
Query = Callable[[SparkSession, str], DataFrame]


def limits(log: DataFrame) -> DataFrame:
    """The limit of each stream: what is beyond the last tenth of its positions is not part of the boundary."""
    top = F.max("source_sequence")
    return log.groupBy("tenant_id", "engagement_id", "source_stream_id").agg((top - F.floor(top / 10)).cast("long").alias("last_data_sequence"))


def markers(log: DataFrame) -> DataFrame:
    """A completion marker for every stream but one, which stays open."""
    return limits(log).where("source_stream_id <> 'stream-2-1'")


def positions(log: DataFrame) -> DataFrame:
    return limits(log).drop("engagement_id")


class Run:
    """What a query uses more than once: the log, the facts and the fold, each written once."""

    def __init__(self, spark: SparkSession, d: str):
        self.work = Staging(spark, "query")
        self.log = self.work.table(event_log(spark, d), "log")

    @cached_property
    def positions(self) -> DataFrame:
        return self.work.table(positions(self.log), "positions")

    @cached_property
    def facts(self) -> DataFrame:
        return self.work.table(boundary.select_facts(self.log, self.positions), "facts")

    @cached_property
    def folded(self) -> DataFrame:
        return self.work.table(posture.fold(self.facts, CURRENT), "folded")

    @cached_property
    def featured(self) -> DataFrame:
        before = posture.fold(self.facts.where(F.col("engagement_id") != CURRENT), "eng-2")
        return self.work.table(planning.memory_features(_candidates(self.log), before), "featured")

    @cached_property
    def hashed(self) -> DataFrame:
        return self.work.table(_hashed(self.log), "hashed")

    @cached_property
    def actions(self) -> DataFrame:
        return self.work.table(planning.candidate_actions(_listed(self.log), self.hashed), "actions")


def facts(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return boundary.select_facts(log, positions(log))


def folded(spark: SparkSession, d: str) -> DataFrame:
    return posture.fold(facts(spark, d), CURRENT)


def boundary_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("tenant_id", "source_stream_id", "source_sequence", "source_event_id", "fact_kind", "resource_uid", "verification_key", "check_version", "execution_status", "result")


def boundary_guard(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    asked = positions(log).withColumn("last_data_sequence", F.when(F.col("source_stream_id") == "stream-1-2", F.col("last_data_sequence") - 1).otherwise(F.col("last_data_sequence")))
    extra = asked.where("source_stream_id = 'stream-0-1'").withColumn("source_stream_id", F.lit("stream-none"))
    return boundary.guard(asked.unionByName(extra), ingest.finalize(log, markers(log))).select("tenant_id", "source_stream_id", "last_data_sequence", "boundary_error")


def guarded_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts behind the guard: the tenant with a stream that is not finalized gets none."""
    log = event_log(spark, d)
    found = boundary.guarded_facts(log, positions(log), ingest.finalize(log, markers(log)))
    return found.select("tenant_id", "source_event_id", "fact_kind")


def finalized_engagements(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).where("not (source_stream_id = 'stream-0-2' and source_sequence = 3)")
    return ingest.finalize(log, markers(log)).withColumn("last_data_sequence", F.coalesce("last_data_sequence", F.lit(0)))


def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gaps(event_log(spark, d).where("event_id % 97 <> 5"))


def inbox_decisions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.decide(deliveries(event_log(spark, d))).select("tenant_id", "source_stream_id", "source_sequence", "source_event_id", "arrival", "decision", "reject_reason")


def completion_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of streams with markers: gap fills, late data, redeliveries."""
    run = Run(spark, d)
    found = inbox.replay(with_markers(run.log, run.positions))
    return found.select("tenant_id", "source_stream_id", "source_sequence", "source_event_id", "arrival", "decision", "reject_reason")


def late_data(spark: SparkSession, d: str) -> DataFrame:
    """Rejected deliveries by stream and reason."""
    run = Run(spark, d)
    rejected = inbox.replay(with_markers(run.log, run.positions)).where("decision = 'REJECTED'")
    return rejected.groupBy("source_stream_id", "reject_reason").agg(F.count("*").alias("n_deliveries"))


def inbox_exact(spark: SparkSession, d: str) -> DataFrame:
    return inbox.replay(deliveries(Run(spark, d).log)).select("tenant_id", "source_stream_id", "source_sequence", "source_event_id", "arrival", "decision", "reject_reason")


def decode_rejects(spark: SparkSession, d: str) -> DataFrame:
    """What the strict codec says to each attempt as JSON text."""
    return canonical.decode_events(raw_attempts(event_log(spark, d))).select("event_id", "reject_reason", "canonical_source_hash")


def stream_binding(spark: SparkSession, d: str) -> DataFrame:
    bound = ingest.bind_streams(deliveries(event_log(spark, d)))
    return bound.groupBy("tenant_id", "source_stream_id", F.coalesce("binding_error", F.lit("OK")).alias("binding")).agg(F.count("*").alias("n_deliveries"))


def replay_noop(spark: SparkSession, d: str) -> DataFrame:
    base = deliveries(event_log(spark, d)).where("arrival < 1000000000")
    twice = base.unionByName(base.withColumn("arrival", F.col("arrival") + 1_000_000_000))
    return ingest.decide(twice).groupBy("decision").agg(F.count("*").alias("n_deliveries"))


def assets(spark: SparkSession, d: str) -> DataFrame:
    return identity.assets(event_log(spark, d))


def new_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets of the current engagement that no earlier one named."""
    log = event_log(spark, d)
    seen = F.col("k") % 3 == 0
    return identity.new_assets(log.where(F.col("engagement_id") == CURRENT), log.where((F.col("engagement_id") == "eng-1") & seen & (F.col("event_type") == "asset_observation")))


def _observed(log: DataFrame) -> DataFrame:
    weak = F.col("k") % 5 == 0
    labels = F.create_map(F.lit("app"), (F.col("k") % 7).cast("string"), F.lit("zone"), (F.col("event_id") % 11).cast("string"))
    return log.where("event_type = 'asset_observation'").select("tenant_id", "cluster_id", "resource_kind", "engagement_id", "source_event_id", F.col("event_id").alias("arrival"), F.when(~weak, F.col("resource_uid")).alias("resource_uid"), F.concat(F.lit("svc-"), F.regexp_extract("resource_uid", r"(\d)$", 1)).alias("dns"), labels.alias("labels"))


def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every label of every observation as a row."""
    return _observed(event_log(spark, d)).select("source_event_id", F.explode("labels").alias("label", "value"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return identity.observations(_observed(event_log(spark, d))).select("tenant_id", "source_event_id", "resource_uid", "outcome", "basis")


def ambiguity_delta(spark: SparkSession, d: str) -> DataFrame:
    seen = identity.observations(_observed(event_log(spark, d)))
    return seen.groupBy("tenant_id", "outcome").agg(F.count("*").alias("n_observations"))


def identity_stability(spark: SparkSession, d: str) -> DataFrame:
    seen = event_log(spark, d).where("event_type = 'asset_observation'")
    per = seen.groupBy(*identity.ASSET).agg(F.count_distinct("engagement_id").alias("n_engagements"), F.count_distinct("k").alias("n_pods"), F.count_distinct(F.concat(F.lit("pod-"), "k")).alias("n_names"), F.count_distinct(F.col("event_id") % 251).alias("n_ips"))
    return per.where("n_engagements > 1 and n_pods > 1 and n_names > 1 and n_ips > 1")


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    drift = F.when(F.col("event_id") % 11 == 0, "2.0.0").otherwise(F.col("check_version"))
    return event_log(spark, d).where("event_type = 'finding_observation'").withColumn("check_version", drift).withColumn("arrival", F.col("event_id"))


def findings_baseline(spark: SparkSession, d: str) -> DataFrame:
    return identity.baselines(_occurrences(spark, d))


def baseline_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return identity.baseline_conflicts(_occurrences(spark, d)).select("tenant_id", "source_event_id", "check_version")


def finding_decisions(spark: SparkSession, d: str) -> DataFrame:
    return identity.finding_decisions(_occurrences(spark, d)).select("tenant_id", "source_event_id", "finding_id", "reject_reason")


def test_attempts(spark: SparkSession, d: str) -> DataFrame:
    return identity.attempts(event_log(spark, d))


def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return posture.coverage_pairs(facts(spark, d)).groupBy(*posture.FINDING).agg(F.count("*").alias("n_attempts"))


def resolving_evidence(spark: SparkSession, d: str) -> DataFrame:
    return posture.resolving(posture.coverage_pairs(facts(spark, d))).select(*posture.FINDING, "source_event_id")


def posture_fold(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d)


def classification_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.class_counts(folded(spark, d))


def exposure_counts(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).groupBy("exposure", "assessment").agg(F.count("*").alias("n_findings"))


def stateless_summary(spark: SparkSession, d: str) -> DataFrame:
    return reporting.stateless_summary(facts(spark, d).where(F.col("engagement_id") == CURRENT))


def human_report(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).select("tenant_id", reporting.finding_line().alias("line"))


def semantic_fact_digest(spark: SparkSession, d: str) -> DataFrame:
    return reporting.fact_digest(facts(spark, d).where(F.col("engagement_id") == CURRENT), "tenant_id")


def _heads(log: DataFrame, seen: DataFrame, asked: DataFrame) -> DataFrame:
    digest = reporting.fact_digest(seen.where(F.col("engagement_id") == CURRENT), "tenant_id").select("tenant_id", F.col("fact_digest").alias("current_engagement_fact_digest"))
    hashes = asked.groupBy("tenant_id").agg(canonical.boundary_digest(F.collect_list(F.struct("source_stream_id", "last_data_sequence"))).alias("knowledge_boundary_hash"))
    return digest.join(hashes, "tenant_id").withColumn("current_engagement_id", F.lit(CURRENT))


def stateless_report(spark: SparkSession, d: str) -> DataFrame:
    """Tenant 0 asks with all its streams and is refused; the others ask with the current engagement's stream alone."""
    log = Run(spark, d).log
    known = limits(log)
    asked = known.where((F.col("engagement_id") == CURRENT) | (F.col("tenant_id") == "tenant-0"))
    other = asked.where(F.col("engagement_id") != CURRENT).select("tenant_id").distinct()
    seen = boundary.select_facts(log, asked)
    return reporting.stateless_report(_heads(log, seen, asked.drop("engagement_id")), seen, other)


def memory_report(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return reporting.memory_report(_heads(run.log, run.facts, run.positions), run.folded)


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.transcript(memory_report(spark, d)).select("tenant_id", canonical.sha256(F.col("transcript")).alias("digest"))


def boundary_digest(spark: SparkSession, d: str) -> DataFrame:
    p = positions(event_log(spark, d))
    return p.groupBy("tenant_id").agg(canonical.boundary_digest(F.collect_list(F.struct("source_stream_id", "last_data_sequence"))).alias("digest"))


def context_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    routes = event_log(spark, d).select("location").distinct()
    route = F.concat(F.lit("/"), F.col("location"))
    digest = canonical.context_fingerprint(F.lit("https"), F.lit(443), route, None, F.lit(False), F.lit(None).cast("string"))
    return routes.select(route.alias("route"), digest.alias("digest"))


def _candidates(log: DataFrame) -> DataFrame:
    targets = log.where("event_type <> 'asset_observation'").select(*planning.TARGET).distinct()
    return targets.withColumn("candidate_id", F.concat_ws(":", "resource_uid", "verification_key"))


def _featured(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d).featured


def memory_features(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d)


def plan_memory_off(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan(_featured(spark, d), BUDGET, False).select("tenant_id", "position", "candidate_id")


def plan_memory_on(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan(_featured(spark, d), BUDGET, True).select("tenant_id", "position", "candidate_id")


def plan_errors(spark: SparkSession, d: str) -> DataFrame:
    """A request whose features miss the candidates of check-1, know one too many and name tenant-2's candidates twice."""
    candidates = _candidates(event_log(spark, d))
    twice = candidates.unionByName(candidates.where("tenant_id = 'tenant-2'"))
    given = candidates.where("verification_key <> 'check-1'").select("tenant_id", "candidate_id")
    extra = candidates.select("tenant_id", F.lit("unknown").alias("candidate_id")).distinct()
    return planning.plan_errors(twice, given.unionByName(extra))


def _listed(log: DataFrame) -> DataFrame:
    """Candidates with the events of the current engagement that they list, in order of position."""
    own = log.where((F.col("engagement_id") == CURRENT) & (F.col("event_type") != "asset_observation") & (F.col("check_version") == "1.0.0"))
    lists = own.groupBy(*planning.TARGET).agg(F.transform(F.array_sort(F.collect_list(F.struct("source_sequence", "source_event_id"))), lambda x: x["source_event_id"]).alias("action_event_ids"))
    return _candidates(log).join(lists, planning.TARGET, "left").withColumn("action_event_ids", F.coalesce("action_event_ids", F.array().cast("array<string>")))


def _hashed(log: DataFrame) -> DataFrame:
    return log.where(F.col("engagement_id") == CURRENT).select("tenant_id", "source_event_id", "event_type", event_hash().alias("event_hash"))


def candidate_actions(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return planning.candidate_actions(_listed(log), _hashed(log))


def supporting_events(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return planning.supporting_events(_hashed(log), planning.candidate_actions(_listed(log), _hashed(log))).select("tenant_id", "source_event_id")


def action_errors(spark: SparkSession, d: str) -> DataFrame:
    """Against a log without one event in fifty."""
    log = event_log(spark, d)
    return planning.action_errors(_listed(log), log.where("event_id % 50 <> 3"))


def regression_metric(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return planning.regression_metric(planning.plan(run.featured, None, True), run.actions, run.folded, run.facts, CURRENT)


def _inputs(run: Run) -> DataFrame:
    """The current engagement's events with their roles in the input of a plan."""
    actions = run.actions.select("tenant_id", F.lit("action").alias("role"), "candidate_id", "source_event_id", "event_hash")
    rest = planning.supporting_events(run.hashed, actions)
    role = F.when(F.col("event_type") == "asset_observation", "supporting").otherwise("background")
    return actions.unionByName(rest.select("tenant_id", role.alias("role"), F.lit(None).cast("string").alias("candidate_id"), "source_event_id", "event_hash"))


def controlled_input_digest(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return planning.controlled_input_digest(_candidates(run.log), _inputs(run), CURRENT, BUDGET)


def arm_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Both arms over all candidates: each ingests the earlier engagements, plans, delivers in its own order, and reports."""
    run = Run(spark, d)
    given = run.work.table(journal_deliveries(run.log, limits(run.log)), "given")
    known = given.where("event_type <> 'engagement_completed'").select("tenant_id", "source_event_id")
    listed = _listed(run.log.join(known, ["tenant_id", "source_event_id"], "left_semi")).select("tenant_id", "candidate_id", "action_event_ids")
    candidates = _candidates(run.log).join(listed, ["tenant_id", "candidate_id"], "left").withColumn("action_event_ids", F.coalesce("action_event_ids", F.array().cast("array<string>")))
    both = arms.both_arms(given).drop("mode")
    early = F.col("engagement_id") != CURRENT
    return arms.compare(*arms.run(both.where(early), both.where(~early), arms.both_arms(candidates).drop("mode"), "eng-2", CURRENT, None))


def detected_without_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return posture.detected_without_occurrence(facts(spark, d))


def detected_unrepresented(spark: SparkSession, d: str) -> DataFrame:
    return posture.detected_unrepresented(facts(spark, d))


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows, or keys, of the deliveries and of the log that break a rule of the tables."""
    run = Run(spark, d)
    log = run.log
    e = run.work.table(deliveries(log), "deliveries")
    twice = lambda name, df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("rule"), "n_violations")
    attempt = F.col("event_type") == "test_attempt"
    legal = F.when(F.col("execution_status") == "completed", F.coalesce(F.col("result").isin("detected", "not_detected"), F.lit(False))).otherwise(F.coalesce(F.col("result") == "inconclusive", F.lit(True)))
    seen = identity.observations(_observed(log))
    paired = (F.col("outcome") == "RESOLVED") & (F.col("basis") == "AUTHORITATIVE_DEPLOYMENT_KEY") & F.col("resource_uid").isNotNull() | (F.col("outcome") == "AMBIGUOUS") & (F.col("basis") == "WEAK_SIGNAL_COLLISION") & F.col("resource_uid").isNull()
    one = lambda df, name, bad: df.agg(F.count_if(bad).alias("n_violations")).select(F.lit(name).alias("rule"), "n_violations")
    parts = [
        twice("unique_event", e, "tenant_id", "source_event_id"),
        twice("unique_position", e, "tenant_id", "source_stream_id", "source_sequence"),
        twice("one_marker", markers(log), "tenant_id", "source_stream_id"),
        one(e, "positive_sequence", F.col("source_sequence") <= 0),
        one(log, "nonblank_id", ~F.coalesce(F.col("source_event_id").rlike(r"\S"), F.lit(False))),
        one(log, "hex_hash", ~F.coalesce(F.col("relevant_context_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        one(log, "status_result", attempt & ~legal),
        one(log, "policy_version", F.col("compatibility_policy_version") != 1),
        one(seen, "outcome_basis", ~F.coalesce(paired, F.lit(False))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixture_validation(spark: SparkSession, d: str) -> DataFrame:
    e = event_log(spark, d)
    leak = e.where(F.concat_ws("|", "source_event_id", "resource_uid", "vuln_class").rlike("F-(STILL|FIXED|REGRESS|UNTESTED|INCONCLUSIVE|NEW)|T-[ABC]"))
    return leak.agg(F.count("*").alias("n_leaks")).crossJoin(e.agg(F.count_distinct("source_event_id").alias("n_ids"), F.count("*").alias("n_events")))


def table_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """An order-free fingerprint of whole rows as JSON: the sum of a piece of every row's digest."""
    columns = ["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "event_type", "cluster_id", "resource_uid", "verification_key", "check_version", "relevant_context_hash", "compatibility_policy_version", "execution_status", "result"]
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 8), 16, 10).cast("long")
    return event_log(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n_rows"), F.sum(part).alias("fingerprint"))


def empty_tables(spark: SparkSession, d: str) -> DataFrame:
    """Whether each derived table has any row."""
    log = event_log(spark, d)
    tables = {"source_events": log, "assets": identity.assets(log), "findings": _occurrences(spark, d), "test_attempts": identity.attempts(log), "nothing": log.where("source_sequence < 0")}
    some = [df.select(F.lit(n).alias("name")).limit(1) for n, df in tables.items()]
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    names = spark.createDataFrame([(n,) for n in tables], "name string")
    return names.join(out.withColumn("x", F.lit(True)), "name", "left").select("name", F.col("x").isNull().alias("is_empty"))


def shuffle_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Accepted events by tenant after arrivals are shuffled: the same set whatever the order."""
    base = deliveries(event_log(spark, d)).where("arrival < 1000000000")
    mixed = base.withColumn("arrival", F.xxhash64("source_event_id", F.lit(42)))
    return ingest.decide(mixed).where("decision = 'ACCEPTED'").groupBy("tenant_id").agg(F.count("*").alias("n_accepted"), F.sum("source_sequence").alias("sum_sequence"))


def memory_report_findings(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).select("tenant_id", "cluster_id", "resource_kind", "resource_uid", "vuln_class", F.col("location").alias("normalized_location_signature"), F.lit(1).alias("match_key_version"), "verification_key", F.col("classification").alias("episode_classification"), F.col("assessment").alias("current_assessment"), F.col("exposure").alias("last_verified_exposure"))


def queries() -> dict[str, Query]:
    from . import proofs

    found = [boundary_facts, boundary_guard, guarded_facts, finalized_engagements, stream_gaps, inbox_decisions, inbox_exact, completion_decisions, late_data, decode_rejects, stream_binding, replay_noop, assets, new_assets, label_pairs, observations, ambiguity_delta, identity_stability, findings_baseline, baseline_conflicts, finding_decisions, test_attempts, coverage_pairs, resolving_evidence, posture_fold, classification_counts, exposure_counts, stateless_summary, human_report, stateless_report, memory_report, transcripts, memory_report_findings, semantic_fact_digest, boundary_digest, context_fingerprints, memory_features, plan_memory_off, plan_memory_on, plan_errors, candidate_actions, supporting_events, action_errors, regression_metric, arm_comparison, controlled_input_digest, detected_without_occurrence, detected_unrepresented, constraint_violations, fixture_validation, table_snapshot_hash, empty_tables, shuffle_convergence]
    return {f.__name__: f for f in found} | proofs.all_queries()
