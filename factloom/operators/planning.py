"""Memory features, deterministic plans, actions, the regression metric, arms and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import ASSET, FINDING

TARGET = [*ASSET, "verification_key"]


def memory_features(candidates: DataFrame, posture: DataFrame) -> DataFrame:
    """Adds has_prior_verified_resolution; a target or key without findings has false."""
    prior = posture.where("exposure = 'VERIFIED_RESOLVED'").select(*TARGET).distinct().withColumn("hit", F.lit(True))
    return candidates.join(prior, TARGET, "left").withColumn("has_prior_verified_resolution", F.coalesce("hit", F.lit(False))).drop("hit")


def plan_errors(candidates: DataFrame, features: DataFrame) -> DataFrame:
    """Candidates named twice, without a feature, or with a feature but unknown; a valid request has none.

    Features cover the candidates one to one, or there are none at all.
    """
    keys = ["tenant_id", "candidate_id"]
    marked = candidates.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(features.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("f")))
    counts = marked.groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("f").alias("f"))
    any_ = counts.groupBy("tenant_id").agg((F.sum("f") > 0).alias("given"))
    error = F.when(F.col("c") > 1, "DUPLICATE_CANDIDATE").when(F.col("f") > 1, "DUPLICATE_FEATURE").when(F.col("c") == 0, "UNKNOWN_CANDIDATE").when(F.col("given") & (F.col("f") == 0), "MISSING_FEATURE")
    return counts.join(any_, "tenant_id").select(*keys, error.alias("error")).where("error is not null")


def plan(featured: DataFrame, budget: int | None, use_memory: bool) -> DataFrame:
    """The first ``budget`` candidates of each tenant (None: all), by prior resolution (with memory), then candidate id."""
    keys = [F.desc("has_prior_verified_resolution"), F.col("candidate_id")] if use_memory else [F.col("candidate_id")]
    w = Window.partitionBy("tenant_id").orderBy(*keys)
    ranked = featured.withColumn("position", F.row_number().over(w))
    return ranked if budget is None else ranked.where(F.col("position") <= budget)


def candidate_actions(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """``(tenant_id, candidate_id, action, source_event_id, event_hash)``: the events that a candidate lists, in its order.

    candidates: candidate_id and action_event_ids, an array. events: source_event_id and event_hash.
    """
    listed = candidates.select("tenant_id", "candidate_id", F.posexplode("action_event_ids").alias("action", "source_event_id"))
    return listed.join(events.select("tenant_id", "source_event_id", "event_hash"), ["tenant_id", "source_event_id"]).select("tenant_id", "candidate_id", "action", "source_event_id", "event_hash")


def supporting_events(events: DataFrame, actions: DataFrame) -> DataFrame:
    """The events that no candidate lists."""
    return events.join(actions.select("tenant_id", "source_event_id").distinct(), ["tenant_id", "source_event_id"], "left_anti")


def action_errors(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates without actions, and actions that no event has or that are listed twice; a valid set has none."""
    keys = ["tenant_id", "source_event_id"]
    none = candidates.where(F.size("action_event_ids") <= 0).select("tenant_id", F.lit(None).cast("string").alias("source_event_id"), F.lit("NO_ACTIONS").alias("error"))
    listed = candidates.select("tenant_id", F.explode("action_event_ids").alias("source_event_id"))
    unknown = listed.distinct().join(events.select(*keys), keys, "left_anti").withColumn("error", F.lit("UNKNOWN_ACTION"))
    twice = listed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("error", F.lit("REUSED_ACTION"))
    return none.unionByName(unknown).unionByName(twice)


def regression_metric(planned: DataFrame, actions: DataFrame, posture: DataFrame, facts: DataFrame, current_engagement: str, by: tuple[str, ...] = ()) -> DataFrame:
    """By tenant, and further columns ``by`` of the plan: the first position of a plan that owns an event which shows a regression, and how many owners such
    events have at most; tenants without one have no row.

    Events: occurrences of the current engagement of findings that fold to REGRESSED. More than one owner is an error.
    """
    regressed = posture.where("classification = 'REGRESSED'").select(*FINDING)
    shown = facts.where(F.col("engagement_id") == current_engagement).where("fact_kind = 'finding_occurrence'").join(regressed, FINDING, "left_semi")
    owned = shown.select("tenant_id", "source_event_id").distinct().join(actions.select("tenant_id", "source_event_id", "candidate_id"), ["tenant_id", "source_event_id"])
    placed = owned.join(planned.select("tenant_id", "candidate_id", "position", *by), ["tenant_id", "candidate_id"])
    events = placed.groupBy("tenant_id", *by, "source_event_id").agg(F.min("position").alias("position"), F.count("*").alias("n"))
    return events.groupBy("tenant_id", *by).agg(F.min("position").alias("actions_before_regression"), F.max("n").alias("most_owners"))


#: What both arms must have in common, beside the candidates.
COMMON = ["boundary_hash", "earlier_fact_digest", "input_digest", "fact_digest", "report_digest"]


def compare_arms(control: DataFrame, memory: DataFrame) -> DataFrame:
    """By tenant: whether both arms execute the same candidates and whether the order differs.

    control and memory: tenant_id, candidate_id, position. One full join by candidate; nothing is gathered.
    """
    a = control.select("tenant_id", "candidate_id", F.col("position").alias("a"))
    b = memory.select("tenant_id", "candidate_id", F.col("position").alias("b"))
    both = a.join(b, ["tenant_id", "candidate_id"], "full")
    return both.groupBy("tenant_id").agg(
        F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same_candidates"),
        F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("order_differs"),
    )


def compare_evidence(evidence: DataFrame, orders: DataFrame) -> DataFrame:
    """By tenant: every check on two arms; ``comparable`` if all that must be equal is, modes differ and both began empty.

    evidence: a row for each tenant and mode (memory-off, memory-on) with current_facts_before, the columns of COMMON and
    actions_before_regression. orders: :func:`compare_arms`.
    """
    metric = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("actions_before_regression")))
    checks = {
        "modes_differ": (F.count_distinct("mode") == 2) & (F.count("*") == 2),
        "both_began_empty": F.max("current_facts_before") == 0,
        **{f"same_{c}": (F.count_distinct(c) == 1) & (F.count(c) == 2) for c in COMMON},
    }
    out = evidence.groupBy("tenant_id").agg(*[c.alias(n) for n, c in checks.items()], metric("memory-off").alias("control_metric"), metric("memory-on").alias("memory_metric")).join(orders, "tenant_id")
    comparable = F.col("same_candidates")
    for n in checks:
        comparable &= F.col(n)
    return out.withColumn("comparable", comparable)


def controlled_input_digest(candidates: DataFrame, events: DataFrame, engagement_id: str, budget: int | None, tenant: Column | None = None) -> DataFrame:
    """By tenant: digest of the line text of tenant, engagement, budget, candidates with their actions, and other events.

    candidates: tenant_id, candidate_id and the target. events: tenant_id, role (action, supporting, background or
    completion), candidate_id (of actions), source_event_id, event_hash. tenant: the name in the text, as an expression of
    tenant_id. The digest covers one ordered text by definition.
    """
    # The order of sections and the form of the lines.
    target = F.concat_ws("|", F.concat(F.lit("candidate="), F.col("candidate_id")), "cluster_id", "resource_kind", "resource_uid", "verification_key")
    section = F.when(F.col("role") == "action", 0).when(F.col("role") == "supporting", 1).when(F.col("role") == "background", 2).otherwise(3)
    role = F.when(F.col("role") == "action", F.concat(F.lit("action:"), F.col("candidate_id"))).otherwise(F.col("role"))
    heads = candidates.select("tenant_id", F.lit(0).alias("section"), "candidate_id", F.lit("").alias("event"), target.alias("line"))
    known = candidates.select("tenant_id", "candidate_id").distinct()
    kept = events.where("role <> 'action'").unionByName(events.where("role = 'action'").join(known, ["tenant_id", "candidate_id"], "left_semi"))
    rest = kept.select("tenant_id", section.alias("section"), F.coalesce("candidate_id", F.lit("")).alias("candidate_id"), F.col("source_event_id").alias("event"), F.concat(role, F.lit("="), F.col("source_event_id"), F.lit("|"), F.col("event_hash")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "candidate_id", "event", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    head = F.concat(F.lit("tenant="), F.col("tenant_id") if tenant is None else tenant, F.lit(f"\nengagement={engagement_id}\nbudget={budget}\n"))
    return heads.unionByName(rest).groupBy("tenant_id").agg(F.array_join(lines, "").alias("body")).select("tenant_id", F.sha2(F.concat(head, "body"), 256).alias("digest"))


__all__ = ["FINDING", "action_errors", "candidate_actions", "compare_arms", "compare_evidence", "controlled_input_digest", "memory_features", "plan", "plan_errors", "regression_metric", "supporting_events"]
