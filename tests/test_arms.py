"""Steering arms over more candidates than the experiment has."""

from pyspark.sql import functions as F
from pyspark.sql import readwriter

from factloom.operators import arms, planning, reporting
from factloom.sources import staging


def test_places_of_many_candidates(spark):
    """A plan's positions are ints; a place is a million times as much, which an int holds for 2 147 candidates only."""
    candidates = spark.range(3000).select(F.lit("t").alias("tenant_id"), F.format_string("c%04d", "id").alias("candidate_id"), F.lit(False).alias("has_prior_verified_resolution"))
    actions = candidates.select("tenant_id", "candidate_id", F.lit(1).alias("action"), F.concat(F.lit("e"), "candidate_id").alias("source_event_id"))
    executed = planning.plan(candidates, None, True).join(actions, ["tenant_id", "candidate_id"])
    got = [tuple(r) for r in arms.action_places(executed).select("source_event_id", "place").orderBy("place").collect()]
    assert got == [(f"ec{i:04d}", (i + 1) * 10**6 + 1) for i in range(3000)]


def test_reports_stay_off_the_driver(spark):
    """A memory report joins one row of heads to a row with all findings of the tenant; only the former is broadcast."""
    heads = spark.createDataFrame([("t", "b", "e", "f")], "tenant_id string, knowledge_boundary_hash string, current_engagement_id string, current_engagement_fact_digest string")
    texts = {n: F.concat(F.lit(n), F.col("id").cast("string")) for n in ("cluster_id", "resource_kind", "resource_uid", "vuln_class", "location", "verification_key", "assessment", "exposure")}
    posture = spark.range(1000).select(F.lit("t").alias("tenant_id"), F.lit("NEW").alias("classification"), *[c.alias(n) for n, c in texts.items()])
    report = reporting.memory_report(heads, posture)
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" in plan and "BuildRight" not in plan
    assert report.count() == 1


def test_tables_of_small_files_are_not_small(spark, monkeypatch):
    """A table of 300 000 names takes 0.2 MB on disk and 18 MB or more in a broadcast."""
    work = staging.Staging(spark, "test")
    names = work.table(spark.range(300_000).select(F.format_string("deploy-%040d", "id").alias("name"), F.lit(1).alias("one")), "names")
    few = work.table(names.limit(10), "few")
    plans, write = [], readwriter.DataFrameWriter.parquet

    def parquet(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(readwriter.DataFrameWriter, "parquet", parquet)
    many = spark.range(400_000).select(F.format_string("deploy-%040d", "id").alias("name"))
    assert work.table(many.join(names, "name"), "joined").count() == 300_000
    assert work.table(many.join(few, "name"), "little").count() == 10
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" in plans[1]
