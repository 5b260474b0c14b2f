"""Rules of the tables, jobs that stop, digests of row sets, bundle rules, and tables that commit together."""

import json
import os

import pytest
from pyspark.sql import functions as F

import fixture
from factloom.functions import multiset
from factloom.operators import assertions, boundary, bundle_rules, constraints, ingest, journal, posture
from factloom.sources import bundle, commit


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("proofs")
    fixture.write(d)
    decoded = bundle.read_event_set(spark, str(d / "sets"))
    # All are accepted (tests/test_journey.py), so decisions are left out here.
    given = journal.deliveries(decoded.withColumn("arrival", F.col("arrival") + F.when(F.col("engagement_id") == "engagement-2", 100).otherwise(0)))
    return given.select(*journal.LOG).cache()


@pytest.fixture(scope="module")
def tables(spark, log, tmp_path_factory):
    data, markers = journal.data_and_markers(log)
    observed = data.where("event_type = 'asset_observation'").withColumn("arrival", F.col("event_id"))
    d = tmp_path_factory.mktemp("tables")
    written = {}
    for n, df in constraints.seven_tables(log, ingest.finalize(data, markers), observed).items():
        df.write.parquet(str(d / n))
        written[n] = spark.read.schema(df.schema).parquet(str(d / n))
    return written


def broken(found):
    return {r["rule"]: r["n_violations"] for r in found.where("n_violations > 0").collect()}


def test_an_accepted_log_breaks_no_rule(tables):
    found = constraints.violations(tables)
    assert broken(found) == {} and found.count() == len(constraints.rules()) == len(dict(constraints.rules()))


def test_each_table_is_read_once(tables):
    plan = constraints.violations(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 7


@pytest.mark.parametrize(
    "table, column, value, rules",
    [
        ("engagements", "tenant_id", " ", {"engagements.tenant_id nonblank": 2, "engagements (tenant_id, engagement_id) unique": 0, "source_events (tenant_id, engagement_id, source_stream_id) in engagements": 2}),
        ("engagements", "source_stream_id", "s", {"engagements (source_stream_id) unique": 1, "source_events (tenant_id, engagement_id, source_stream_id) in engagements": 2}),
        ("engagements", "last_data_sequence", 0, {"engagements.last_data_sequence null or positive": 2}),
        ("source_events", "event_type", "engagement_completed", {"source_events one marker": 2}),
        ("source_events", "schema_version", 2, {"source_events.schema_version is 1": 18}),
        ("source_events", "canonical_source_hash", "0" * 64 + "\n", {"source_events.canonical_source_hash hex": 18}),
        ("assets", "resource_kind", "Pod", {"assets.resource_kind listed": 1, "asset_observations (tenant_id, canonical_asset_id, cluster_id, resource_kind, resource_uid) in assets": 1}),
        ("asset_observations", "resolution_basis", "GUESS", {"asset_observations.resolution pairing": 3}),
        ("asset_observations", "banner", "", {"asset_observations.banner null or nonblank": 3}),
        ("findings", "finding_id", "f", {"findings (tenant_id, finding_id) unique": 1, "finding_occurrences (tenant_id, finding_id) in findings": 6}),
        ("findings", "compatibility_policy_version", 2, {"findings.compatibility_policy_version is 1": 6}),
        ("test_attempts", "execution_status", "late", {"test_attempts.execution_status listed": 5, "test_attempts.outcome pairing": 4}),
        ("test_attempts", "result", None, {"test_attempts.outcome pairing": 4}),
        ("test_attempts", "canonical_asset_id", "a", {"test_attempts (tenant_id, canonical_asset_id) in assets": 1}),
    ],
)
def test_damage_is_found(tables, table, column, value, rules):
    damaged = tables | {table: tables[table].withColumn(column, F.lit(value).cast(tables[table].schema[column].dataType))}
    assert broken(constraints.violations(damaged)) == {r: n for r, n in rules.items() if n}


def test_observation_without_signals(tables):
    bare = tables["asset_observations"]
    for n in (*constraints.SIGNALS, "labels"):
        bare = bare.withColumn(n, F.lit(None).cast(bare.schema[n].dataType))
    assert broken(constraints.violations(tables | {"asset_observations": bare})) == {"asset_observations.signal present": 3}


def test_multiset_digest(spark):
    rows = [("g", i % 7, str(i)) for i in range(200)]
    make = lambda r: spark.createDataFrame(r, "g string, a int, b string")
    same = lambda x, y: multiset.same_rows(make(x), make(y), ["g"], ["a", "b"]).first()["same"]
    assert same(rows, rows[::-1])
    assert not same(rows, rows[:-1] + rows[:1])
    assert not same(rows + rows[:1], rows)
    assert not same(rows, rows[:-1] + [("g", 1, None)])
    assert not multiset.same_rows(make(rows), make([]), ["g"], ["a", "b"]).first()["same"]
    assert multiset.multiset_digest(make([]), [], ["a", "b"]).first()[:] == (0, "0", "0", "0", "0")


def refused(log, current="engagement-2", positions=None, drop=None, twice=False):
    data, markers = journal.data_and_markers(log)
    done = ingest.finalize(data, markers)
    asked = done.select("tenant_id", "source_stream_id", "last_data_sequence")
    asked = positions(asked) if positions else asked
    facts = boundary.select_facts(data if drop is None else data.where(drop), asked)
    folded = posture.fold(facts, current)
    return assertions.report_refusals(asked, done, facts, folded.unionByName(folded) if twice else folded, current), folded


@pytest.mark.parametrize(
    "case, code",
    [
        ({}, None),
        ({"positions": lambda p: p.withColumn("last_data_sequence", F.col("last_data_sequence") - 1)}, "WRONG_POSITION"),
        ({"positions": lambda p: p.withColumn("source_stream_id", F.concat("source_stream_id", F.lit("x")))}, "UNKNOWN_STREAM"),
        ({"positions": lambda p: p.unionByName(p)}, "REPEATED_STREAM"),
        ({"positions": lambda p: p.where("source_stream_id = 'stream-e1'")}, "NO_CURRENT_ENGAGEMENT"),
        ({"drop": "event_type <> 'finding_observation' or verification_key <> 'check-login-sqli'"}, "UNREPRESENTED_DETECTION"),
        ({"twice": True}, "REPEATED_FINDING"),
    ],
)
def test_a_refused_report_stops_its_job(log, case, code):
    refusals, folded = refused(log, **case)
    report = assertions.required(folded, refusals)
    if code is None:
        assert report.count() == 6 and refusals.isEmpty()
        return
    assert code in {r["code"] for r in refusals.collect()}
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        report.count()


def test_stream_without_marker_is_refused(log):
    refusals, _ = refused(log.where("not (event_type = 'engagement_completed' and engagement_id = 'engagement-1')"))
    assert {r["code"] for r in refusals.collect()} == {"NOT_FINALIZED"}


def test_exactly_one_and_lost_facts(spark, log):
    data, _ = journal.data_and_markers(log)
    facts = boundary.select_facts(data, data.groupBy("tenant_id", "source_stream_id").agg(F.max("source_sequence").alias("last_data_sequence")))
    assert assertions.lost_facts(facts, facts).isEmpty()
    some = facts.where("source_event_id <> 'e2-new'").unionByName(facts.where("source_event_id = 'e1-still'"))
    assert sorted(r["detail"].split("|")[1] for r in assertions.lost_facts(facts, some).collect()) == ["e1-still", "e2-new"]


def manifest(spark, tmp_path, change):
    fixture.write(tmp_path)
    m = json.loads((tmp_path / "manifest.json").read_text())
    change(m)
    (tmp_path / "m.json").write_text(json.dumps(m))
    return bundle.read_manifest(spark, str(tmp_path / "m.json"))


@pytest.mark.parametrize(
    "change, found",
    [
        (lambda m: None, set()),
        (lambda m: m.update(action_budget=0), {("BUDGET", "0")}),
        (lambda m: m["candidates"].append(m["candidates"][0] | {"action_event_ids": ["e2-asset"]}), {("DUPLICATE_CANDIDATE", "T-A")}),
        (lambda m: m["candidates"][0].update(candidate_id="T-X"), {("UNEXPECTED_CANDIDATE", "T-X"), ("MISSING_CANDIDATE", "T-A")}),
        (lambda m: m["candidates"][0]["frozen_outcome"].update(execution_status=None), {("NO_OUTCOME", "T-A")}),
        (lambda m: m["candidates"][1].update(action_event_ids=[]), {("NO_ACTIONS", "T-B")}),
        (lambda m: m["candidates"][1].update(action_event_ids=["e9"]), {("UNKNOWN_ACTION", "e9")}),
        (lambda m: m["candidates"][1].update(action_event_ids=["e2-still"]), {("REUSED_ACTION", "e2-still")}),
        (lambda m: m["background"].append({"event_id": "e9", "scenario_label": "x"}), {("UNKNOWN_BACKGROUND", "e9")}),
        (lambda m: m["background"].append(m["background"][0]), {("DUPLICATE_BACKGROUND", "e2-incon-partial")}),
        (lambda m: m["background"].append({"event_id": "e2-still", "scenario_label": "x"}), {("ACTION_AND_BACKGROUND", "e2-still")}),
    ],
)
def test_manifest_rules(spark, tmp_path, log, change, found):
    got = bundle_rules.manifest_violations(manifest(spark, tmp_path, change), log, ["T-A", "T-B", "T-C"])
    assert {r[:] for r in got.collect()} == found


def test_event_rules(spark):
    rows = [("a", "s", 1, "{}"), ("a", "s", 2, "{}"), ("b", "s", 2, "{}"), ("c", "s", 3, '{"dns":"for-T-B"}'), ("d", "t", 3, None)]
    got = bundle_rules.event_violations(spark.createDataFrame(rows, "source_event_id string, source_stream_id string, source_sequence long, payload string"))
    assert {r[:] for r in got.collect()} == {("DUPLICATE_EVENT", "a"), ("DUPLICATE_POSITION", "s#2"), ("RUNNER_TOKEN", "c")}


KEYS = {"engagements": ["tenant_id", "engagement_id"], "source_events": ["tenant_id", "source_event_id"], "assets": ["tenant_id", "canonical_asset_id"], "asset_observations": ["tenant_id", "source_event_id"], "findings": ["tenant_id", "finding_id"], "finding_occurrences": ["tenant_id", "source_event_id"], "test_attempts": ["tenant_id", "source_event_id"]}
ONCE = {"engagements": ["last_data_sequence"]}


def counts(spark, root):
    return {n: df.count() for n, df in commit.read_set(spark, root).items()}


def test_seven_tables_commit_together(spark, tmp_path, tables):
    root = str(tmp_path / "set")
    commit.insert(spark, root, tables, KEYS, ONCE)
    want = {n: df.count() for n, df in tables.items()}
    assert counts(spark, root) == want
    stored = commit.read_set(spark, root)
    for n, df in tables.items():
        assert stored[n].columns == df.columns
        a, b = (multiset.multiset_digest(x, [], df.columns).first() for x in (df, stored[n]))
        assert a == b
    commit.insert(spark, root, tables, KEYS, ONCE)
    assert counts(spark, root) == want

    boom = F.udf(lambda x: 1 // 0, "string")
    late = tables["test_attempts"].withColumn("source_event_id", F.concat(F.lit("new-"), F.col("source_event_id")))
    failing = tables | {"source_events": tables["source_events"].withColumn("source_event_id", F.concat(F.lit("new-"), F.col("source_event_id"))), "test_attempts": late.withColumn("check_version", boom("check_version"))}
    with pytest.raises(Exception):
        commit.insert(spark, root, failing, KEYS, ONCE)
    assert counts(spark, root) == want and len(os.listdir(f"{root}/commits")) == 2

    with pytest.raises(Exception, match="WRITTEN_ONCE"):
        commit.insert(spark, root, {"engagements": tables["engagements"].withColumn("last_data_sequence", F.lit(3).cast("long"))}, KEYS, ONCE)
    with pytest.raises(Exception, match="AMBIGUOUS_KEY"):
        commit.insert(spark, root, {"assets": tables["assets"].withColumn("canonical_asset_id", F.lit("z")).unionByName(tables["assets"].withColumns({"canonical_asset_id": F.lit("z"), "cluster_id": F.lit("q")}))}, KEYS)
    assert counts(spark, root) == want


def test_a_version_is_committed_once(tmp_path):
    writer = commit.TableSetWriter(str(tmp_path), {"a": ["x"]}, 1)
    writer.commit([commit.Written([])])
    with pytest.raises(RuntimeError):
        commit.TableSetWriter(str(tmp_path), {"a": ["x"]}, 1).commit([])
