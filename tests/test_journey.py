"""From JSON files to reports and arms: the expected facts of the experiment, golden digests, and what must be refused."""

import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import fixture
from factloom.functions import canonical
from factloom.operators import arms, boundary, identity, ingest, journal, planning, posture, reporting
from factloom.sources import bundle


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("bundle")
    fixture.write(d)
    return d


@pytest.fixture(scope="module")
def given(spark, folder):
    decoded = bundle.read_event_set(spark, str(folder / "sets"))
    assert decoded.where("reject_reason is not null").isEmpty()
    # Files arrive one after the other.
    return journal.deliveries(decoded.withColumn("arrival", F.col("arrival") + F.when(F.col("engagement_id") == "engagement-2", 100).otherwise(0))).cache()


@pytest.fixture(scope="module")
def log(given):
    return journal.accepted_log(given, journal.decisions(given)).cache()


def heads(facts, positions, current):
    digest = reporting.fact_digest(facts.where(F.col("engagement_id") == current), "tenant_id").select("tenant_id", F.col("fact_digest").alias("current_engagement_fact_digest"))
    hashes = positions.groupBy("tenant_id").agg(canonical.boundary_digest(F.collect_list(F.struct("source_stream_id", "last_data_sequence"))).alias("knowledge_boundary_hash"))
    return digest.join(hashes, "tenant_id").withColumn("current_engagement_id", F.lit(current))


def test_everything_is_accepted_and_finalized(given, log):
    assert journal.decisions(given).where("decision = 'ACCEPTED'").count() == 18
    data, markers = journal.data_and_markers(log)
    assert {r["engagement_id"]: r["last_data_sequence"] for r in ingest.finalize(data, markers).collect()} == {"engagement-1": 7, "engagement-2": 9}
    assert identity.assets(data).count() == 1 and data.where("event_type = 'asset_observation'").count() == 3
    assert data.where("event_type = 'finding_observation'").count() == 8 and data.where("event_type = 'test_attempt'").count() == 5


def test_classes_and_digests(log):
    data, markers = journal.data_and_markers(log)
    positions = ingest.finalize(data, markers)
    facts = boundary.guarded_facts(data, positions, ingest.finalize(data, markers))
    after = posture.fold(facts, "engagement-2")
    got = {r["verification_key"]: (r["classification"], r["assessment"], r["exposure"]) for r in after.collect()}
    assert got == {
        "check-login-sqli": ("STILL_OPEN", "DETECTED", "OPEN"),
        "check-search-xss": ("VERIFIED_RESOLVED", "NOT_DETECTED", "VERIFIED_RESOLVED"),
        "check-admin-authz": ("REGRESSED", "DETECTED", "OPEN"),
        "check-upload-rce": ("NOT_RETESTED", "NOT_RETESTED", "OPEN"),
        "check-api-ssrf": ("INCONCLUSIVE", "INCONCLUSIVE", "OPEN"),
        "check-report-idor": ("NEW", "DETECTED", "OPEN"),
    }
    report = reporting.memory_report(heads(facts, positions, "engagement-2"), after).first()
    assert report["digest"] == "2e32504e7b95dae5601e197de9db6062776713975f6c2dfb354fc70c98c2e800"
    head = heads(facts, positions, "engagement-2").first()
    assert head["knowledge_boundary_hash"] == "69351b2fa8a942587ed7b17bbcf29ca524acbd5b6dee75dce056da94ad6a8634"
    assert head["current_engagement_fact_digest"] == "d53c1f4f19a8e30a2938c772832f25d351956fe31e6d3b56951fd295dfb840a5"
    own = positions.where("engagement_id = 'engagement-2'")
    alone = boundary.select_facts(data, own)
    stateless = reporting.stateless_report(heads(alone, own, "engagement-2"), alone, positions.where("false").select("tenant_id")).first()
    assert stateless["digest"] == "1d021dc071a244d5443a12df04acc5ae732b9e57ee5c7f9ac44b2a2a26ed3cd0"
    assert '"detected":3,"not_detected":1,"partial":1' in stateless["json"]


def test_what_is_rejected_reaches_no_posture(spark):
    """A finding with another baseline, a weak observation of nothing known, and a delivery that takes a rejected one's place."""
    one, two = fixture.experiment()
    drift = json.loads(json.dumps(two[1]))
    drift["payload"]["check_version"] = "2.0.0"
    weak = json.loads(json.dumps(two[8]))
    weak["payload"]["dns"] = "elsewhere"
    second = json.loads(json.dumps(two[1])) | {"source_event_id": "e2-other"}  # the place of the drift is free
    rows = [("tenant-acme", "engagement-1", i, json.dumps(e)) for i, e in enumerate(one)]
    rows += [("tenant-acme", "engagement-2", 100 + i, json.dumps(e)) for i, e in enumerate([two[0], drift, second, weak, two[8], two[8]])]
    given = journal.deliveries(canonical.decode_events(spark.createDataFrame(rows, "tenant_id string, engagement_id string, arrival long, json string")))
    decided = journal.decisions(given)
    got = [(r["decision"], r["reject_reason"]) for r in decided.where("arrival >= 100").orderBy("arrival").collect()]
    assert got == [("ACCEPTED", None), ("REJECTED", "FINDING_BASELINE_CONFLICT"), ("ACCEPTED", None), ("REJECTED", "UNSUPPORTED_IDENTITY"), ("ACCEPTED", None), ("NO_OP", None)]
    log = journal.accepted_log(given, decided)
    assert log.where("check_version = '2.0.0'").isEmpty()


def mine():
    return F.col("tenant_id").startswith(arms.MEMORY)


def shorter(df, lost):
    """Without an event of the memory arm, whose marker is one lower."""
    marker = F.col("event_type") == "engagement_completed"
    at = df.where(mine() & marker)
    limit = F.col("last_data_sequence") - 1
    return df.where(~(mine() & (marker | (F.col("source_event_id") == lost)))).unionByName(at.withColumns({"last_data_sequence": limit, "source_sequence": limit + 1}))


def with_value(name, event, value):
    return lambda df: df.withColumn(name, F.when(mine() & (F.col("source_event_id") == event), value()).otherwise(F.col(name)))


#: What is done to the memory arm's snapshot or later log, and the check that must fail for it. Each is a tenant of its own.
ALTERED = {
    "same_fact_digest": ("later", with_value("occurred_at", "e2-new", lambda: F.col("occurred_at") + F.expr("interval 1 second"))),
    "same_input_digest": ("later", with_value("canonical_source_hash", "e2-still", lambda: F.lit("0"))),
    "same_report_digest": ("later", with_value("result", "e2-fixed-neg", lambda: F.lit("detected"))),
    "same_earlier_fact_digest": ("early", with_value("occurred_at", "e1-still", lambda: F.col("occurred_at") + F.expr("interval 1 second"))),
    "same_boundary_hash": ("early", lambda df: shorter(df, "e1-regress-neg")),
    "both_began_empty": ("early", lambda df: df),
}


@pytest.fixture(scope="module")
def compared(spark, folder):
    """One run of both arms over all cases."""
    cases = ["plain", *ALTERED]
    decoded = bundle.read_event_set(spark, str(folder / "sets")).withColumn("tenant_id", F.explode(F.array(*map(F.lit, cases))))
    decoded = decoded.withColumn("source_stream_id", F.concat_ws("-", "tenant_id", "source_stream_id")).withColumn("arrival", F.col("arrival") + F.when(F.col("engagement_id") == "engagement-2", 100).otherwise(0))
    both = arms.both_arms(journal.deliveries(decoded)).drop("mode").cache()
    early, later = [], []
    for case in cases:
        own = both.where(F.col("tenant_id").endswith(f"/{case}"))
        a, b = own.where("engagement_id = 'engagement-1'"), own.where("engagement_id = 'engagement-2'")
        side, change = ALTERED.get(case, ("", None))
        early.append(change(a) if side == "early" else a)
        later.append(change(b) if side == "later" else b)
        if case == "both_began_empty":
            early.append(b.where(mine() & (F.col("source_event_id") == "e2-asset")))
    m = bundle.read_manifest(spark, str(folder / "manifest.json"))
    assert m.first()["reject_reason"] is None
    flat = m.select(F.explode("candidates").alias("c")).select(F.explode(F.array(*map(F.lit, cases))).alias("tenant_id"), "c.candidate_id", "c.target.*", "c.verification_key", "c.action_event_ids")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    evidence, planned = arms.run(union(early), union(later), arms.both_arms(flat).drop("mode"), "engagement-1", "engagement-2", 3)
    return {r["tenant_id"]: r.asDict() for r in arms.compare(evidence, planned).collect()}, planned.where("tenant_id = 'plain'").orderBy("position").collect()


def test_arms_run_and_compare(compared):
    got, planned = compared[0]["plain"], compared[1]
    orders = {m: [r["candidate_id"] for r in planned if r["mode"] == m] for m in (arms.CONTROL, arms.MEMORY)}
    assert orders == {arms.CONTROL: ["T-A", "T-B", "T-C"], arms.MEMORY: ["T-C", "T-A", "T-B"]}
    assert (got["control_metric"], got["memory_metric"]) == (3, 1)
    assert got["comparable"] and got["order_differs"] and all(v for n, v in got.items() if n.startswith("same_"))


@pytest.mark.parametrize("check", sorted(ALTERED))
def test_each_check_can_fail(compared, check):
    got = compared[0][check]
    assert got[check] is False and got["comparable"] is False


# --- readers --------------------------------------------------------------------------------------


def test_event_sets_keep_digits_and_go_on_after_bad_events(spark, tmp_path):
    one, _ = fixture.experiment()
    number = "0.1234567890123456789012345678901"
    rich = json.dumps(one[1]).replace('"is_address_bound": false', f'"is_address_bound": false, "parameters": {{"x": {number}, "big": 1180591620717411303424}}')
    twice = json.dumps(one[2])[:-1] + ', "schema_version": 1}'
    text = fixture.event_set([], 1).replace('"events": []', '"events": [' + ", ".join([rich, twice, '{"a": 01}', json.dumps(one[3])]) + "]")
    (tmp_path / "good.json").write_text(text)
    (tmp_path / "torn.json").write_text(fixture.event_set(one, 1)[:-1])
    (tmp_path / "twice.json").write_text('{"events": [], "events": [], "trusted_context": {"tenant_id": "t", "engagement_id": "e"}}')
    (tmp_path / "blank.json").write_text(fixture.event_set(one, 1, " "))
    (tmp_path / "more.json").write_text(fixture.event_set(one, 1)[:-1] + ', "x": 1}')
    got = {}
    for r in bundle.read_event_set(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["arrival"], r["reject_reason"], r["payload"]))
    assert {f: [x[1] for x in v] for f, v in got.items() if f != "good.json"} == {"torn.json": ["FILE_MALFORMED"], "twice.json": ["FILE_DUPLICATE_KEY"], "blank.json": ["FILE_TRUSTED_CONTEXT"], "more.json": ["FILE_EVENT_SET"]}
    good = sorted(got["good.json"])
    assert [x[1] for x in good] == [None, "DUPLICATE_KEY", "MALFORMED", None]
    assert number in good[0][2] and "1180591620717411303424" in good[0][2]


@pytest.mark.parametrize("text", ['{"a":1}}', '{"a":1,}', '{"a" 1}', '{,}', '[1 2]', '[1,,2]', '{"a":[1}', "[", "", '{"a', '["a"]]', "{1:2}"])
def test_members_of_broken_texts(text):
    with pytest.raises(canonical.Rejected):
        canonical.members(text, 0, len(text))


def test_members_are_cut_byte_for_byte():
    text = ' { "a" : [1, {"b": "]\\""}] , "c":-0.10e5,"d":{"}":{}}, "e":"x" } '
    assert [(k, text[b:e]) for k, b, e in canonical.members(text, 0, len(text))] == [("a", '[1, {"b": "]\\""}]'), ("c", "-0.10e5"), ("d", '{"}":{}}'), ("e", '"x"')]


def test_long_runs_of_escapes_take_one_pass(spark):
    import time

    texts = ['{"a":"' + '\\"' * 500_000, '"' * 1_000_000, '{"a":"' + "\\" * 1_000_000]
    began = time.perf_counter()
    for t in texts:
        with pytest.raises(canonical.Rejected):
            canonical.decode(t)
        assert bundle._cut_event_set(t)[0]["file_error"].startswith("FILE_")
    assert time.perf_counter() - began < 5


def test_manifests_are_strict(spark, folder, tmp_path):
    good = (folder / "manifest.json").read_text()
    for i, (text, code) in enumerate([(good, None), (good.replace('"scenario_label"', '"label"', 1), "MANIFEST_UNKNOWN_FIELD"), (good[:-1] + ', "x": 1}', "MANIFEST_UNKNOWN_FIELD"), (good[:-1] + ', "action_budget": 2}', "MANIFEST_DUPLICATE_KEY"), (good[:-1], "MANIFEST_MALFORMED")]):
        (tmp_path / f"{i}.json").write_text(text)
        row = bundle.read_manifest(spark, str(tmp_path / f"{i}.json")).first()
        assert row["reject_reason"] == code and (row["candidates"] is None) == (code is not None)


def test_events_that_a_codec_must_survive(spark):
    one, _ = fixture.experiment()
    change = lambda **k: json.dumps(one[1] | k)
    uid_alone = json.loads(json.dumps(one[0]))
    uid_alone["payload"] = {k: uid_alone["payload"][k] for k in ("cluster_id", "resource_kind", "resource_uid")}
    texts = [change(occurred_at="9999-12-31T23:59:59-01:00"), change(occurred_at="0001-01-01T00:00:00+01:00"), change(occurred_at="0002-01-01T00:00:00Z"), change(occurred_at="2026-01-01T00:00:00.٣Z"), change(occurred_at="2026-01-01T00:00:00Z\n"), '{"a":"' + '\\"' * 300_000, json.dumps(uid_alone), change(source_event_id=" ")]
    got = canonical.decode_events(spark.createDataFrame(list(enumerate(texts)), "n int, json string")).orderBy("n").collect()
    assert [r["reject_reason"] for r in got] == ["OCCURRED_AT", "OCCURRED_AT", None, "OCCURRED_AT", "OCCURRED_AT", "MALFORMED", "NO_SIGNAL", None]
    assert got[2]["occurred_at"] == "0002-01-01T00:00:00Z"


def test_controlled_inputs_name_the_tenant(spark):
    c = spark.createDataFrame([("memory-on/t", "A", "c", "D", "u", "k")], "tenant_id string, candidate_id string, cluster_id string, resource_kind string, resource_uid string, verification_key string")
    e = spark.createDataFrame([], "tenant_id string, role string, candidate_id string, source_event_id string, event_hash string")
    a = planning.controlled_input_digest(c, e, "e", 3, tenant=F.lit("t")).first()["digest"]
    assert a == planning.controlled_input_digest(c.withColumn("tenant_id", F.lit("t")), e, "e", 3).first()["digest"]
