"""Fold against a sequential restatement, replay against windows, bundles and atomic table sets."""

import json
import random

import pytest

from factloom.operators import ingest, posture
from factloom.sources import bundle
from factloom.sources.adapter import deliveries, event_log
from factloom.streaming import inbox

DATA = "/root/testdata/sf0.001"


def sequential(history):
    """history: (kind, is_current) in order."""
    exposure, flags, last, first_current, seen = None, set(), None, False, False
    for kind, current in history:
        if kind == "O":
            if not seen:
                first_current = current
            elif current:
                flags.add("R" if exposure == "VERIFIED_RESOLVED" else "S")
            seen, exposure = True, "OPEN"
            last = "DETECTED" if current else last
        elif kind == "N":
            if exposure == "OPEN":
                exposure = "VERIFIED_RESOLVED"
            if current and exposure == "VERIFIED_RESOLVED":
                flags.add("V")
            last = "NOT_DETECTED" if current else last
        elif kind == "I" and current:
            flags.add("I")
    order = [("R", "REGRESSED"), ("V", "VERIFIED_RESOLVED"), ("S", "STILL_OPEN"), ("I", "INCONCLUSIVE")]
    name = "NEW" if first_current else next((n for f, n in order if f in flags), "NOT_RETESTED")
    return name, last or ("INCONCLUSIVE" if "I" in flags else "NOT_RETESTED"), exposure


def test_fold_is_the_sequential_one(spark):
    rnd, rows, want = random.Random(7), [], {}
    outcome = {"N": ("completed", "not_detected"), "D": ("completed", "detected"), "I": ("partial", None), "O": (None, None)}
    for f in range(400):
        kinds = [rnd.choice("ONDI") for _ in range(rnd.randint(1, 8))]
        kinds[rnd.randrange(len(kinds))] = "O"
        history = [(k, rnd.random() < 0.5) for k in kinds]
        want[f"u{f}"] = sequential(history)
        for i, (k, current) in enumerate(history):
            rows.append(("t", "now" if current else "then", "s", i, f"{f}-{i:02d}", i, "c", "Deployment", f"u{f}", "k", "v" if k == "O" else None, "l" if k == "O" else None, "1", "00", 1, *outcome[k], "finding_occurrence" if k == "O" else "test_attempt"))
    rnd.shuffle(rows)
    names = "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, occurred_at long, cluster_id string, resource_kind string, resource_uid string, verification_key string, vuln_class string, location string, check_version string, relevant_context_hash string, compatibility_policy_version int, execution_status string, result string, fact_kind string"
    got = posture.fold(spark.createDataFrame(rows, names), "now").collect()
    assert {r["resource_uid"]: (r["classification"], r["assessment"], r["exposure"]) for r in got} == want


def test_replay_agrees_with_windows(spark):
    d = deliveries(event_log(spark, DATA))
    a = {(r["source_event_id"], r["arrival"]): (r["decision"], r["reject_reason"]) for r in ingest.decide(d).collect()}
    b = {(r["source_event_id"], r["arrival"]): (r["decision"], r["reject_reason"]) for r in inbox.replay(d).collect()}
    assert a == b


def test_stream_finalizes_and_rejects_late(spark):
    rows = [("t", "e", "s", 1, "a", 1, "x", None), ("t", "e", "s", 3, "m", 2, "x", 2), ("t", "e", "s", 2, "b", 3, "x", None), ("t", "e", "s", 4, "c", 4, "x", None), ("t", "e", "s", 1, "a", 5, "x", None)]
    d = spark.createDataFrame(rows, "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, arrival long, content string, last_data_sequence long")
    got = [(r["decision"], r["reject_reason"]) for r in inbox.replay(d).orderBy("arrival").collect()]
    assert got == [("ACCEPTED", None)] * 3 + [("REJECTED", "COMPLETION"), ("NO_OP", None)]


def test_streaming_inbox(spark, tmp_path):
    d = deliveries(event_log(spark, DATA)).where("tenant_id = 'tenant-1'").limit(300)
    d.write.parquet(str(tmp_path / "in"))
    want = {(r["source_event_id"], r["arrival"]): r["decision"] for r in inbox.replay(spark.read.parquet(str(tmp_path / "in"))).collect()}
    q = inbox.start(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["source_event_id"], r["arrival"]): r["decision"] for r in spark.sql("select * from inbox").collect()} == want


def test_bundle_and_manifest(spark, tmp_path):
    event = {"source_event_id": "e1", "event_type": "engagement_completed", "source_stream_id": "s", "source_sequence": 2, "schema_version": 1, "occurred_at": "2026-01-01T00:00:00Z", "payload": {"last_data_sequence": 1}}
    (tmp_path / "set.json").write_text(json.dumps({"trusted_context": {"tenant_id": "t", "engagement_id": "e"}, "events": [event, event | {"x": 1}]}))
    got = bundle.read_event_set(spark, str(tmp_path / "set.json")).orderBy("arrival").collect()
    assert [r["reject_reason"] for r in got] == [None, "ENVELOPE_UNKNOWN_FIELD"] and got[0]["tenant_id"] == "t"
    target = {"cluster_id": "c", "resource_kind": "Deployment", "resource_uid": "u"}
    (tmp_path / "m.json").write_text(json.dumps({"action_budget": 3, "candidates": [{"candidate_id": "A", "scenario_label": "secret", "target": target, "verification_key": "k", "action_event_ids": ["e1"], "frozen_outcome": {"execution_status": "completed", "result": "detected"}}], "background": []}))
    view = bundle.planner_view(bundle.read_manifest(spark, str(tmp_path / "m.json")))
    assert set(view.columns) == {"action_budget", "candidate_id", "cluster_id", "resource_kind", "resource_uid", "verification_key"} and view.count() == 1


def test_write_all_shows_complete_versions_only(spark, tmp_path):
    version = bundle.write_all({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path))
    assert {n: t.count() for n, t in bundle.read_all(spark, version).items()} == {"a": 3, "b": 2}
    spark.range(1).write.parquet(str(tmp_path / "half/a"))
    with pytest.raises(Exception):
        bundle.read_all(spark, str(tmp_path / "half"))


def test_inbox_rules_in_order(spark):
    """Bindings across streams, ids across streams, chains of rejections."""
    rows = [
        ("t", "e", "s1", 1, "a", 1, "x", "ACCEPTED", None),
        ("t", "e", "s2", 1, "b", 2, "x", "REJECTED", "ENGAGEMENT_BINDING"),
        ("t", "f", "s2", 1, "b", 3, "x", "ACCEPTED", None),
        ("u", "g", "s2", 2, "c", 4, "x", "REJECTED", "STREAM_OWNERSHIP"),
        ("u", "g", "s3", 2, "c", 5, "x", "ACCEPTED", None),
        ("t", "f", "s2", 2, "a", 6, "x", "REJECTED", "EVENT_CONTENT"),
        ("t", "f", "s2", 1, "d", 7, "x", "REJECTED", "STREAM_POSITION"),
        ("t", "f", "s2", 2, "d", 8, "x", "ACCEPTED", None),
        ("t", "f", "s2", 2, "d", 9, "x", "NO_OP", None),
        ("t", "f", "s2", 2, "d", 10, "y", "REJECTED", "EVENT_CONTENT"),
        ("v", "h", "s9", 1, "a", 11, "x", "ACCEPTED", None),
    ]
    d = spark.createDataFrame(rows, "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, arrival long, content string, decision string, reject_reason string")
    got = inbox.replay(d.drop("decision", "reject_reason")).orderBy("arrival").collect()
    assert [(r["decision"], r["reject_reason"]) for r in got] == [r[7:] for r in rows]


def test_inbox_takes_linear_time():
    import time
    from types import SimpleNamespace

    box, began = inbox.Inbox(), time.perf_counter()
    for i in range(1, 40_001):
        assert box.step(SimpleNamespace(tenant_id="t", engagement_id="e", source_stream_id="s", source_sequence=i, source_event_id=f"e{i}", content="x", last_data_sequence=None))[0] == "ACCEPTED"
    assert time.perf_counter() - began < 5


def test_gaps_by_bucket(spark):
    rows = [("t", "s", i) for i in range(1, 60) if i not in (1, 17, 18, 30)] + [("t", "r", i) for i in range(1, 9)]
    got = ingest.gaps(spark.createDataFrame(rows, "tenant_id string, source_stream_id string, source_sequence long"), bucket=8).collect()
    assert [r[:] for r in got] == [("t", "s", 1, 4)]
