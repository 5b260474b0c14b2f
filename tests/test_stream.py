"""The streaming inbox: several batches, a restart in the middle, streams that two tenants claim, markers, and state by entry."""

import random

import pandas as pd

from factloom.streaming import inbox
from factloom.streaming.inbox import Inbox

SCHEMA = inbox.GIVEN
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def log(seed, n):
    rng, rows = random.Random(seed), []
    for arrival in range(n):
        limit = rng.randint(3, 8) if rng.random() < 0.05 else None
        stream = rng.randint(1, 8)
        tenant = stream % 3 if rng.random() < 0.9 else rng.randint(0, 2)
        place = limit + 1 if limit else rng.randint(1, 10)
        rows.append((f"t{tenant}", f"e{stream}", f"s{stream}", place, f"id{rng.randint(1, 60)}", arrival, rng.choice("xxxy"), limit))
    return rows


def expected(rows):
    """One delivery at a time; a stream belongs to who delivers to it first."""
    box, owners, out = Inbox(), {}, {}
    for r in pd.DataFrame(rows, columns=COLUMNS).astype(object).itertuples(index=False):
        owner = owners.setdefault(r.source_stream_id, (r.tenant_id, r.engagement_id))
        out[r.arrival] = inbox.judge(box, r, owner != (r.tenant_id, r.engagement_id))
    return out


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, tmp_path):
    """What is new since the checkpoint; returns the progress of the batches."""
    found = inbox.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"]]


def test_batches_restart_and_state(spark, tmp_path):
    rows, folder = log(3, 240), str(tmp_path / "in")
    add(spark, folder, rows[:120])
    run(spark, folder, tmp_path)
    add(spark, folder, rows[120:230])
    run(spark, folder, tmp_path)
    add(spark, folder, rows[230:])
    progress = run(spark, folder, tmp_path)
    got = {r["arrival"]: (r["decision"], r["reject_reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = expected(rows)
    assert got == want
    assert {"ENGAGEMENT_BINDING", "STREAM_OWNERSHIP", "EVENT_CONTENT", "STREAM_POSITION", "COMPLETION", None} >= {r for _, r in want.values()}
    assert len({r for _, r in want.values()}) >= 5 and sum(d == "ACCEPTED" for d, _ in want.values()) > 20
    # The last batch writes at most four entries for each delivery that it accepts, whatever the state holds.
    taken = sum(want[a][0] == "ACCEPTED" for a in range(230, 240))
    states = progress[-1]["stateOperators"]
    assert sum(s["numRowsUpdated"] for s in states) <= 4 * taken + 2 * len({r[2] for r in rows[230:]})
    assert sum(s["numRowsTotal"] for s in states) > 40


def test_streams_have_one_owner_over_all_tenants(spark, tmp_path):
    rows = [("t0", "e", "s", 1, "a", 0, "x", None), ("t1", "e", "s", 2, "b", 1, "x", None), ("t0", "e", "s", 2, "b", 2, "x", None)]
    add(spark, str(tmp_path / "in"), rows)
    run(spark, str(tmp_path / "in"), tmp_path)
    got = [r[:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("arrival").select("tenant_id", "decision", "reject_reason").collect()]
    assert got == [("t0", "ACCEPTED", None), ("t1", "REJECTED", "STREAM_OWNERSHIP"), ("t0", "ACCEPTED", None)]
