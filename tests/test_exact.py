"""The set-based inbox against the sequential one, over many random logs at once, and on the shapes that need chains."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import exact, matching
from factloom.sources.staging import Staging
from factloom.streaming.inbox import Inbox, replay

SCHEMA = "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, arrival long, content string, last_data_sequence long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def sequential(rows):
    """By log, which the first part of a stream's name tells."""
    out = []
    df = pd.DataFrame(rows, columns=COLUMNS)
    df["last_data_sequence"] = df["last_data_sequence"].astype("Int64").astype(object).where(df["last_data_sequence"].notna(), None)
    for _, log in df.groupby(df["source_stream_id"].str.split("/").str[0]):
        inbox = Inbox()
        for r in log.sort_values("arrival").itertuples(index=False):
            out.append((r.source_stream_id, r.arrival, *inbox.step(r)))
    return sorted(map(str, out))


def as_sets(spark, rows):
    got = replay(spark.createDataFrame(rows, SCHEMA)).select("source_stream_id", "arrival", "decision", "reject_reason").collect()
    return sorted(str(tuple(r)) for r in got)


def random_log(rng, name, markers):
    """Few tenants, engagements, streams, ids and positions, so that everything collides and rejections chain."""
    n, rows = rng.randint(2, 14), []
    tenants, streams = rng.randint(1, 3), rng.randint(1, 4)
    for arrival in range(n):
        place = rng.randint(1, 5)
        limit = rng.randint(1, 4) if markers and rng.random() < 0.25 else None
        if limit is not None and rng.random() < 0.8:
            place = limit + 1
        rows.append((f"{name}/t{rng.randint(1, tenants)}", f"e{rng.randint(1, 2)}", f"{name}/s{rng.randint(1, streams)}", place, f"id{rng.randint(1, 6)}", arrival, rng.choice("xxy"), limit))
    return rows


@pytest.mark.parametrize("markers", [False, True])
def test_random_logs(spark, markers):
    rng = random.Random(5 + markers)
    rows = [r for i in range(5_000) for r in random_log(rng, f"log{i}", markers)]
    got, want = as_sets(spark, rows), sequential(rows)
    wrong = [x for x in zip(got, want) if x[0] != x[1]]
    assert not wrong, wrong[:5]


def test_tenants_in_a_path_share_streams(spark):
    """Tenants join streams s1-s5, s5-s4, s4-s3, s3-s2; the one with s2 and s3 delivers an id with two contents."""
    rows, at = [], iter(range(100))
    for t, pair in enumerate([(1, 5), (5, 4), (4, 3)]):
        rows += [(f"l/t{t}", f"e{s}", f"l/s{s}", 10 + t, f"i{t}{s}", next(at), "x", None) for s in pair]
    rows += [("l/t9", "e3", "l/s3", 1, "same", next(at), "x", None), ("l/t9", "e2", "l/s2", 1, "same", next(at), "y", None), ("l/t9", "e2", "l/s2", 1, "same", next(at), "z", None)]
    got = as_sets(spark, rows)
    assert got == sequential(rows)
    assert sum("EVENT_CONTENT" in x for x in got) == 1


def test_chains_of_rejections(spark):
    """Each delivery takes what the next one needs, so that every other one is accepted, over many links."""
    rows = [("c/t", "e", "c/s", 1 + i // 2, f"id{(i + 1) // 2}", i, "x", None) for i in range(61)]
    got = as_sets(spark, rows)
    assert got == sequential(rows)
    assert sum("ACCEPTED" in x for x in got) == 31


def test_one_delivery_may_hold_most_rows(spark):
    rows = [("h/t", "e", "h/s", 1, "hot", i, "x", None) for i in range(3000)] + [("h/t", "e", "h/s", 1 + i % 50, f"id{i}", 5000 + i, "x", None) for i in range(300)]
    assert as_sets(spark, rows) == sequential(rows)


def test_nothing(spark):
    assert as_sets(spark, []) == []


def test_no_python_while_nothing_chains(spark):
    """One tenant's log has all shuffle partitions at work: no group by tenant, no Python."""
    rows = [("p/t", "e", "p/s", i + 1, f"id{i}", i, "x", None) for i in range(100)]
    plan = replay(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.format_string("n%03d", "id").alias("u"), F.format_string("n%03d", F.col("id") + 1).alias("v"))
    found = matching.components(Staging(spark, "test"), edges)
    assert found.count() == 301 and {r["root"] for r in found.select("root").distinct().collect()} == {"n000"}




def test_first_beyond_a_limit_in_frames_that_only_grow(spark):
    """When a position above a marker's limit is first taken, over several buckets; no frame is gone through anew for each row."""
    rng = random.Random(3)
    taken = [(f"s{i % 2}", rng.randint(1, 3 << exact.BUCKET), (rng.randint(1, 10**6), i)) for i in range(400)]
    limits = [(s, p) for s in ("s0", "s1") for p in (0, 1, 1 << exact.BUCKET, taken[0][1], taken[1][1], 4 << exact.BUCKET)]
    accepted = spark.createDataFrame(taken, "source_stream_id string, source_sequence long, at struct<arrival:long,tie:long>")
    found = exact._highs(accepted, spark.createDataFrame(limits, "source_stream_id string, last_data_sequence long"))
    want = {(s, p): min((at for t, place, at in taken if t == s and place > p), default=None) for s, p in limits}
    assert {(r[0], r[1]): r[2] and tuple(r[2]) for r in found.collect()} == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
