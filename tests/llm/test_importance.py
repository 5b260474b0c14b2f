"""Importance resampling against a plain computation of both models, with odd rows and without targets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import importance
from factloom.llm.shared import ascii_lower, mix, span_hashes
from test_operators import ODD, text


def grams(t, buckets):
    """Buckets of the words and of the pairs of neighbouring words of one text."""
    raw = ascii_lower((t or "").encode())
    h = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in raw.split()]

    def joined(a, b):
        x = np.zeros(1, np.uint64)
        for w in (a, b):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + np.array([w], np.uint64))
        return int(x[0])

    return [x % buckets for x in h] + [joined(a, b) % buckets for a, b in zip(h, h[1:])]


@pytest.mark.parametrize("targets", [list(range(0, 40, 2)), []])
def test_weights_are_those_of_a_plain_computation(spark, targets):
    rng = np.random.default_rng(3)
    rows = [(i, text(rng, int(rng.integers(1, 60)))) for i in range(40)] + [(50 + i, t) for i, t in enumerate(ODD)] + [(0, "another text of a target"), (None, "no id"), (None, "no id either")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("TEXT_", F.lit("x"))
    labels = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "doc_id long")
    got = importance.resample(docs, labels, share=0.5, buckets=997).collect()
    raw, good = np.ones(997), np.ones(997)
    for i, t in rows:
        for g in grams(t, 997):
            raw[g] += 1
            good[g] += i in targets
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum()) if targets else np.zeros(997)
    want = sorted((str(i), round(float(sum(ratio[g] for g in grams(t, 997))), 6), round(float(np.mean([ratio[g] for g in grams(t, 997)] or [0.0])), 8)) for i, t in rows)
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6), round(r["log_ratio"], 8)) for r in got) == want
    k = math.ceil(0.5 * len(got))
    bar = sorted((r["key"] for r in got), reverse=True)[k - 1]
    assert all(r["selected"] == (r["key"] >= bar) for r in got)
    assert len({r["key"] for r in got if r["doc_id"] is None}) == 2


def test_the_bound_on_targets_holds(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} common") for i in range(100)], "doc_id long, text string")
    got = importance.resample(docs, docs.where("doc_id % 2 = 0"), most_targets=10, buckets=97)
    even, odd = (got.where(f"doc_id % 2 = {k}").select("log_ratio").distinct().collect() for k in (0, 1))
    # Ten targets of two words and a pair each, with add-one smoothing over 97 buckets.
    want = (2 * math.log(11 / 127 / (51 / 397)) + math.log(11 / 127 / (101 / 397))) / 3
    assert len(even) == len(odd) == 1 and abs(even[0][0] - want) < 1e-9 and odd[0][0] < even[0][0]
