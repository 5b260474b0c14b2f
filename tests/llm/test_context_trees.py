"""Context-tree weighting against a plain recursive one, bit by bit."""

import math
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lm
from test_operators import low


def contexts(raw, depth):
    """(context bytes, nearest first; byte) for each byte of a text and its end."""
    data = [lm.END] * depth + list(raw) + [lm.END]
    return [(tuple(data[i - 1 - d] for d in range(depth)), data[i]) for i in range(depth, len(data))]


def plain(train, depth):
    """A function from (context, byte) to log10 of its probability, by the definition of the weighted trees."""
    seen = {}
    for raw in train:
        for context, byte in contexts(raw, depth):
            for k in range(8):
                for d in range(depth + 1):
                    node = seen.setdefault((k, byte >> (8 - k), context[:d]), [0, 0])
                    node[byte >> (7 - k) & 1] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    @cache
    def parts(k, prefix, context):
        """log of a node's own estimate and of the product of its children."""
        own = kt(seen[k, prefix, context])
        if len(context) == depth:
            return own, None
        return own, sum(weighted(k, prefix, (*context, c)) for c in range(256) if (k, prefix, (*context, c)) in seen)

    @cache
    def weighted(k, prefix, context):
        own, children = parts(k, prefix, context)
        return own if children is None else math.log(0.5) + np.logaddexp(own, children)

    def one(k, prefix, context):
        if (k, prefix, context) not in seen:
            return 0.5
        zeros, ones = seen[k, prefix, context]
        mine = (ones + 0.5) / (zeros + ones + 1)
        if len(context) == depth:
            return mine
        own, children = parts(k, prefix, context)
        share = 1 / (1 + math.exp(min(700, max(-700, children - own))))
        return share * mine + (1 - share) * one_below(k, prefix, context)

    full = [None]

    def one_below(k, prefix, context):
        return one(k, prefix, full[0][: len(context) + 1])

    def log10(context, byte):
        full[0] = context
        total = 0.0
        for k in range(8):
            p = one(k, byte >> (8 - k), ())
            total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total

    return log10


@pytest.mark.parametrize("depth", [2, 3])
def test_scores_are_those_of_plain_trees(spark, depth):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("aabbc dé\x00"), int(rng.integers(0, 40))))) for i in range(30)] + [(40, "ABBA abba"), (41, ""), (42, None), (43, "unseen ÿ 日本")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 3 != 0, depth=depth, chunk_bytes=100, chunks_together=2).collect()}
    log10 = plain([low(t).encode() for i, t in rows if i % 3], depth)
    for i, t in rows:
        want = sum(log10(*x) for x in contexts(low(t).encode(), depth))
        assert abs(got[i]["score"] - want) < 1e-6 * max(1, abs(want)), i


def test_no_training_row(spark):
    got = lm.score(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert all(abs(r["bits_per_byte"] - 8) < 1e-9 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got) and len(got) == 2


def test_levels_give_a_distribution():
    keys, counts = lm.summed(np.random.default_rng(3).choice([0x616263, 0x616264, 0x626162, 0xFFFF61], 500).astype(np.uint32), np.ones(500, np.int64))
    trees = lm.ContextTrees(2)
    trees.build(keys, counts, 0)
    for context in (0x6162, 0x7A7A, 0xFFFF):
        assert abs((10 ** trees.log10(np.uint32(context << 8) + np.arange(256, dtype=np.uint32))).sum() - 1) < 1e-9
