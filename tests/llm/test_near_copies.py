"""The pipeline's stage of near-copies against brute-force Jaccard similarity."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import near_copies
from test_operators import low, split, text


def shingles(t):
    w = split(low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_distinct_is_brute_force_jaccard(spark):
    rng = np.random.default_rng(7)
    rows = [(i, text(rng, int(rng.integers(3, 200)))) for i in range(60)]
    for i, t in rows[:40]:
        # Near copies with some words changed: from 1.0 to well below 0.8.
        for j in range(3):
            w = t.split()
            for p in rng.choice(len(w), min(len(w), int(rng.integers(0, 2 + len(w) // 25))), replace=False):
                w[p] = "changed"
            rows.append((100 + 3 * i + j, " ".join(w)))
    rows += [(500, ""), (501, None), (5, "another text under the same id as an earlier one"), (None, rows[0][1]), (-3, rows[7][1].upper())]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if None not in (rows[i][0], rows[j][0]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            near += sets[i] != sets[j]
            root[find(j)] = find(i)
    assert near > 40
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(find(i), []).append((d, t))
    want = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.distinct(spark, docs.repartition(3, F.hash("text")), "").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((r["doc_id"] for r in got), key=lambda d: key((d,))) == sorted((d for d, _ in want), key=lambda d: key((d,)))


def test_long_lists_are_met_block_by_block(spark):
    """Blocks of a few rows lose none of the pairs that one list has, across sizes that differ as far as similar sets may."""
    rng = np.random.default_rng(2)
    rows = [(7, i, int(n), int(rng.integers(0, 3)), i) for i, n in enumerate(rng.integers(4, 400, 300))] + [(8, 1000 + i, 50 + i, 0, 1000 + i) for i in range(5)]
    rows += [(7, 2000, 100, 0, 2000), (7, 2001, 125, 0, 2001), (7, 2002, 80, 0, 2002)]
    df = spark.createDataFrame(rows, "h long, node long, n long, pos long, root long")

    def pairs(block):
        out, biggest = set(), 0
        groups = {}
        for r in near_copies.blocked(df, near_copies.Fraction(4, 5), block).collect():
            groups.setdefault((r["h"], r["key"]), []).append((r["node"], r["n"], r["pos"], r["root"], r["side"]))
        for g in groups.values():
            biggest = max(biggest, len(g))
            for u, v in near_copies.prefix_pairs(*(np.array(c) for c in zip(*g)), similarity=near_copies.Fraction(4, 5)):
                found = list(zip(u.tolist(), v.tolist()))
                assert not out & set(found)  # every pair meets once
                out |= set(found)
        return out, biggest

    whole, _ = pairs(10_000)
    parts, biggest = pairs(16)
    assert whole == parts and len(whole) > 1000 and biggest < 80
    assert (2001, 2000) in whole and (2002, 2000) in whole


def test_blocks_change_no_result(spark):
    rng = np.random.default_rng(3)
    base = [text(rng, 60) for _ in range(30)]
    rows = []
    for i in range(400):
        w = base[i % 30].split()
        w[int(rng.integers(0, 60))] = f"w{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [sorted(r["doc_id"] for r in near_copies.distinct_documents(docs, block=b).collect()) for b in (2048, 5)]
    assert ids[0] == ids[1] and 30 <= len(ids[0]) < 400


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        both = rng.integers(0, 1 << 62, int(rng.integers(0, 900))).astype(np.uint64)
        a = np.unique(np.concatenate((both, rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64))))
        b = np.unique(np.concatenate((both, rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64))))
        bits = int(np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
