"""Norm buckets, the radix trie and filtering Lloyd against brute force, with nulls, ties, repeats and odd shapes."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import filtering_lloyd, merkle, norm_buckets

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, Vec_ID string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of very different lengths, copies, a hot vector, short, zero, empty, null and non-finite ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(600):
        v = centres[i % 6] + rng.normal(size=12) * (0.02 if i % 3 else 0.8)
        rows.append((i, (v / np.linalg.norm(v) * float(rng.choice([0.05, 1, 1, 4]))).astype(np.float32).tolist()))
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(50, rows[50][1]), (50, rows[50][1]), (100, rows[3][1])]
    rows += [(2000, [0.0] * 12), (2001, []), (2002, None), (2003, [NAN] * 12), (2004, [INF] + [0.0] * 11), (2005, [None] * 12), (2050, [0.5, -0.25]), (None, rows[1][1]), (-50, rows[9][1])]
    return spark.createDataFrame([(i, v, None if i is None or i % 11 == 0 else i % 4, "x") for i, v in rows], SCHEMA)


def usable(df, scale):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = np.zeros(12, np.int64)
            x[: len(v)] = np.floor(scale * np.array(v, float))
            out.append((r[0], x, r["label"]))
    return out


def nearest(rows, k=5):
    seen = {(i, x.tobytes()): x for i, x, _ in rows if i is not None}
    ids, xs = np.array([i for i, _ in seen]), np.array(list(seen.values()))
    want = []
    for q in sorted({i for i, _ in seen if i % 50 == 0}):
        found = []
        for x in xs[ids == q]:
            found += [(-int(s), int(i)) for i, s in zip(ids, xs @ x) if i != q]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return want


@pytest.mark.parametrize("sizes", [{}, {"chunk": 40, "block": 3, "longest": 30}, {"chunk": 1000, "longest": 600}])
def test_norm_buckets_give_the_largest_products(vectors, sizes):
    got = norm_buckets.search_exact(vectors, F.col("vec_id") % 50 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == nearest(usable(vectors, 256))


def test_norm_buckets_prune_by_both_ways():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 64)) / 256
    x = np.floor(4096 * x / np.linalg.norm(x, axis=1)[:, None])  # equal lengths, so that only coordinates tell them apart
    chunk, q = norm_buckets.Chunk(np.arange(4000), x), np.concatenate((x[::200], rng.normal(size=(20, 64)) * 200 // 1))
    scores = q @ x.T
    least = np.partition(scores, -6, axis=1)[:, -6]
    sizes = np.linalg.norm(q, axis=1)
    cosines = np.array([chunk.local(a, b) for a, b in zip(sizes, least)])
    cut = chunk.cut(q / sizes[:, None], sizes, least, cosines)
    assert 0 < (cosines >= cut).sum() < len(q)
    assert max(len(chunk.candidates(q[i] / sizes[i], cosines[i])) for i in np.flatnonzero(cosines >= cut)) < 500
    got = {}
    for ids, members, s in chunk.search(-1 - np.arange(len(q)), q, least, 5):
        got[-1 - ids[0]] = list(zip(-s, members))
    assert got == {i: sorted(zip(-scores[i], range(4000)))[:5] for i in range(len(q))}


def test_searches_and_codes_of_nothing(spark, vectors):
    for df in (vectors.limit(0), vectors.where("embedding is null")):
        assert norm_buckets.search_exact(df, F.lit(True)).count() == 0
        assert filtering_lloyd.compress(df).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1, "")] * 3, SCHEMA)
    assert norm_buckets.search_exact(one, F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1, ""), (1, [-1.0], 1, "")], SCHEMA)
    assert [tuple(r) for r in norm_buckets.search_exact(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]
    big = spark.createDataFrame([(0, [1e30], 1, "")], SCHEMA)
    for run in (lambda: norm_buckets.search_exact(big, F.lit(True)), lambda: filtering_lloyd.compress(big)):
        with pytest.raises(ValueError):
            run()


def lloyd(rows, parts, k, rounds):
    xs, width = np.array([x for _, x, _ in rows]), 12 // parts
    first = {}
    for i, x, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1].tolist())):
        first.setdefault(i, x)
    books = [np.array([x[p * width : (p + 1) * width] for x in list(first.values())[:k]]) for p in range(parts)]
    cut = [xs[:, p * width : (p + 1) * width] for p in range(parts)]
    nearest = lambda x, b: ((x[:, None] - b[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            at = nearest(cut[p], books[p]).argmin(axis=1)
            for e in set(at):
                books[p][e] = cut[p][at == e].sum(axis=0) // (at == e).sum()
    d = [nearest(cut[p], books[p]) for p in range(parts)]
    error = sum(x.min(axis=1) for x in d)
    by_label = {}
    for (_, _, label), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{x[n].argmin():0{2 if k <= 256 else 4}x}" for x in d), int(error[n]), by_label[r[2]], digest) for n, r in enumerate(rows))


@pytest.mark.parametrize("entries,block", [(256, 2048), (20, 100), (700, 64)])
def test_filtering_lloyd_is_lloyd(vectors, monkeypatch, entries, block):
    monkeypatch.setattr(filtering_lloyd, "BLOCK", block)
    got = filtering_lloyd.compress(vectors, entries=entries, rounds=3)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == lloyd(usable(vectors, 1024), 4, entries, 3)


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 0], [2, 0], [1, 0], [1, 0]] * 40)
    tree = filtering_lloyd.Tree.build(x)
    tree = filtering_lloyd.Tree.unpack(tree.pack(), 2)
    found, _ = tree.filter(np.array([[2.0, 0], [0, 0], [2, 0], [9, 9]]))
    back = np.empty(len(x), int)
    back[tree.order] = found
    assert back.tolist() == [1, 0, 0, 0] * 40


def test_subtrees_go_whole():
    x = np.concatenate((np.zeros((500, 3), int), np.full((500, 3), 100)))
    found, whole = filtering_lloyd.Tree.build(x).filter(np.array([[0.0, 0, 0], [100, 100, 100]]))
    assert len(whole) <= 4 and sorted(np.bincount(found)) == [500, 500]


# --- the manifest -------------------------------------------------------------------------------


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for run in range(0, len(nodes), 16):
            kids = nodes[run : run + 16]
            for j in range(len(kids)):
                for leaf in under[run + j]:
                    paths[leaf].append(("".join(kids[:j]), "".join(kids[j + 1 :])))
        under = [sum(under[run : run + 16], []) for run in range(0, len(nodes), 16)]
        nodes = [h("".join(nodes[run : run + 16])) for run in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, source, lang, n, text in rows:
        leaf = lambda t: h("".join(map(field, (i, source, lang, n, t))))  # noqa: B023, E731
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups.setdefault(source, []).append((i is not None, i or 0, leaf(text), leaf(low(text)) if hit else leaf(text), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            fold = x[3]
            for left, right in path + top:
                fold = h(left + fold + right)
            out.append((x[4], x[2], trees[s][0], root, h("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(map(str, out))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, SOURCE string")
    return sorted(str(tuple(r)) for r in merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect())


def rows_of(n, sources):
    return [(i * 7, sources[i % len(sources)], "en", i, f"Text {i} É") for i in range(n)]


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (1, [None]), (2, ["a", "b"]), (17, ["a"]), (257, ["a"]), (300, ["a", "é", "", None, "b"]), (40, [f"s{i}" for i in range(20)])])
def test_manifest_is_the_plain_tree(spark, n, sources):
    rows = rows_of(n, sources)
    assert run(spark, rows) == manifest(rows)


def test_manifest_of_odd_rows(spark, monkeypatch):
    """Repeated rows and ids, null and negative ids, far ids, hot ids with many texts, null fields; small limits so that all ways run."""
    monkeypatch.setattr(merkle, "MANY", 8)
    monkeypatch.setattr(merkle, "COPY", 1)
    rows = rows_of(120, ["a", "b"]) + [(5, "a", "en", 1, "Copy")] * 11 + [(8, "a", None, i, f"Hot {i}") for i in range(90)] * 2 + [(None, "b", None, i % 3, None) for i in range(30)]
    rows += [(-(1 << 63), "a", "x", 0, ""), ((1 << 63) - 1, "a", "x", None, "Z" * 3000), (-4, None, "x", 0, "ok")]
    assert run(spark, rows) == manifest(rows)


def test_manifest_of_nothing(spark):
    assert run(spark, []) == []
