"""Operators against brute force, and their defined results for odd input: nulls, empty and long texts, ties, repeats."""

import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import importance, language, lm, packing, passages, permutation, quality_rules, simhash, tokens, toxicity, word_bpe
from factloom.llm.queries import byte_encoder, oracle_sql, tokenizer_path
from factloom.llm.shared import Workspace

WORDS = [a + b for a in ("th", "er", "on", "qu", "st") for b in ("ea", "in", "ou", "al", "é")]
ODD = ["", None, " ", "a", "x" * 5000, "word " * 3000, "\x1c \x00 ok", "日本語 テスト Σας <|endoftext|> it's", "  two  spaces \n\n tabs\t"]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text(rng, int(rng.integers(5, 120)))) for i in range(60)]
    rows += [(60 + i, t) for i, t in enumerate(ODD)] + [(80, rows[0][1]), (81, rows[1][1] + " more"), (5, rows[5][1]), (None, "no id at all")]
    extra = [(i, t, "en" if i is None or i % 3 else "fr", "s", len(t or ""), 1) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, words int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(50)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_every_operator_keeps_rows_and_takes_empty_tables(docs, labels):
    n = docs.count()
    runs = {
        "language": lambda d: language.predict(d, F.lit(True), steps=5),
        "importance": lambda d: importance.resample(d, labels),
        "toxicity": lambda d: toxicity.score(d, labels, F.lit(True)),
        "simhash": lambda d: simhash.near_duplicates(d),
        "word_bpe": lambda d: word_bpe.encode_documents(d, tokenizer_path("word_bpe_49k.json")),
        "rules": lambda d: quality_rules.judge(d),
        "lm": lambda d: lm.score(d, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))),
    }
    for name, run in runs.items():
        assert run(docs).count() == n, name
        assert run(docs.limit(0)).count() == 0, name
    assert passages.duplicate_passages(docs.limit(0)).count() == 0
    assert packing.pack(docs.limit(0), byte_encoder(tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_language_marks_texts_without_letters(docs):
    got = {r["doc_id"]: r for r in language.predict(docs, F.lit(True), steps=5).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {60, 61, 62} and all(0 <= r["score"] <= 1 for r in got.values())


def test_simhash_is_brute_force(docs):
    def fingerprint(t):
        w = low(t).encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", w)
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    got = {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(got) == set(rows)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for (a, x), (b, y) in itertools.combinations(rows, 2):
            if (x ^ y).bit_count() <= 2 and a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert all(got[i, f] == root[i] for i, f in rows if i is not None)


@pytest.mark.parametrize("n", [2, 40, 600])
def test_links_have_all_components(n):
    rng = np.random.default_rng(n)
    base = np.uint64(rng.integers(0, 2**63))
    fp = np.unique(base ^ rng.integers(0, 2**14, n).astype(np.uint64))
    u, v = simhash.link_list(fp, 2)
    root = {int(x): int(x) for x in fp}
    root |= {int(a): int(b) for a, b in zip(u, v, strict=True)}
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2).tolist()
    for i, j in itertools.combinations(range(len(fp)), 2):
        if near[i][j]:
            assert root[int(fp[i])] == root[int(fp[j])]


@pytest.mark.parametrize(("distance", "most"), [(1, 8), (2, 8), (2, 512), (3, 8)])
def test_position_index_links_all_near_fingerprints(spark, distance, most):
    rng = np.random.default_rng(distance)
    lone = rng.integers(0, 2**63, 200).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(1, distance + 2, 200)], np.uint64)
    # A long list: four bytes shared, the others near each other or not.
    family = np.uint64(0x0123456700000000) ^ np.array([sum(1 << int(b) for b in rng.choice(32, 3, replace=False)) for _ in range(150)], np.uint64)
    fp = np.unique(np.concatenate((lone, lone ^ flips, family)))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), distance, most).collect()
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    want, got = list(range(len(fp))), list(range(len(fp)))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        want[find(want, max(i, j))] = find(want, min(i, j))
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    for r in links:
        got[find(got, at[r["u"]])] = find(got, at[r["v"]])
    classes = lambda root: {frozenset(i for i in range(len(fp)) if find(root, i) == x) for x in {find(root, i) for i in range(len(fp))}}
    assert classes(got) == classes(want)


def test_the_tally_rejects_pairs_of_a_list():
    a = np.array([0, 0, 0], np.uint64)
    b = np.array([0x0101, 0x010101, 0x07], np.uint64)
    assert simhash.retained(a, b, 2).tolist() == [True, False, False]


def test_tokens_are_those_of_the_library(docs):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in docs.collect()] + ["don't 'S 'll x'tis", "1234 ½ Ⅷ", "a　b\x85c \xa0d", "é İ ß ﬁ"]
    byte, word = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ours = word_bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    for t, b, w in zip(texts, tokens.ByteBpe(tokenizer_path("byte_bpe_50k.json")).ids(texts), ours.encode(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids
        ids = word.encode(t, add_special_tokens=False).ids
        assert w.tolist() == ids and ours.decode(w).decode() == word.decode(ids, skip_special_tokens=False)


def test_packing_places_every_piece_once(docs):
    got = packing.pack(docs, byte_encoder(tokenizer_path("byte_bpe_50k.json"))).collect()
    by_sequence = {}
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and (r["piece"] == 0 or r["length"] == 1024)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["piece"] == 0 for r in got) == docs.count()
    assert len(by_sequence) <= 1.2 * sum(r["length"] for r in got) / 1024 + 1


def test_plan_uses_each_length_as_often_as_it_is():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    used = np.zeros(65, np.int64)
    bins = 0
    for pattern, many in packing.plan(counts, 64):
        assert sum(pattern) <= 64
        bins += many
        for x in pattern:
            used[x] += many
    assert (used == counts).all() and bins <= 1.03 * (counts * np.arange(65)).sum() / 64 + 1


def test_rules_are_those_of_plain_python(docs):
    def base(t):
        t = t or ""
        w = split(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 400 else set(range(len(w)))
        lines = [x for x in t.split("\n") if split(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.judge(docs)
    want = sorted((str(r["doc_id"]), *base(r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()) == want
    assert got.where("base_failed <> (n_words < 10 or 100 * n_repeat_words > 20 * n_words) or (base_failed and kept)").count() == 0
    named = quality_rules.rules(F.coalesce("text", F.lit("")))
    orders = [sorted(named), sorted(named, reverse=True)]
    costs = quality_rules.work(F.coalesce("text", F.lit("")))
    assert quality_rules.order_rules(docs, named, costs) == quality_rules.order_rules(docs.repartition(3), named, costs)
    assert docs.where(quality_rules.cascade(named, orders[0]) != quality_rules.cascade(named, orders[1])).count() == 0


@pytest.mark.parametrize("tables", ["/root/testdata/sf0.001", None])
def test_cascade_is_its_sql(spark, docs, tables):
    """On documents as they come and on odd texts."""
    rows = spark.read.parquet(f"{tables}/documents.parquet") if tables else docs
    db = duckdb.connect()
    db.register("documents", rows.select("doc_id", "text").toArrow())
    got, want = quality_rules.judge(rows), db.sql(oracle_sql()["op9_cascade"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).toArrow().to_pylist())) == sorted(map(str, want.to_arrow_table().to_pylist()))


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 1 << 10])
def test_language_model_counts(docs, chunk_bytes):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    train = [split(low(t)) for i, t in rows if i % 3]
    c, n = {}, 0
    for w in train:
        for x in [*w, None]:
            c[x] = c.get(x, 0) + 1
            n += 1
    got = lm.score(docs.where("doc_id is not null"), F.col("doc_id") % 3 != 0, chunk_bytes=chunk_bytes, chunks_together=3).collect()
    want = sorted((i, len(split(t)) + 1, sum(x in c for x in [*split(low(t)), None]), n, round(sum(np.log10((c.get(x, 0) + 1) / (n + len(c) + 1)) for x in [*split(low(t)), None]), 6)) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_passages_find_repeats_only(spark):
    rng = np.random.default_rng(5)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared, line = own(60), own(9)
    near = shared.split()
    near[30] = "changed"
    rows = [(i, f"{line}\n{own(80)}") for i in range(30)]
    rows += [(100 + i, f"{own(20)} {shared} {own(15 + i)}") for i in range(12)] + [(200, f"{own(30)} {' '.join(near)} {own(30)}"), (300, rows[3][1]), (301, ""), (302, None), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    got = passages.duplicate_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {*range(101, 112), 200, 300}
    texts = dict(rows)
    for r in got:
        if r["doc_id"] < 200:
            found = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
            assert found == shared and r["n_words"] == 60
    left = {r["doc_id"]: r for r in passages.cut_passages(docs).collect()}
    assert 300 not in left and shared not in left[105]["text"] and left[105]["n_chars"] == len(left[105]["text"]) and left[100]["text"] == texts[100] and left[7]["text"] == texts[7]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in simhash.connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == got[250] == 200


def test_nearest_neighbours_reach_the_recall(spark):
    x = np.random.default_rng(2).normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, x[20].tolist()), (3020, None), (3040, [0.0] * 24), (3060, [float("nan")] * 24)]
    got = permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    y = np.vstack([x, x[20]]).astype(float)
    ids = np.array([*range(1500), 3000])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = y @ y[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, [y[np.flatnonzero(ids == v)[0]] @ y[q] for v in mine.vec_id])
        hits += len(set(best) & set(mine.vec_id))
    assert set(got.query_id) == set(ids[ids % 20 == 0].tolist()) and hits / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_importance_takes_the_largest_keys(docs, labels):
    got = sorted(importance.resample(docs, labels.where("quality = 1"), share=0.4).collect(), key=lambda r: -r["key"])
    k = int(np.ceil(0.4 * len(got)))
    assert all(r["selected"] for r in got[:k]) and sum(r["selected"] for r in got) - k == sum(r["key"] == got[k - 1]["key"] for r in got[k:])


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, text(rng, 40) + (" you idiot zorgblat" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True)).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in got)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(6)
    z = rng.normal(size=300)
    _, values = toxicity.isotonic(z, (rng.random(300) < 1 / (1 + np.exp(-z))).astype(float))
    assert (np.diff(values) >= 0).all()
