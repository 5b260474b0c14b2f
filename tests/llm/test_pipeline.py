"""The pipeline, stage by stage, against plain Python on planted and odd documents."""

import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import toxicity
from factloom.llm.queries import tokenizer_path
from test_operators import split

CLASH = ("row", "spans", "key", "n", "_0", "DOC_ID", "Text")


def plain_good(t):
    t = t or ""
    w = split(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1}
    covered = {i + j for i, g in enumerate(grams) if g in many for j in range(5)}
    solid, lines = sum(map(len, w)), [x for x in t.split("\n") if split(x)]
    bad = [len(w) < 10, 100 * len(covered) > 20 * len(w), solid < 2 * len(w) or solid > 20 * len(w), 10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * len(w)]
    bad += [10 * (len(lines) - len(set(lines))) > 3 * len(lines), 10 * len(re.findall("[A-Z]", t)) > 6 * solid, 10 * t.count("!") > 5 * len(w)]
    return not any(bad)


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    clean = {i: own(int(rng.integers(30, 120))) for i in range(120)}
    toxic = {200 + i: f"{own(20)} you stupid idiot, you moron {own(20)}" for i in range(60)}
    shared = own(70)
    rows = [*clean.items(), *toxic.items(), (300, clean[5]), (301, clean[6] + " more"), (310, f"{own(40)} {shared}"), (311, f"{own(40)} {shared} {own(12)}")]
    rows += [(400, ""), (401, None), (402, "few words"), (403, "again " * 60), (404, "!!! " * 30), (None, own(40)), (7, clean[7]), (8, own(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        docs = docs.select("*", F.lit(1).alias(c))
    folder = str(tmp_path / "clash")
    plain = docs.toDF("doc_id", "text", *[f"x{i}" for i in range(len(CLASH))])
    plain.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 200)) for i in [*clean, *toxic]], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    pair = lambda df: sorted(str(tuple(r)[:2]) for r in df.collect())

    civil = corpus_pipeline.civil(spark, docs, folder)
    assert civil.columns == docs.columns
    low = toxicity.score(plain, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True)).where("score >= 0.3")
    assert {r["doc_id"] for r in low.collect()} == set(toxic)
    left = [(d, t) for d, t in rows if d not in toxic]
    assert pair(civil) == sorted(map(str, left))

    good = corpus_pipeline.good(spark, civil, folder)
    left = [(d, t) for d, t in left if plain_good(t)]
    assert good.columns == docs.columns and pair(good) == sorted(map(str, left))

    distinct = corpus_pipeline.distinct(spark, good, folder)
    # Copies and near copies go; the other text under the id of an earlier row stays.
    left = [(d, t) for i, (d, t) in enumerate(left) if d not in (300, 301) and (d, t) not in left[:i]]
    assert distinct.columns == docs.columns and pair(distinct) == sorted(map(str, left))

    cut = corpus_pipeline.cut(spark, distinct, folder)
    left = [(d, "".join(t.split(shared)) if d == 311 else t) for d, t in left]
    assert cut.columns == docs.columns and pair(cut) == sorted(map(str, left))

    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    packed = corpus_pipeline.packed(spark, cut, folder).collect()
    sizes = sorted((str(d), len(encode(t, add_special_tokens=False).ids) + 1) for d, t in left)
    assert sorted((str(r["doc_id"]), r["length"]) for r in packed) == sizes
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()] and sum(n for _, n in places) <= 1024
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
