"""Toxicity: what reaches the driver, and the features, splits and calibration against plain code; no name is defined twice."""

import ast
import pathlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import language, toxicity

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_no_definition_shadows_another():
    for path in [*ROOT.glob("*.py"), *ROOT.glob("factloom/**/*.py")]:
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, (ast.Module, ast.ClassDef)):
                names = [n.name for n in node.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not n.decorator_list]
                assert len(names) == len(set(names)), path


@pytest.fixture
def civil_and_not(spark):
    rng = np.random.default_rng(1)
    words = "table river seven window apple garden letter music".split()
    rows = [(i, " ".join(rng.choice(words, 30)) + (" you zorgblat fool" if i % 4 == 0 else "") + f" marker{i}") for i in range(200)]
    rows += [(4, "zzz the same id again " * 50)] * 300  # one id holds more rows than all others
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_no_text_reaches_the_driver(civil_and_not, monkeypatch):
    seen = []
    for name in ("collect", "toArrow", "toPandas"):
        real = getattr(type(civil_and_not[0]), name)

        def watched(self, *a, real=real, name=name):
            got = real(self, *a)
            seen.append((str(got.to_pylist()) if name == "toArrow" else str(got), len(got)))
            return got

        monkeypatch.setattr(type(civil_and_not[0]), name, watched)
    model = toxicity.learn(*civil_and_not, F.lit(True))
    assert model is not None and seen
    assert not any(re.search(r"marker\d+ |again zzz", text) for text, _ in seen)
    assert max(n for _, n in seen) <= 200


def test_repeated_ids_are_one_row_of_a_sample(spark):
    rows = [(1, "aaa bbb", "en")] * 50 + [(1, "aab", "fr"), (2, "ccc", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train_sample(docs, F.lit(True), 10) == (["en", "fr"], [b"aaa bbb", b"ccc"], pytest.approx(np.array([0, 1])))


def test_features_are_plain_counts():
    texts = ["You are an IDIOT, a f0ol, Why?! s.t.u.p.i.d", "plain words only", "", None, "a b c d zorgblat"]
    model = toxicity.ToxicityModel([b"zorgblat"], [b"zorgb"])
    got = model.features(pa.array(texts))
    letters = lambda c: c.isalpha()
    for row, t in zip(got, texts):
        t = t or ""
        w = t.split()
        core = [re.sub(r"^[^A-Za-z]+|[^A-Za-z]+$", "", x).lower() for x in w]
        f = dict(zip(toxicity.FEATURES, row.tolist()))
        n = max(1, len(w))
        assert f["words"] == len(w) and f["log_words"] == pytest.approx(np.log1p(len(w)))
        assert f["fixed_any"] == sum(c in toxicity.LEXICON for c in core)
        assert f["learned_any"] == sum(c == "zorgblat" for c in core)
        assert f["stems_any"] == sum(c.startswith("zorgb") for c in core)
        assert f["second"] == pytest.approx(sum(c in toxicity.SECOND_PERSON for c in core) / n)
        assert f["capitals"] == pytest.approx(sum(c.isupper() for c in t) / max(1, len(t)))
        assert f["exclamations"] == pytest.approx(t.count("!") / max(1, len(t)))
        assert f["questions"] == pytest.approx(t.count("?") / max(1, len(t)))
        assert f["capital_words"] == pytest.approx(sum(len(c) > 1 and x.upper() == x and all(map(letters, c)) for c, x in zip(core, w)) / n, abs=0.2)
    assert dict(zip(toxicity.FEATURES, got[0]))["plain_fixed"] == 2  # f0ol and s.t.u.p.i.d


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (300, 4)).astype(np.float32)
    y = ((x[:, 2] > 3) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.BoostedTrees(rounds=1).fit(x, y)
    p = y.mean()
    g, w = y - p, np.full(300, p * (1 - p))
    best = max((sum(g[m].sum() ** 2 / (w[m].sum() + 1) for m in (x[:, j] <= v, x[:, j] > v)), j, v) for j in range(4) for v in np.unique(x[:, j])[:-1])
    feature, cut, _ = trees.trees[0]
    assert (feature[0], trees.edges[feature[0]][cut[0]]) == best[1:]


def test_isotonic_is_the_best_monotone_fit():
    z, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 0, 1])
    steps, values = toxicity.isotonic(z, y)
    # Pools: 0 | 1, 0 | 1, 0 | 1, shrunk by one row of the mean; equal means merge.
    assert steps.tolist() == [1, 2, 6] and values.tolist() == pytest.approx([(0 + 0.5) / 2, (2 + 0.5) / 5, (1 + 0.5) / 2])
