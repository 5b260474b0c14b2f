"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of a lexicon learned from the training rows, both also after
undoing common obfuscations, how near they stand to second-person words, shares of capitals, exclamation and question
marks, symbols inside words, and the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Block, Workspace, blocks, lean, lowered, require, shipped, span_hashes, words

# Words of abuse, in lower case.
LEXICON = """
abschaum ahole arse arsehole asshole bastard bitch bollocks clown connard coward crap cretin cretino creep cunt degenerate
despicable dick disgusting dipshit douche dolt dumb dumbass dummkopf dunce estúpido estupido failure filth filthy fool
freak fuck fucker fucking garbage gilipollas hate hideous hijoputa horrible hurensohn idiot idiota idiote idiotic
ignorant imbecile imbécil imbécile incompetent inútil jackass jerk kill klootzak loathsome loser lowlife maggot merde
mierda miserable mistkerl moron moronic motherfucker nasty nitwit numbskull ordure parasite pathetic pathétique pendejo
pig prick puta putain puto repulsive retard retarded rotten salaud salope scum scumbag scheiße scheisse schwein shit
shitty shut slut sod stupid stupide tonto trash trottel twat twit ugly useless vermin vile weasel whore wanker wertlos
worthless wretch
""".split()
# Second-person words, in lower case.
SECOND_PERSON = "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr usted ustedes vosotros ti tus su sus".split()

# What is often written for a letter, by byte.
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s"), ("!", "i")):
    _PLAIN[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_INNER = _LETTER.copy()
_INNER[[ord(c) for c in "'0134579@$!*.-_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

FEATURES = ["fixed", "learned", "fixed_any", "learned_any", "plain_fixed", "near_second", "second", "capitals", "capital_words", "exclamations", "questions", "symbols", "odd_inside", "words", "log_words", "spaced", "stems", "stems_any"]


def hash_words(names: list) -> np.ndarray:
    raw = [n if isinstance(n, bytes) else n.encode("utf-8") for n in names]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)) if raw else np.zeros(0, np.uint64)


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without what is not ``good`` at either end."""
    n = len(data)
    ok = good[data]
    nxt = np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1]
    prv = np.maximum.accumulate(np.where(ok, np.arange(n), -1))
    s = np.minimum(nxt[starts], ends)
    return s, np.maximum(prv[ends - 1] + 1, s)


#: Lengths in bytes of the beginnings of words that can be learned.
STEMS = (5, 6, 7, 8)


def features(block: Block, fixed: np.ndarray, learned: np.ndarray, second: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block; an empty text has zeros."""
    out = np.zeros((block.n, len(FEATURES)), np.float32)
    starts, ends, of = words(block)
    if not len(starts):
        return out
    data = block.data
    low = lowered(data)
    s, e = _trim(data, starts, ends, _LETTER)
    h = span_hashes(low, s, e)
    plain = _PLAIN[low]
    letters = _INNER[data]
    # Obfuscated words: letters replaced or symbols put between them.
    s2, e2 = _trim(data, starts, ends, _INNER)
    h2 = span_hashes(plain, s2, e2)
    is_fixed, is_learned, you = _in(h, fixed), _in(h, learned), _in(h, second)
    solid = np.cumsum(np.concatenate(([0], _LETTER[data])))
    odd_inside = (solid[e] - solid[s]) < (e - s)
    is_plain = _in(h2, fixed) & ~is_fixed
    is_stem = np.zeros(len(starts), bool)
    if len(stems):
        for length in STEMS:
            long = np.flatnonzero(e - s >= length)
            is_stem[long[_in(span_hashes(low, s[long], s[long] + length), stems)]] = True
    for mark in b"*.-_":
        keep = plain != mark
        to = np.cumsum(np.concatenate(([0], keep)))
        squeezed = plain[keep]
        some = odd_inside
        hs = span_hashes(squeezed, to[s2[some]], to[e2[some]])
        is_plain[np.flatnonzero(some)[_in(hs, fixed)]] = True
    n = np.bincount(of, minlength=block.n).astype(np.float64)
    per = lambda m: np.bincount(of, m, minlength=block.n) / np.maximum(n, 1)
    hit = is_fixed | is_learned | is_plain | is_stem
    # How near a second-person word stands: 1 / (1 + words between), summed over hits.
    at, places = np.flatnonzero(hit), np.flatnonzero(you)
    near = np.zeros(len(starts))
    if len(at) and len(places):
        k = np.searchsorted(places, at)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(places) - 1)):
            p = places[side]
            same = of[p] == of[at]
            near[at] = np.maximum(near[at], np.where(same, 1 / (1 + np.abs(p - at)), 0))
    size = np.maximum(np.diff(block.offsets), 1)
    filled = np.flatnonzero(np.diff(block.offsets))
    def share(m: np.ndarray) -> np.ndarray:
        got = np.zeros(block.n)
        got[filled] = np.add.reduceat(m.astype(np.int64), block.offsets[filled])
        return got / size
    ups = np.cumsum(np.concatenate(([0], _UPPER[data])))
    shouted = ((ups[e] - ups[s]) == (e - s)) & (e - s > 1)
    single = (e - s) == 1
    spaced = single & np.concatenate((single[1:] & (of[1:] == of[:-1]), [False]))
    count = lambda m: np.bincount(of, m, minlength=block.n)
    cols = [per(is_fixed), per(is_learned), count(is_fixed), count(is_learned), count(is_plain), count(near), per(you), share(_UPPER[data]), per(shouted), share(data == 33), share(data == 63), share(~letters & (data > 32)), per(odd_inside), n, np.log1p(n), per(spaced), per(is_stem), count(is_stem)]
    return np.stack(cols, axis=1).astype(np.float32)


class BoostedTrees:
    """Depth-limited regression trees on binned features, fitted to the gradient of the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # Rare counts lie beyond all quantiles: their own values are edges too.
        self.edges = [np.unique(np.concatenate((e, np.unique(x[:, j])[:8]))) for j, e in enumerate(self.edges)]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, w = y - q, np.maximum(q * (1 - q), 1e-6)
            n = (1 << self.depth) - 1
            feature, cut = np.zeros(n, np.int64), np.full(n, 255, np.int64)
            node = np.zeros(len(y), np.int64)
            for k in range(n):
                rows = np.flatnonzero(node == k)
                if len(rows):
                    feature[k], cut[k] = self._split(b[rows], g[rows], w[rows])
                    node[rows] = 2 * k + 1 + (b[rows, feature[k]] > cut[k])
            leaf = node - n
            value = np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, w, 1 << self.depth) + 1.0)
            self.trees.append((feature, cut, value))
            z += self.rate * value[leaf]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[int, int]:
        best, where = 1e-9, (0, 255)
        total_g, total_w = g.sum(), w.sum()
        for j in range(b.shape[1]):
            sg, sw = np.cumsum(np.bincount(b[:, j], g)), np.cumsum(np.bincount(b[:, j], w))
            gain = sg**2 / (sw + 1) + (total_g - sg) ** 2 / (total_w - sw + 1) - total_g**2 / (total_w + 1)
            gain[(sw < self.least * 0.1) | (total_w - sw < self.least * 0.1)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (j, k)
        return where

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        z = np.full(len(x), self.start)
        i = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[i, feature[node]] > cut[node])
            z += self.rate * value[node - len(feature)]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing step function (from which z on, value), shrunk a little to the mean."""
    order = np.argsort(z, kind="stable")
    blocks_: list[list[float]] = []
    for v, t in zip(z[order].tolist(), y[order].tolist(), strict=True):
        blocks_.append([t, 1.0, v])
        while len(blocks_) > 1 and blocks_[-2][0] / blocks_[-2][1] >= blocks_[-1][0] / blocks_[-1][1]:
            t2, n2, _ = blocks_.pop()
            blocks_[-1][0] += t2
            blocks_[-1][1] += n2
    mean = float(y.mean())
    return np.array([b[2] for b in blocks_]), np.maximum.accumulate([(b[0] + mean) / (b[1] + 1) for b in blocks_])


class ToxicityModel:
    def __init__(self, learned: list[bytes], stems: list[bytes]):
        self.fixed, self.second, self.learned = hash_words(LEXICON), hash_words(SECOND_PERSON), hash_words(learned)
        self.stems = hash_words(stems)

    def features(self, texts: pa.Array) -> np.ndarray:
        rows = [features(b, self.fixed, self.learned, self.second, self.stems) for b in blocks(texts)]
        return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
        """Trees on three quarters of the rows; the calibration on the last quarter."""
        last = np.arange(len(y)) % 4 == 3
        if y[last].min(initial=1) == y[last].max(initial=0) or y[~last].min(initial=1) == y[~last].max(initial=0):
            last = np.zeros(len(y), bool)
        self.trees = BoostedTrees().fit(x[~last], y[~last])
        held = last if last.any() else ~last
        self.steps, self.values = isotonic(self.trees.margin(x[held]), y[held])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.trees.margin(x)
        return np.clip(self.values[np.maximum(np.searchsorted(self.steps, z, "right") - 1, 0)], 0, 1)


_OUTSIDE = "".join(map(chr, range(33, 65))) + "[]^_`{|}~"


def terms(text: str) -> tuple[set[bytes], set[bytes]]:
    """The different words of a text, without what is no letter around them, and the beginnings of words."""
    own = {w.strip(_OUTSIDE).encode("utf-8") for w in text.lower().split()} - {b""}
    return own, {w[:k] for w in own for k in STEMS if len(w) >= k}


def _telling(sample: DataFrame, most: int, bad: int, good: int) -> tuple[list[bytes], list[bytes]]:
    """The words and the beginnings of words that tell toxic texts from others; counted on executors, ``most`` of each kept."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, bytes], list[int]] = {}
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for kind, names in enumerate(terms(text.as_py())):
                    for w in names:
                        seen.setdefault((kind, w), [0, 0])[toxic] += 1
            cols = zip(*((kind, w, n[1], n[0]) for (kind, w), n in seen.items()), strict=True) if seen else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["kind", "term", "bad", "good"])

    counted = sample.select("text", "toxic").mapInArrow(run, "kind int, term binary, bad long, good long").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    telling = counted.where((F.col("bad") >= max(3, 0.01 * bad)) & (ratio >= 30))
    found = [telling.where(F.col("kind") == k).orderBy(F.desc("bad"), "term").limit(most).select("term").collect() for k in (0, 1)]
    return [bytes(r["term"]) for r in found[0]], [bytes(r["term"]) for r in found[1]]


def learn(docs: DataFrame, labels: DataFrame, training: Column, most_rows: int = 6000, most_learned: int = 60) -> ToxicityModel | None:
    """A model from at most ``most_rows`` labelled rows where ``training`` holds, the first by hash of the id.

    Of rows that share a doc_id the least text stands for all. The learned lexicon has at most ``most_learned`` words and as
    many beginnings of words, which stand in at least 1 % of the toxic texts of the sample and are there 30 times as
    frequent as in the others. The driver gets that lexicon and the features, no texts. None if the sample has not both
    labels.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    given = require(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = require(docs, "doc_id", "text")
    # Ids are chosen first, at most ``most_rows``: a sort with a limit would bring that many texts of every task here.
    chosen = texts.select("doc_id").join(given, "doc_id").where(training).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    chosen = work.table(chosen, "chosen")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = work.table(sample, "sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    words_, stems = _telling(sample, most_learned, n[1], n[0])
    model = ToxicityModel(words_, stems)
    model_here = shipped(docs.sparkSession, model)

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_here()
        for b in batches:
            x = model.features(b.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.select("toxic", "text", F.xxhash64("doc_id", F.lit("order")).alias("place")).orderBy("place", "text").select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = rows.column(0).to_numpy().astype(np.float64)
    x = rows.column(1).combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    work.drop(chosen)
    work.drop(sample)
    return model.fit(x.astype(np.float32), y)


def score(docs: DataFrame, labels: DataFrame, training: Column, most_rows: int = 6000) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs`` (doc_id, text); null texts are scored as empty ones.

    Labels that are null or neither 0 nor 1 are ignored; of a doc_id labelled twice the higher holds. Without both labels
    to learn from, every score is 0.
    """
    model = learn(docs, labels, training, most_rows)
    id_type = dict(docs.dtypes)["doc_id"]
    rows = require(docs, "doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    model_here = shipped(docs.sparkSession, model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_here()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(model.features(b.column(1))))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, training: Column, threshold: float = 0.3, most_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns, whatever their names.

    Null and empty texts are scored as empty ones; rows without a doc_id, and rows that share one, are scored by their own
    texts. Without both labels to learn from, and for an empty table, ``docs`` itself.
    """
    model = learn(docs, labels, training, most_rows)
    if model is None:
        return docs
    model_here = shipped(docs.sparkSession, model)
    names = docs.columns
    place = names.index("text")
    placed = docs.toDF(*[f"_{i}" for i in range(len(names))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_here()
        for b in batches:
            keep = model.score(model.features(b.column(place))) < threshold
            yield b.filter(pa.array(keep))

    return placed.mapInArrow(run, placed.schema).toDF(*names)
