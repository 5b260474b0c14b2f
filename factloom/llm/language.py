"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in a window goes,
through a rectifier, to a softmax layer. A filter of width w over embedded bytes is a sum of w table rows, one for each
byte, so the response at a place is w look-ups; two neighbouring bytes share one row of a table of pairs. The network is
trained in numpy on windows of a bounded sample of labelled texts, then applied to all windows of every text; a text's
scores are the softmax of its windows' mean outputs, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, lean, require, shipped


class ByteNet:
    """tables[w]: (w, 256, filters) rows of each width; out: (widths * filters, classes)."""

    def __init__(self, classes: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, window: int = 128, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.filters, self.window = classes, widths, filters, window
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = np.zeros(len(widths) * filters, np.float32)
        self.out = rng.normal(0, 0.1, (len(widths) * filters, len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of each text, the last padded with zeros; their texts and how many bytes they hold."""
        size = np.diff(offsets)
        n = -(-size // self.window)
        of = np.repeat(np.arange(len(size)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = offsets[of] + k * self.window
        held = np.minimum(self.window, offsets[of + 1] - begin)
        at = np.arange(self.window)[None, :]
        x = np.where(at < held[:, None], data[np.minimum(begin[:, None] + at, len(data) - 1)], 0)
        return x.astype(np.uint8), of, held

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, and where it was."""
        top, places = [], []
        for w, t in zip(self.widths, self.tables, strict=True):
            n = x.shape[1] - w + 1
            r = t[0][x[:, :n]]
            for j in range(1, w):
                r += t[j][x[:, j : j + n]]
            p = r.argmax(axis=1)
            places.append(p)
            top.append(np.take_along_axis(r, p[:, None, :], 1)[:, 0])
        return np.concatenate(top, axis=1), places

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 1) -> None:
        """Adam over windows drawn at random; classes are drawn equally often."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        params = [*self.tables, self.bias, self.out, self.shift]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.classes), batch)
            x = np.zeros((batch, self.window), np.uint8)
            for i, c in enumerate(y):
                raw = texts[by_class[c][rng.integers(len(by_class[c]))]]
                begin = rng.integers(0, max(1, len(raw) - self.window + 1))
                part = raw[begin : begin + self.window]
                x[i, : len(part)] = np.frombuffer(part, np.uint8)
            top, places = self.pooled(x)
            hidden = np.maximum(top + self.bias, 0)
            z = hidden @ self.out + self.shift
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), y] -= 1
            p /= batch
            g_out, g_shift = hidden.T @ p + 1e-4 * self.out, p.sum(axis=0)
            g_hidden = (p @ self.out.T) * (hidden > 0)
            grads = []
            for i, (w, place) in enumerate(zip(self.widths, places, strict=True)):
                g = np.zeros_like(self.tables[i])
                part = g_hidden[:, i * self.filters : (i + 1) * self.filters]
                f = np.broadcast_to(np.arange(self.filters)[None, :], place.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, place + j, 1), f), part)
                grads.append(g)
            for i, (q, g) in enumerate(zip(params, [*grads, g_hidden.sum(axis=0), g_out, g_shift], strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                q -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)

    def fused(self) -> list[tuple[list[np.ndarray], bool]]:
        """Rows by pair of bytes for each two neighbouring places of a filter, and whether a single place is left."""
        out = []
        for w, t in zip(self.widths, self.tables, strict=True):
            out.append(([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)], bool(w % 2)))
        return out

    def logits(self, x: np.ndarray, fused: list[tuple[list[np.ndarray], bool]]) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        top = []
        for w, t, (pairs, single) in zip(self.widths, self.tables, fused, strict=True):
            n = x.shape[1] - w + 1
            r = pairs[0].take(pair[:, :n], axis=0)
            for j, table in enumerate(pairs[1:], 1):
                r += table.take(pair[:, 2 * j : 2 * j + n], axis=0)
            if single:
                r += t[w - 1].take(x[:, w - 1 : w - 1 + n], axis=0)
            top.append(r.max(axis=1))
        return np.maximum(np.concatenate(top, axis=1) + self.bias, 0) @ self.out + self.shift


def train_sample(docs: DataFrame, training: Column, most_rows: int) -> tuple[list[str], list[bytes], np.ndarray]:
    """Whole texts and labels of at most ``most_rows`` labelled training ids, the first by hash of the id.

    Of rows that share an id the least (text, lang) stands for all, so that the rows are as bounded as the ids.
    """
    given = require(docs, "doc_id", "text", "lang").where(training & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    # Ids are chosen first: a sort with a limit would bring that many texts of every task here.
    chosen = given.where(F.col("text").rlike(r"\p{L}")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    least = given.join(F.broadcast(chosen), "doc_id", "left_semi").where("text is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))
    rows = least.select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    classes = sorted({r["lang"] for r in rows})
    index = {c: i for i, c in enumerate(classes)}
    return classes, [r["text"].encode("utf-8") for r in rows], np.array([index[r["lang"]] for r in rows])


def predict(docs: DataFrame, training: Column, most_rows: int = 3000, window: int = 128, steps: int = 500) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs`` (doc_id, text, lang).

    The network learns from text and lang of at most ``most_rows`` rows where ``training`` holds and lang is not null; the
    prediction reads the text only. Score is the predicted language's probability. Null texts and texts without a
    letter: ``und`` with score 0; if no row can be learnt from, so is every text.
    """
    spark = docs.sparkSession
    classes, texts, labels = train_sample(docs, training, most_rows)
    id_type = dict(docs.dtypes)["doc_id"]
    rows = require(docs, "doc_id", "text").withColumn("text", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    if not classes:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    net = ByteNet(classes, window=window)
    if len(classes) > 1:
        net.train(texts, labels, steps)
    model = shipped(spark, net)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model()
        fused = net.fused()
        names = np.array([*net.classes, "und"], object)
        for b in batches:
            pred, score = [], []
            for block in blocks(b.column(1), 1 << 18):
                sums = np.zeros((block.n, len(net.classes)))
                if len(block.data):
                    x, of, held = net.windows(block.data, block.offsets)
                    for i in range(0, len(x), 256):
                        z = net.logits(x[i : i + 256], fused)
                        np.add.at(sums, of[i : i + 256], z * held[i : i + 256, None])
                size = np.diff(block.offsets)
                z = sums / np.maximum(size, 1)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                pred.append(names[np.where(size > 0, best, len(net.classes))])
                score.append(np.where(size > 0, p[np.arange(block.n), best], 0.0))
            if pred:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
