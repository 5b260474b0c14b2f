"""Language-model scores: word counts with add-one, and context-tree weighting over bytes.

A byte is eight binary decisions, each with the bits before it in the byte as its place in a binary tree, and each place
has a context tree over the preceding bytes. Krichevsky-Trofimov estimates of all depths are mixed by the weights of
context-tree weighting: a node's own estimate against the product of its children, half and half a priori. The counts
that this takes are those of byte strings of length depth + 1, gathered from all training texts in one pass together
with the word counts.

The model stays a distributed table at every size. Strings fall into parts by the two bytes before their last one, so
that a part holds whole subtrees below depth 2; what the parts add up to for depths 1 and 0, at most 65 280 nodes, is all
that the driver sees. Documents are dealt into chunks; a chunk asks each part for its different strings, and each part of
the words for its different words, and gets their values back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Block, Workspace, blocks, lean, lowered, mix, require, span_hashes, words

#: Stands for the end of a text and for what is before it; no byte of UTF-8.
END = 255
#: Parts of the strings, and as many of the words after them.
PARTS = 256


def grams(block: Block, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each lower-cased text, and an end after it: that byte below its ``depth`` predecessors.

    Also returns where each text's strings begin.
    """
    n = block.n
    size = np.diff(block.offsets)
    at = block.offsets[:-1] + np.arange(n)
    data = np.full(len(block.data) + n + depth, END, np.uint32)
    to = np.arange(len(block.data)) + np.repeat(np.arange(n), size) + depth
    data[to] = lowered(block.data)
    total = len(block.data) + n
    key = data[depth : depth + total].copy()
    since = np.arange(total) - np.repeat(at, size + 1)
    for d in range(1, depth + 1):
        before = data[depth - d : depth - d + total]
        key |= np.where(since >= d, before, END).astype(np.uint32) << np.uint32(8 * d)
    return key, at


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole n, from a table up to its largest common value and Stirling's series beyond."""
    small = np.cumsum(np.concatenate(([0.5 * math.log(math.pi)], np.log(np.arange(1, 4096) - 0.5))))
    x = n.astype(np.float64) + 0.5
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(small), small[np.minimum(n, len(small) - 1)], big)


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    """log n! in the same way."""
    small = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, 4096)))))
    x = n.astype(np.float64) + 1
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(small), small[np.minimum(n, len(small) - 1)], big)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lgamma_one(zeros + ones) - math.log(math.pi)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def place_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, zeros and ones of all bit places, from different sorted strings and their counts."""
    nodes, zeros, ones = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(8):
        group = keys >> np.uint32(8 - k)
        bit = ((keys >> np.uint32(7 - k)) & np.uint32(1)).astype(np.int64)
        g, one, zero = summed(group, counts * bit, counts * (1 - bit))
        nodes.append((g >> np.uint32(k)) << np.uint32(8) | np.uint32(1 << k) | (g & np.uint32((1 << k) - 1)))
        ones.append(one)
        zeros.append(zero)
    return summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))


class ContextTrees:
    """Levels of the weighted context trees of all bit places.

    Node keys: context bytes above, place (1 to 255) in the lowest byte. A level has the nodes, their own share of the
    mixture and their probability of a one.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, d: int, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> np.ndarray:
        """Adds level ``d``; children: sums of the nodes' children's log weighted probabilities. Returns the nodes' own."""
        log_own = estimate(zeros, ones)
        if children is None:
            weighted, own = log_own, np.ones(len(nodes))
        else:
            weighted = math.log(0.5) + np.logaddexp(log_own, children)
            own = 1 / (1 + np.exp(np.clip(children - log_own, -700, 700)))
        self.levels[d] = nodes, own, (ones + 0.5) / (zeros + ones + 1)
        return weighted

    def build(self, keys: np.ndarray, counts: np.ndarray, down_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Adds the levels from the depth to ``down_to``; returns node, zeros, ones and log weighted of the last level's parents."""
        nodes, weighted = np.zeros(0, np.uint32), np.zeros(0)
        zeros = ones = np.zeros(0, np.int64)
        for d in range(self.depth, down_to - 1, -1):
            at = np.uint32((1 << (8 * (d + 1))) - 1)
            low, n = summed(keys & at, counts)
            below, below_weighted = nodes, weighted
            nodes, zeros, ones = place_counts(low, n)
            children = None if d == self.depth else summed(np.concatenate((below & at, nodes)), np.concatenate((below_weighted, np.zeros(len(nodes)))))[1]
            weighted = self.add(d, nodes, zeros, ones, children)
        mask = np.uint32((1 << (8 * down_to)) - 1)
        return summed(nodes & mask, zeros, ones, weighted)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the others."""
        total = np.zeros(len(keys))
        for k in range(8):
            bit = (keys >> np.uint32(7 - k)) & np.uint32(1)
            place = np.uint32(1 << k) | ((keys & np.uint32(255)) >> np.uint32(8 - k))
            p = np.full(len(keys), 0.5)
            for d in range(self.depth, -1, -1):
                nodes, own, one = self.levels[d]
                if not len(nodes):
                    continue
                key = ((keys >> np.uint32(8)) & np.uint32((1 << (8 * d)) - 1)) << np.uint32(8) | place
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                w = own[at]
                p = np.where(nodes[at] == key, w * one[at] + (1 - w) * p, 0.5)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def string_part(keys: np.ndarray) -> np.ndarray:
    """The part of each string: a hash of the two bytes before the last one."""
    return (mix((keys >> np.uint32(8)).astype(np.uint64) & np.uint64(0xFFFF)) % np.uint64(PARTS)).astype(np.int64)


def word_part(hashes: np.ndarray) -> np.ndarray:
    return PARTS + (hashes >> np.uint64(56)).astype(np.int64) % PARTS


def _tally(keys: np.ndarray, store: list) -> None:
    k, n = np.unique(keys, return_counts=True)
    store.append((k, n))


def _merged(store: list) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in store]), np.concatenate([c for _, c in store])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def counts(work: Workspace, docs: DataFrame, training: Column, depth: int) -> DataFrame:
    """``(part, key, n)`` over all training texts: byte strings, word hashes and, as part -1, the texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings: list = []
            heads: list = []
            for block in blocks(b.column(0), 1 << 20):
                _tally(grams(block, depth)[0], strings)
                starts, ends, _ = words(block)
                if len(starts):
                    _tally(span_hashes(lowered(block.data), starts, ends), heads)
            for part, store in ((string_part, strings), (word_part, heads)):
                if store:
                    k, n = _merged(store)
                    yield pa.RecordBatch.from_arrays([pa.array(part(k).astype(np.int16)), pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], ["part", "key", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int16()), pa.array([0], pa.int64()), pa.array([b.num_rows], pa.int64())], ["part", "key", "n"])

    seen = docs.where(training).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "part short, key long, n long")
    return work.table(seen.groupBy("part", "key").agg(F.sum("n").alias("n")), "counts")


MODEL = "part short, keys binary, counts binary, nodes binary, sums binary"


def model_parts(table: DataFrame, depth: int) -> DataFrame:
    """A row for each part: its keys and counts, packed, and what it adds to the nodes of depth 1.

    A part of the strings holds at most 2**32 / PARTS of them, whatever the input; a part of the words 1 / PARTS of all.
    """

    def run(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        keys = part.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], part.column("n").to_numpy()[order].astype(np.int64)
        nodes = sums = b""
        if number < PARTS:
            keys = keys.astype(np.uint32)
            parents, zeros, ones, weighted = ContextTrees(depth).build(keys, n, 2)
            nodes, sums = parents.tobytes(), np.stack((zeros, ones, weighted)).astype(np.float64).tobytes()
        cols = [pa.array([number], pa.int16()), *[pa.array([x], pa.binary()) for x in (keys.tobytes(), n.tobytes(), nodes, sums)]]
        return pa.Table.from_arrays(cols, [f.split()[0] for f in MODEL.split(", ")])

    return table.where("part >= 0").groupBy("part").applyInArrow(run, MODEL)


def upper_levels(parts: DataFrame, depth: int) -> ContextTrees:
    """Depths 1 and 0, from at most 65 280 nodes of depth 1 whatever the input."""

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, raw in zip(b.column(0), b.column(1), strict=True):
                k = np.frombuffer(node.as_py(), np.uint32)
                zeros, ones, weighted = np.frombuffer(raw.as_py(), np.float64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(weighted)], ["node", "zeros", "ones", "weighted"])

    rows = parts.where(f"part < {PARTS}").select("nodes", "sums").mapInArrow(spread, "node long, zeros double, ones double, weighted double")
    found = rows.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toArrow()
    nodes, zeros, ones, children = (c.to_numpy() for c in found.columns)
    order = np.argsort(nodes)
    nodes, zeros, ones, children = nodes[order].astype(np.uint32), zeros[order].astype(np.int64), ones[order].astype(np.int64), children[order]
    trees = ContextTrees(depth)
    weighted = trees.add(1, nodes, zeros, ones, children)
    trees.add(0, *summed(nodes & np.uint32(255), zeros, ones, weighted))
    return trees


ASKED = "chunk long, part short, wanted binary"
ANSWERED = "chunk long, part short, wanted binary, found binary"


def score(docs: DataFrame, training: Column, depth: int = 3, chunk_bytes: int = 1 << 22, chunks_together: int = 256) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by models of the rows where ``training`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability by the weighted
    context trees) and bits_per_byte (code length, the end included). A null text is the empty text: one token, the end.
    depth: bytes of context, 2 or 3, the same at every size. chunk_bytes: documents that ask for values together have so
    many bytes, or are one longer document; chunks_together: chunks that one task answers at once. Neither changes a
    score. No training row: all counts are zero and every bit has probability 1/2. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    id_type = dict(docs.dtypes)["doc_id"]
    rows = require(docs, "doc_id", "text")
    table = counts(work, rows, training, depth)
    kind = F.when(F.col("part") < 0, 2).when(F.col("part") < PARTS, 0).otherwise(1)
    sums = {r["kind"]: (r["v"], r["n"]) for r in table.groupBy(kind.alias("kind")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    n_texts = sums.get(2, (0, 0))[1] or 0
    distinct_words, word_tokens = sums.get(1, (0, 0))
    # The end is one more token, known as soon as there is a training text.
    total, vocabulary = word_tokens + n_texts, distinct_words + bool(n_texts)
    unit = math.log10(total + vocabulary + 1)
    end_log = math.log10(n_texts + 1) - unit
    parts = work.table(model_parts(table, depth), "model")
    upper = upper_levels(parts, depth).levels

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            numbers = []
            for block in blocks(b.column(1), chunk_bytes // 8):
                if held and held + len(block.data) > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += len(block.data)
                numbers.append(np.full(block.n, chunk))
            if numbers:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), b.column(0), b.column(1)], ["chunk", "doc_id", "text"])

    dealt = work.table(rows.mapInArrow(deal, f"chunk long, doc_id {id_type}, text string"), "chunks")

    @lean
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(chunk: int, strings: list, heads: list) -> pa.RecordBatch:
            number, wanted = [], []
            for part, store, kind in ((string_part, strings, np.uint32), (word_part, heads, np.uint64)):
                if store:
                    k = np.unique(np.concatenate(store)).astype(kind)
                    p = part(k)
                    order = np.argsort(p, kind="stable")
                    k, p = k[order], p[order]
                    bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
                    number += p[bounds[:-1]].tolist()
                    wanted += [k[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(number), pa.int64()), pa.array(number, pa.int16()), pa.array(wanted, pa.binary())], ["chunk", "part", "wanted"])

        now, strings, heads = None, [], []
        for b in batches:
            numbers = b.column(0).to_numpy()
            bounds = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if now != int(numbers[i]):
                    if now is not None:
                        yield asked(now, strings, heads)
                    now, strings, heads = int(numbers[i]), [], []
                for block in blocks(b.column(1).slice(i, j - i), 1 << 20):
                    strings.append(np.unique(grams(block, depth)[0]))
                    starts, ends, _ = words(block)
                    if len(starts):
                        heads.append(np.unique(span_hashes(lowered(block.data), starts, ends)))
        if now is not None:
            yield asked(now, strings, heads)

    n_chunks = dealt.agg(F.count_distinct("chunk")).first()[0]
    salts = max(1, -(-n_chunks // chunks_together))
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")
    asking = dealt.select("chunk", "text").mapInArrow(ask, ASKED).withColumn("salt", salt)
    serving = parts.select("part", "keys", "counts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def answer(model: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int16()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["chunk", "part", "wanted", "found"])
        strings = asked.column("part")[0].as_py() < PARTS
        key = np.uint32 if strings else np.uint64
        raw = [x.as_py() for x in asked.column("wanted")]
        wanted = np.frombuffer(b"".join(raw), key)
        some, back = np.unique(wanted, return_inverse=True)
        keys, n = (np.frombuffer(b"".join(x.as_py() for x in model.column(c)), t) for c, t in (("keys", key), ("counts", np.int64)))
        if strings:
            trees = ContextTrees(depth)
            trees.build(keys, n, 2)
            trees.levels |= upper
            value = trees.log10(some)
        elif len(keys):
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            value = np.where(keys[at] == some, n[at], 0).astype(np.float64)
        else:
            value = np.zeros(len(some))
        value = value[back]
        ends = np.cumsum([len(x) // key().itemsize for x in raw]).tolist()
        found = pa.array([value[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)], pa.binary())
        return pa.Table.from_arrays([asked.column("chunk"), asked.column("part"), asked.column("wanted"), found], ["chunk", "part", "wanted", "found"])

    answers = serving.groupBy("part", "salt").cogroup(asking.groupBy("part", "salt")).applyInArrow(answer, ANSWERED)

    out_names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]

    def measure(texts: pa.Table, found: pa.Table) -> pa.Table:
        number = found.column("part").to_numpy() if found.num_rows else np.zeros(0, np.int16)

        def known(mine: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
            parts = [[np.frombuffer(found.column(c)[int(i)].as_py(), t) for i in np.flatnonzero(mine)] for c, t in (("wanted", key), ("found", np.float64))]
            k, v = (np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (key, np.float64), strict=True))
            k, first = np.unique(k, return_index=True)
            return k, v[first]

        strings, string_value = known(number < PARTS, np.uint32)
        heads, head_count = known(number >= PARTS, np.uint64)
        cols: list[list] = [[pa.array([], x)] for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
        text = texts.column("text").combine_chunks()
        for block in blocks(text, 1 << 20):
            starts, ends, of = words(block)
            n = np.bincount(of, minlength=block.n)
            c = np.zeros(len(starts))
            if len(starts):
                c = head_count[np.searchsorted(heads, span_hashes(lowered(block.data), starts, ends))]
            base = np.bincount(of, np.log10(c + 1) - unit, minlength=block.n) + end_log
            key, at = grams(block, depth)
            s = np.add.reduceat(string_value[np.searchsorted(strings, key)], at)
            size = np.diff(block.offsets) + 1
            for col, v in zip(cols, (n + 1, np.bincount(of, c > 0, minlength=block.n).astype(np.int64) + (n_texts > 0), base, s, s / -math.log10(2) / size), strict=True):
                col.append(pa.array(v))
        done = [pa.chunked_array(c) for c in cols]
        return pa.Table.from_arrays([texts.column("doc_id"), *done], out_names)

    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(measure, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(int(total)).cast("long"))
