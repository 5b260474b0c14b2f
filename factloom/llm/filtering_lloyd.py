"""Codes for vectors by product quantization, whose codebooks Lloyd's rounds fit with the filtering algorithm.

Each block of a partition's rows gets one kd-tree for every part of the vectors. A node keeps the bounding box, the sum
and the count of its points. A round walks down each tree with the codebook entries that can still be nearest: those that
another entry beats everywhere in the box are eliminated, and a node with one entry left gives its cached sum and count to
that entry at once. Trees are built once and written to the shared folder; a round reads them and sends at most one row
for each entry and task. All arithmetic is on integers, which doubles hold exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, lean, require

#: Rows of a block, and points of a leaf.
BLOCK, LEAF = 2048, 16


def finite(v: str) -> Column:
    """Whether a vector column is there and all its components are finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce(F.col(v).isNotNull() & F.forall(v, good), F.lit(False))


def scaled(v: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, in double precision."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def largest(v: str) -> Column:
    """The largest magnitude of a component, as a double; 0 for an empty vector."""
    return F.coalesce(F.greatest(F.abs(F.array_max(v).cast("double")), F.abs(F.array_min(v).cast("double"))), F.lit(0.0))


def integer_matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of integer lists, padded with zeros to ``dim``."""
    lens = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lens == dim).all():
        return flat.reshape(len(col), dim)
    out = np.zeros((len(col), dim), np.int64)
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of a few rows, for tables whose rows hold a block each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tree:
    """A kd-tree over integer points.

    points: in the order of the leaves; order: where each stood before. nodes: a row for each node with begin and end
    among the points, left and right child (0 for leaves), then low and high end of the box and the sum, by dimension.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.points, self.order, self.nodes = points, order, nodes

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            own = x[order[begin:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            nodes.append(np.concatenate(([begin, end, 0, 0], low, high, own.sum(axis=0))))
            wide = int(np.argmax(high - low))
            if end - begin > LEAF and high[wide] > low[wide]:
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, wide], half)]
                here = len(nodes) - 1
                todo += [(begin, begin + half, here, 2), (begin + half, end, here, 3)]
        return cls(x[order], order, np.array(nodes))

    def pack(self) -> list[bytes]:
        return [self.points.astype(np.int32).tobytes(), self.order.astype(np.int32).tobytes(), self.nodes.tobytes()]

    @classmethod
    def unpack(cls, packed: list[bytes], width: int) -> Tree:
        points, order, nodes = packed
        return cls(np.frombuffer(points, np.int32).reshape(-1, width).astype(np.float64), np.frombuffer(order, np.int32), np.frombuffer(nodes, np.int64).reshape(-1, 4 + 3 * width))

    def filter(self, book: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The nearest entry of each point, ties to the lower one, and ``(node, entry)`` of the subtrees that went whole."""
        width = book.shape[1]
        norms = np.einsum("ij,ij->i", book, book)
        boxes = self.nodes[:, 4 : 4 + 2 * width].astype(np.float64)
        found, whole = np.empty(len(self.points), np.int32), []
        todo = [(0, np.arange(len(book)))]
        while todo:
            at, entries = todo.pop()
            begin, end, left, right = self.nodes[at, :4]
            if len(entries) > 1:
                low, high = boxes[at, :width], boxes[at, width:]
                z = book[entries]
                # Squared distance to the middle of the box, without what is the same for all entries.
                far = norms[entries] - z @ (low + high)
                best = int(np.argmin(far))
                # At most so much nearer than the best one is an entry anywhere in the box.
                lead = far[best] - far + np.abs(z - z[best]) @ (high - low)
                entries = entries[(lead > 0) | (lead == 0) & (entries <= entries[best])]
            if len(entries) == 1:
                found[begin:end] = entries[0]
                whole.append((at, int(entries[0])))
            elif left:
                todo += [(left, entries), (right, entries)]
            else:
                d = norms[entries] - 2 * (self.points[begin:end] @ book[entries].T)
                found[begin:end] = entries[np.argmin(d, axis=1)]
        return found, whole

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each entry; whole subtrees add what is cached."""
        width = book.shape[1]
        found, whole = self.filter(book)
        counts, sums, single = np.zeros(len(book), np.int64), np.zeros((len(book), width), np.int64), np.ones(len(found), bool)
        for at, entry in whole:
            begin, end = self.nodes[at, :2]
            counts[entry] += end - begin
            sums[entry] += self.nodes[at, 4 + 2 * width :]
            single[begin:end] = False
        np.add.at(counts, found[single], 1)
        np.add.at(sums, found[single], self.points[single].astype(np.int64))
        return counts, sums


def _blocks(dim: int, parts: int, width: int):
    """A row for each block of rows: ids, labels and the packed trees of the parts, one after the other."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                x = np.zeros((part.num_rows, parts * width), np.int64)
                x[:, :dim] = integer_matrix(part.column(2), dim)
                trees = [t for i in range(parts) for t in Tree.build(x[:, i * width : (i + 1) * width]).pack()]
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, part.column(0)), pa.ListArray.from_arrays(whole, part.column(1)), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    return run


def _round(books: np.ndarray):
    """Counts and sums by part and entry of all blocks of a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for b in batches:
            for row in b.column(0):
                packed = [t.as_buffer() for t in row]
                for i in range(parts):
                    c, s = Tree.unpack(packed[3 * i : 3 * i + 3], width).totals(books[i])
                    counts[i] += c
                    sums[i] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    """Code and error of each row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for b in batches:
            for at in range(b.num_rows):
                packed = [t.as_buffer() for t in b.column(2)[at]]
                ids = b.column(0)[at].values
                codes, error = np.empty((len(ids), parts), np.uint8 if books.shape[1] <= 256 else np.uint16), np.zeros(len(ids), np.int64)
                for i in range(parts):
                    tree = Tree.unpack(packed[3 * i : 3 * i + 3], width)
                    found, _ = tree.filter(books[i])
                    codes[tree.order, i] = found
                    error[tree.order] += ((tree.points - books[i][found]) ** 2).sum(axis=1).astype(np.int64)
                text = [r.astype(">u2" if codes.dtype == np.uint16 else "u1").tobytes().hex() for r in codes]
                yield pa.RecordBatch.from_arrays([ids, b.column(1)[at].values, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each row with a usable vector.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal consecutive parts. A part's codebook
    starts as that part of the ``entries`` smallest ids' vectors and takes ``rounds`` rounds of assignment to the nearest
    entry (squared distance, ties to the lower index) and replacement by the floor of the mean; unused entries stay.
    code: entry indexes as hexadecimal digits, two for each part (four if there are more than 256 entries).
    label_error: the error summed over equal labels, nulls together.

    Rows without a vector, or with null or non-finite components, are left out. A null id keeps its row, which starts no
    codebook. Rows that repeat an id are rows of their own; the least of their vectors stands for the id at the start.
    Vectors shorter than the longest, and the last part, are padded with zeros. Fewer ids than entries make smaller
    codebooks; without any id there is one entry of zeros; an empty table gives an empty result. Components too large for
    exact arithmetic in doubles raise ValueError before any work.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "filtering_lloyd")
    base = require(vectors, id_col, label_col, vector_col).toDF("vec_id", "label", "v").where(finite("v")).withColumn("v", scaled("v", scale)).withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = base.schema["label"].dataType.simpleString()
    n, dim, top = base.agg(F.count("*"), F.max(F.size("v")), F.max(largest("v"))).first()
    if not n:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-dim // parts))
    if 16 * width * (top + 1) ** 2 >= 1 << 53:
        raise ValueError(f"components up to {top:.0f} after scaling are too large for exact distances")
    first = [r["vec_id"] for r in base.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    start = {r["vec_id"]: r["v"] for r in base.where(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    books = np.zeros((parts, max(1, len(first)), width))
    for i, key in enumerate(first):
        x = np.zeros(parts * width)
        x[: len(start[key])] = start[key]
        books[:, i] = x.reshape(parts, width)

    table = base.select("vec_id", "label", "v").mapInArrow(_blocks(dim, parts, width), f"ids array<long>, labels array<{kind}>, trees array<binary>")
    table = work.table(table, "trees")
    with small_batches(spark, 16):
        for _ in range(rounds):
            found = table.select("trees").mapInArrow(_round(books), "part int, entry int, n long, sums array<long>")
            total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
            new = books.copy()
            for r in total.collect():  # a row for each entry of each part at most
                new[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
            books = new
        coded = work.table(table.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    work.drop(table)
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    # One row for each label: broadcast by the optimizer while small, else a join whose hot keys adaptive execution splits.
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
