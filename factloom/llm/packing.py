"""Packing of documents into sequences of a fixed capacity by best-two-fit.

Bins are filled greedily with the largest document that fits; then the smallest document of a bin is replaced by two
unpacked documents that together fill its expanded gap more tightly, until no such exchange is left. The heuristic reads
lengths only, and a length is at most the capacity, so it runs over the histogram of lengths: at most ``capacity``
counters on the driver whatever the input. A bin's pattern of lengths is repeated for as many bins as the counters
allow, so each step uses up a counter and the plan has a few rows for each length.

Pieces then get their place from (length, rank among pieces of that length). Ranks come from running counts inside a
partition plus a prefix sum over the partitions' counts; no length meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, lean, lean_cached, require


class _Stock:
    """Counters by length, with the largest length in stock that is at most a given one."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self.lengths = sorted(np.flatnonzero(self.n).tolist())

    def take(self, length: int, how_many: int) -> None:
        self.n[length] -= how_many
        if not self.n[length]:
            self.lengths.remove(length)

    def largest(self, most: int, used: dict[int, int]) -> int:
        """Largest length of which more is in stock than ``used`` takes; 0 if none."""
        from bisect import bisect_right

        for i in range(bisect_right(self.lengths, most) - 1, -1, -1):
            length = self.lengths[i]
            if self.n[length] > used.get(length, 0):
                return length
        return 0


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """``[(lengths of a bin, how many such bins), ...]`` for ``counts[length]`` pieces of each length 1 to capacity."""
    stock, out = _Stock(counts), []
    while stock.lengths:
        pattern: list[int] = []
        used: dict[int, int] = {}
        gap = capacity
        while gap and (x := stock.largest(gap, used)):
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        while gap and len(pattern) > 1 or gap and pattern and pattern[-1] < capacity:
            small = pattern[-1]
            room = gap + small
            used[small] -= 1
            best = (0, 0, 0)
            for a in stock.lengths:
                if 2 * a > room:
                    break
                if stock.n[a] <= used.get(a, 0):
                    continue
                used[a] = used.get(a, 0) + 1
                b = stock.largest(room - a, used)
                used[a] -= 1
                if b >= a and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
            if best[0] <= small:
                used[small] += 1
                break
            pattern.pop()
            for x in best[1:]:
                used[x] = used.get(x, 0) + 1
            pattern = sorted([*pattern, *best[1:]], reverse=True)
            gap = capacity - sum(pattern)
        many = min(int(stock.n[x]) // k for x, k in used.items() if k)
        for x, k in used.items():
            if k:
                stock.take(x, k * many)
        out.append((pattern, many))
    return out


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list], list]],
    capacity: int = 1024,
    end_id: int = 2,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) and their places in sequences of at most ``capacity`` ids.

    encoder: makes, on an executor, a function from some texts to their little-endian unsigned 32-bit ids. Each document ends
    with ``end_id``; a null or empty text is that one id. Only longer documents are cut; all pieces but the first have
    ``capacity`` ids. Returns doc_id, piece, start, length, the columns of ``keep`` (expressions over the binary column
    ``ids``; by default ids itself), sequence_id and offset. Each row is a document of its own, repeated ids too; an
    empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "packing")
    keep = {"ids": F.col("ids")} if keep is None else keep
    ending = np.array([end_id], "<u4").tobytes()

    @lean_cached
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                few = b.slice(s, 1024)
                row, piece, start, length, ids, rank = [], [], [], [], [], []
                for i, found in enumerate(encode(few.column(1).to_pylist())):
                    all_ids = found + ending
                    n = len(all_ids) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        ids.append(all_ids[4 * at : 4 * (at + size)])
                        rank.append(int(seen[size]))
                        seen[size] += 1
                        at += size
                        k += 1
                cols = [few.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    id_type = dict(docs.dtypes)["doc_id"]
    pieces = require(docs, "doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids binary, part int, rank long")
    pieces = work.table(pieces.select("doc_id", "piece", "start", "length", "part", "rank", *[c.alias(n) for n, c in keep.items()]), "pieces")

    parts = work.table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]

    # For each length: from which rank on a pattern's slot holds it, the slot's first sequence, sequences and offset.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    given = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for pattern, many in plan(counts, capacity):
        offset = 0
        for x in pattern:
            slots.setdefault(x, []).append((int(given[x]), sequence, many, offset))
            given[x] += many
            offset += x
        sequence += many
    table = {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in slots.items()}

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy() + b.column(b.schema.get_field_index("before")).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
            begin = 0
            for end in ends:
                at = order[begin:end]
                first, seq0, _, offset = table[int(length[at[0]])]
                k = np.searchsorted(first, rank[at], "right") - 1
                seq[at] = seq0[k] + rank[at] - first[k]
                off[at] = offset[k]
                begin = end
            out = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", *keep]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = work.table(parts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), "bases")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return pieces.join(bases, ["part", "length"]).select(*names, "rank", "before").mapInArrow(place, f"{schema}, sequence_id long, offset long")
