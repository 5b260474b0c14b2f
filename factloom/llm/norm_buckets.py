"""Exact top-k search by largest inner product with norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a fixed ratio and is cut into chunks of bounded size. A query
first meets the longest vectors of all, which gives it a score that its answer must reach. It then goes only to buckets
whose longest vector can reach that score. In a chunk the score becomes a local threshold on the cosine. Queries with a
low one are pruned by length: they are multiplied with the vectors that are long enough. Queries with a high one are
pruned by coordinates: in the sorted lists of their largest coordinates, only vectors inside the feasible ranges of all of
them are candidates. Each chunk sets the cosine from which coordinates are cheaper by the estimated work of a few of its
queries. Candidates are verified by their whole products, which are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filtering_lloyd import finite, integer_matrix, largest, scaled
from .shared import Workspace, lean, require

#: No score to reach.
NONE = -(1 << 62)
#: Slack of bounds in floating point; it only lets more candidates through.
SLACK = 1e-9
#: Sorted lists that a query looks at, and its estimated work by coordinates: a start and so much for each member of the
#: narrowest range, where a product with one more vector of a prefix is 1.
FOCUS, START, MEMBER = 3, 400.0, 4.0


class Chunk:
    """Vectors of similar length, longest first, with a sorted list for each coordinate that is asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        order = np.argsort(-length, kind="stable")
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Members in order of coordinate ``f``, and its values."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def local(self, size: float, least: float) -> float:
        """The cosine that a member must reach with a query of length ``size``; -1 if any will do."""
        reach = size * self.length[0]
        return least / reach - SLACK if least > 0 and reach > 0 else -1.0

    def long_enough(self, size: float, least: float) -> int:
        """How many members, the longest ones, can reach ``least`` by their length."""
        return len(self.ids) if least <= 0 else int(np.searchsorted(-self.length, -least / max(size, 1e-300) * (1 - SLACK), "right"))

    def ranges(self, unit: np.ndarray, cosine: float) -> list[tuple[int, float, float, int, int]]:
        """``(coordinate, low, high, begin, end)`` of the query's focus coordinates, the narrowest range first.

        Vectors within the angle of the threshold differ from the query by no more than it in their angle to an axis.
        """
        apart, out = math.acos(max(-1.0, min(1.0, cosine))), []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, own + apart)) - SLACK, math.cos(max(0.0, own - apart)) + SLACK
            values = self.sorted_list(int(f))[1]
            out.append((int(f), low, high, int(np.searchsorted(values, low, "left")), int(np.searchsorted(values, high, "right"))))
        return sorted(out, key=lambda r: r[4] - r[3])

    def candidates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        (f, _, _, begin, end), *rest = self.ranges(unit, cosine)
        found = self.sorted_list(f)[0][begin:end]
        for f, low, high, _, _ in rest:
            at = self.unit[found, f]
            found = found[(at >= low) & (at <= high)]
        return found

    def cut(self, units: np.ndarray, sizes: np.ndarray, least: np.ndarray, cosines: np.ndarray, tried: int = 12) -> float:
        """The local cosine from which coordinates are estimated to be cheaper than length, by some of the queries."""
        some = np.unique(np.argsort(cosines, kind="stable")[np.linspace(0, len(cosines) - 1, tried).astype(int)])
        some = some[(cosines[some] > 0) & (cosines[some] <= 1)]
        some = some[np.argsort(cosines[some], kind="stable")]
        if not len(some):
            return 2.0
        by_length = np.array([self.long_enough(sizes[i], least[i]) for i in some], float)
        spans = [self.ranges(units[i], cosines[i])[0] for i in some]
        by_coordinate = START + MEMBER * np.array([s[4] - s[3] for s in spans], float)
        # Queries below the cut cost by_length, the others by_coordinate.
        cost = np.concatenate(([0.0], np.cumsum(by_length))) + np.concatenate((np.cumsum(by_coordinate[::-1])[::-1], [0.0]))
        at = int(np.argmin(cost))
        return 2.0 if at == len(some) else float(cosines[some[at]])

    def search(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, id, score)`` of each query's best ``k`` members that reach ``least`` and are not its own."""
        sizes = np.sqrt(np.einsum("ij,ij->i", q, q))
        units = q / np.maximum(sizes, 1e-300)[:, None]
        cosines = np.array([self.local(s, t) for s, t in zip(sizes, least, strict=True)])
        cut, out = self.cut(units, sizes, least, cosines), []
        alive = cosines <= 1

        def best(i: int, members: np.ndarray, scores: np.ndarray) -> None:
            here = (scores >= least[i]) & (members != ids[i])
            members, scores = members[here], scores[here]
            if len(scores) > k:
                top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                members, scores = members[top], scores[top]
                top = np.lexsort((members, -scores))[:k]
                members, scores = members[top], scores[top]
            if len(scores):
                out.append((np.full(len(scores), ids[i]), members, scores))

        for i in np.flatnonzero(alive & (cosines >= cut)):
            found = self.candidates(units[i], cosines[i])
            best(i, self.ids[found], self.x[found] @ q[i])
        rest = np.flatnonzero(alive & (cosines < cut))
        far = np.array([self.long_enough(sizes[i], least[i]) for i in rest], np.int64)
        order = np.argsort(far, kind="stable")
        for s in range(0, len(order), 64):
            some = order[s : s + 64]
            n = int(far[some[-1]])
            scores = q[rest[some]] @ self.x[:n].T
            for row, i in enumerate(rest[some]):
                best(i, self.ids[:n], scores[row])
        return out


def search_exact(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    ratio: float = 0.95,
    chunk: int = 4096,
    block: int = 4096,
    longest: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the ``k`` largest inner products with other ids' rows.

    Components become ``floor(scale * x)`` and products are exact integers. is_query: a condition on
    ``vec_id``, as the id column is called here. ratio: of
    the lengths in a bucket; chunk and block: vectors and queries that meet in one task, about; longest: how many of the
    longest vectors give the first thresholds.

    Ties go to the smaller id; fewer than ``k`` candidates are all returned. Rows with a null id, without a vector or with
    null or non-finite components take no part; zero and empty vectors do. Shorter vectors count as padded with zeros.
    Rows that repeat an id with the same vector count once. Different vectors of one id are rows of their own, which are
    never candidates of their id's query; as queries they share one list. An empty table gives an empty result. Components
    too large for exact products in doubles raise ValueError before any work.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "norm_buckets")
    base = require(vectors, id_col, vector_col).toDF("vec_id", "v").where(F.col("vec_id").isNotNull() & finite("v"))
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("v", scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bucket = F.coalesce(F.floor(F.log(square) / (-2 * math.log(ratio))).cast("int"), F.lit(-1))
    rows = work.table(base.distinct().withColumn("square", square).withColumn("bucket", bucket), "rows")
    out = "query_id long, rank int, vec_id long, score long"
    n, dim, top, asking = rows.agg(F.count("*"), F.max(F.size("v")), F.max(largest("v")), F.count_if("asks")).first()
    if not n or not asking:
        return spark.createDataFrame([], out)
    if max(1, dim) * (top + 1) ** 2 >= 1 << 53:
        raise ValueError(f"components up to {top:.0f} after scaling are too large for exact products")
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64

    # At most 2^21 components, whatever the dimension; lengths have a bound, so buckets do too.
    first = rows.orderBy(F.desc("square"), "vec_id", "v").select("vec_id", "v").limit(max(k + 1, min(longest, (1 << 21) // max(1, dim)))).collect()
    head = np.zeros((len(first), dim))
    for i, r in enumerate(first):
        head[i, : len(r["v"])] = r["v"]
    head_ids = np.array([r["vec_id"] for r in first], np.int64)
    buckets = rows.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.sqrt(F.max("square")).alias("top")).collect()
    blocks = max(1, math.ceil(asking / block))

    def packed(asks: bool):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    part = b.slice(s, 1024)
                    x = integer_matrix(part.column(1), dim)
                    columns = [part.column(0), part.column(2), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())]
                    if asks:
                        scores = x.astype(np.float64) @ head.T
                        scores[part.column(0).to_numpy()[:, None] == head_ids[None, :]] = NONE
                        least = np.partition(scores, len(head) - k, axis=1)[:, len(head) - k] if len(head) >= k else np.full(len(x), float(NONE))
                        columns.append(pa.array(least.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "place", "v", *["least"] * asks])

        return run

    mixed = F.xxhash64("vec_id", "v")
    chunks = F.element_at(F.create_map(*[F.lit(x) for r in buckets for x in (r["bucket"], r["chunks"])]), F.col("bucket"))
    placed = rows.select("vec_id", "v", F.struct("bucket", F.pmod(mixed, chunks).cast("int").alias("chunk")).alias("place"))
    data = placed.mapInArrow(packed(False), "vec_id long, place struct<bucket:int,chunk:int>, v binary")
    data = data.select("vec_id", "v", "place.bucket", "place.chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.where("asks").select("vec_id", "v", F.struct(F.sqrt("square").alias("size"), F.pmod(mixed, F.lit(blocks)).cast("int").alias("block")).alias("place"))
    asked = work.table(asked.mapInArrow(packed(True), "vec_id long, place struct<size:double,block:int>, v binary, least long"), "queries")
    known = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["chunks"]).alias("chunks"), F.lit(r["top"]).alias("top")) for r in buckets])
    reached = F.filter(known, lambda b: (F.col("least") <= 0) | (b["top"] * F.col("place.size") * (1 + SLACK) >= F.col("least")))
    asked = asked.select("vec_id", "v", "least", "place.block", F.explode(reached).alias("b")).select("vec_id", "v", "least", "block", "b.bucket", F.explode(F.sequence(F.lit(0), F.col("b.chunks") - 1)).alias("chunk"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            read = lambda v: np.frombuffer(b"".join(v), kind).reshape(len(v), dim).astype(np.float64)
            found = Chunk(left["vec_id"].to_numpy(), read(left["v"])).search(right["vec_id"].to_numpy(), read(right["v"]), right["least"].to_numpy(), k)
        query, ids, scores = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores.astype(np.int64)})

    keys = ["bucket", "chunk", "block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
