"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d`` of their eight bytes, so at least
``8 - d`` positional bytes (a byte value at a byte position) are shared: the guaranteed minimum of matches. A list of one
positional byte would hold 1/256 of all rows, so the eight positions are cut into ``d + 2`` runs, of which such a pair
shares two at least, and each distinct fingerprint is posted under the bytes of every two runs (6 lists of four bytes
for ``d = 2``). Members of a list share fewer bytes than the minimum. Their shared positional bytes are tallied pair by
pair; pairs that reach the minimum are retained and verified by their Hamming distance.

A list longer than a bound is intersected further before it is gathered: its members are posted again under every choice
of the bytes that the minimum still lacks, which loses no pair. Such a list holds fingerprints that differ in ``8 * d``
given bits only, so its size has a fixed bound (65 536 for ``d = 2``) whatever the input. Only links to the smallest
member that is reachable inside a list leave it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Workspace, ascii_lower, lean, require

SHINGLE_SEED = 42


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of one text as UTF-8; 0 without words."""
    w = ascii_lower(raw).split()
    if not w:
        return 0
    if len(w) <= width:
        grams: Iterator[bytes] = iter([b" ".join(w)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(width))))
        n = len(w) - width + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SHINGLE_SEED)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        set_bits += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every document; null and word-free texts have 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def link_list(fp: np.ndarray, distance: int, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest reachable fingerprint) inside one posting list of distinct fingerprints.

    Lists of at most ``most`` members tally the shared positional bytes of all their pairs. In longer ones, which share
    the minimum already, each member looks up every value within the distance in the bits that the list leaves free, so
    the work is the list's length times a constant.
    """
    fp = np.unique(fp)
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    if n <= most:
        i, j = np.nonzero(retained(fp[:, None], fp[None, :], distance))
    else:
        varied = np.bitwise_or.reduce(fp ^ fp[0])
        bits = [np.uint64(1) << np.uint64(b) for b in range(64) if int(varied) >> b & 1]
        flips = [np.bitwise_xor.reduce(np.array(c, np.uint64)) for k in range(1, distance + 1) for c in combinations(bits, k)]
        left, right = [], []
        for flip in flips:
            at = np.searchsorted(fp, fp ^ flip)
            hit = np.flatnonzero((at < n) & (fp[np.minimum(at, n - 1)] == fp ^ flip))
            left.append(hit)
            right.append(at[hit])
        i, j = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def retained(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs share the minimum of positional bytes and, of those, differ in at most ``distance`` bits."""
    x = a ^ b
    tally = np.zeros(x.shape, np.int8)
    for p in range(8):
        tally += (x >> np.uint64(8 * p)) & np.uint64(0xFF) == 0
    keep = tally >= 8 - distance
    keep[keep] = np.bitwise_count(x[keep]) <= distance
    return keep


def postings(distance: int) -> dict[int, list[int]]:
    """The byte masks to post under and, for each, those that cut its long lists down to the minimum of shared bytes."""

    def mask(positions: tuple[int, ...]) -> int:
        m = sum(0xFF << (8 * p) for p in positions)
        return m - (1 << 64) if m >> 63 else m

    runs = [tuple(r.tolist()) for r in np.array_split(np.arange(8), distance + 2)]
    out = {}
    for a, b in combinations(runs, 2):
        rest = [p for p in range(8) if p not in a + b]
        out[mask(a + b)] = [mask(a + b + c) for c in combinations(rest, max(0, 8 - distance - len(a + b)))]
    return out


def near_links(distinct: DataFrame, distance: int = 2, most: int = 512) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints (column fp) that have the components of all pairs within the distance.

    distance: at most 3 of the 64 bits, as look-ups in long lists grow with its power. most: length from which a list is intersected further; it changes no result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the distance must be from 0 to 3")
    if distance == 0:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    masks = postings(distance)

    def posts(under: Iterable[int]) -> Column:
        return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for m in under])

    posted = distinct.select("fp", F.explode(posts(masks)).alias("k")).select("fp", "k.*")
    long_lists = posted.groupBy("mask", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > most)
    further = F.array(F.struct("mask", "bytes"))
    for m, longer in masks.items():
        further = F.when(F.col("n").isNotNull() & (F.col("mask") == m), posts(longer)).otherwise(further)
    posted = posted.join(long_lists, ["mask", "bytes"], "left").select("fp", F.explode(further).alias("k"))
    lists = posted.groupBy("k.mask", "k.bytes").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))))
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            a, c = flat[two], flat[two + 1]
            ok = retained(a, c, distance)
            us, vs = [np.maximum(a, c)[ok]], [np.minimum(a, c)[ok]]
            for k in np.flatnonzero(size > 2):
                u, v = link_list(flat[ends[k] : ends[k + 1]], distance, most)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (us, vs)], ["u", "v"])

    return lists.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp long, component_id long)`` for every row of ``docs`` (doc_id, text).

    Fingerprints within ``distance`` bits are linked; component_id is the smallest doc_id reachable. Documents without
    words (null and empty texts too) have fingerprint 0, linked like any other. Rows that repeat a doc_id are kept, each
    with its own text's fingerprint. A null doc_id never becomes a component's id unless its component has no other;
    the row stays. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.table(fingerprints(docs, width), "fingerprints")
    distinct = work.table(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    nodes = connected_components(work, near_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = distinct.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = work.table(placed.join(low, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
