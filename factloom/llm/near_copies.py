"""Near-copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, none missed.

SimHash alone cannot promise that: at 0.8 two fingerprints differ in some ten of their 64 bits, and beyond seven no byte
need be shared. Prefix filtering does: under one order of all shingles, two sets as similar as asked share a shingle of
their first ``n - ceil(similarity * n) + 1`` each. Every order is right; shingles frequent in a sample come last, so that
few sets meet in vain. Fingerprints within two bits and neighbours in the lists of these shingles, as many as there are
rows, are the first candidates and join most groups; then all pairs of a list meet that are not joined yet. All candidates
are verified by their exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .passages import in_sketch, sketch
from .shared import Workspace, blocks, lean, lowered, mix, shingle_hashes, span_hashes, words
from .simhash import fingerprint, near_links


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    for block in blocks(texts):
        starts, ends, of = words(block)
        h = span_hashes(lowered(block.data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        s, at = shingle_hashes(h, of, width)
        bounds = np.searchsorted(of, np.arange(block.n + 1))
        inner = np.searchsorted(at, bounds)
        for i in range(block.n):
            a, b = bounds[i], bounds[i + 1]
            if 0 < b - a < width:
                yield shingle_hashes(h[a:b], of[a:b], int(b - a))[0]
            else:
                yield np.unique(s[inner[i] : inner[i + 1]])


def _least(n: np.ndarray, share: Fraction) -> np.ndarray:
    """The smallest whole number that is at least ``share`` of ``n``."""
    return -(-n * share.numerator // share.denominator)


#: 64-bit words of a set's parity map in a list, and of the one that candidates are looked up in, which tells longer sets apart.
WORDS, WIDE = 8, 64


def parity(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each of 64 * ``words`` classes of shingles whether a set has an odd number of it.

    Two sets differ in at least as many shingles as their maps differ in bits, which is an exact bound for a pair's similarity.
    """
    odd = np.bincount((mix(s) >> np.uint64(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, side: np.ndarray, *maps: np.ndarray, similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one shingle's sets, of different roots, that may be similar by their sizes, the places of the shingle and their parity maps.

    side: 0 for all, or 1 and 2 for two blocks, of which only pairs across are wanted. maps: the words of the maps.
    """
    order = np.lexsort((node, n))
    node, n, pos, root, side = node[order], n[order], pos[order], root[order], side[order]
    bits = np.stack(maps, axis=1)[order] if maps else np.zeros((len(n), 1), np.int64)
    both, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    for i in range(len(node) - 1):
        end = int(np.searchsorted(n, n[i] * similarity.denominator // similarity.numerator, "right"))
        j = np.arange(i + 1, end)
        ok = (root[j] != root[i]) & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= _least(n[i] + n[j], both))
        if side[i]:
            ok &= side[j] != side[i]
        j = j[ok]
        if len(j):
            j = j[np.bitwise_count((bits[j] ^ bits[i]).view(np.uint64)).sum(axis=1, dtype=np.int64) * apart.denominator <= (n[i] + n[j]) * apart.numerator]
            yield np.maximum(node[i], node[j]), np.minimum(node[i], node[j])


def blocked(rows: DataFrame, similarity: Fraction, most: int) -> DataFrame:
    """``rows`` (h, node, n, pos, root) once for each block or pair of blocks of its list that it is in: key and side.

    A list of at most ``most`` rows is one block. A longer one is cut by size, so that similar sets have equal or
    neighbouring size classes, and each class by a hash into blocks of about ``most`` rows; every block meets itself, the
    other blocks of its class and those of the next class. No pair of similar sets is lost, and no task gathers a list.
    """
    size = F.floor(F.log("n") / math.log(1.001 / float(similarity))).cast("int")
    classes = rows.withColumn("k", size).groupBy("h", "k").agg(F.count("*").alias("c"))
    total = Window.partitionBy("h")
    classes = classes.withColumn("k", F.when(F.sum("c").over(total) > most, F.col("k"))).groupBy("h", "k").agg(F.ceil(F.sum("c") / most).cast("int").alias("m"))
    by_class = Window.partitionBy("h").orderBy("k")
    near = lambda f, step: F.when(f("k").over(by_class) == F.col("k") + step, f("m").over(by_class)).otherwise(0)
    classes = classes.select("h", "k", "m", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"))
    long = classes.where("k is not null").withColumnRenamed("h", "lh")
    marked = rows.withColumn("k0", size)
    own = marked.join(long, (marked["h"] == long["lh"]) & (marked["k0"] == long["k"]), "left").drop("lh", "k0")
    own = own.withColumn("b", F.pmod(F.xxhash64("node"), F.coalesce("m", F.lit(1))).cast("int"))
    key = lambda k, low, high, i, j, side: F.struct(k.alias("k"), low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), side.alias("side"))
    span = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda x: x < n)
    zero, b, k = F.lit(0), F.col("b"), F.col("k")
    same = F.transform(span(F.col("m")), lambda j: key(k, zero, zero, F.least(b, j), F.greatest(b, j), F.when(j == b, 0).when(b < j, 1).otherwise(2)))
    up = F.transform(span(F.col("above")), lambda j: key(k, zero, F.lit(1), b, j, F.lit(1)))
    down = F.transform(span(F.col("below")), lambda j: key(k - 1, zero, F.lit(1), j, b, F.lit(2)))
    alone = F.array(key(F.lit(-1), zero, zero, zero, zero, zero))
    places = F.when(k.isNull(), alone).otherwise(F.concat(same, up, down))
    return own.withColumn("at", F.explode(places)).select(*rows.columns, F.struct("at.k", "at.high", "at.i", "at.j").alias("key"), F.col("at.side").alias("side"))


def chain_pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, seed: int, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours among one shingle's sets in an order drawn by ``seed``, if sizes and places allow them."""
    order = np.argsort(mix(node.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    i, j = order[:-1], order[1:]
    least = _least(n[i] + n[j], similarity / (1 + similarity))
    ok = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= least
    i, j = i[ok], j[ok]
    return np.maximum(node[i], node[j]), np.minimum(node[i], node[j])


def _frequent(rows: DataFrame, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of documents repeats, sorted, and how often; this decides the order only, not the result."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in shingle_sets(b.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64))], ["h"])

    share = max(1, rows.count() // sample)
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column(1).to_numpy()[order]


def verified(work: Workspace, rows: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (u, v) of rows whose shingle sets are as similar as asked; texts travel for those whose wide maps allow it."""
    apart = (1 - similarity) / (1 + similarity)
    side = lambda end, x: sets.select(F.col("row").alias(end), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    differ = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(differ * apart.denominator <= (F.col("na") + F.col("nb")) * apart.numerator)
    pairs = work.table(near.select("u", "v"), "near")
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    texts = in_sketch(rows.select(F.col("row").alias("doc_id"), "text"), sketch(ids))
    own = work.table(texts.join(ids, "doc_id", "left_semi"), "texts")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                # The join on v leaves the pairs of one v side by side: its set is made once.
                v = part.column(1).to_numpy()
                new = np.concatenate(([True], v[1:] != v[:-1]))
                of_v = shingle_sets(part.column(3).filter(pa.array(new)), width)
                ok = []
                for x, fresh in zip(shingle_sets(part.column(2), width), new, strict=True):
                    y = next(of_v) if fresh else y
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both * similarity.denominator >= similarity.numerator * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(own.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(own.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    return work.table(both.mapInArrow(run, "u long, v long"), "links")


def distinct_documents(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5), sample: int = 4_000, most_frequent: int = 100_000, block: int = 2048) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-copies: that of smallest doc_id.

    A group is all that is reachable by pairs of rows whose shingle sets have at least the similarity. A row is a node of
    its own, so that rows which share a doc_id count by their texts. Texts without words are alike. Rows without a
    doc_id stay. block: rows of a list that meet in one task, about. Null texts have no words; further columns may have any names; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "near-copies")
    names = docs.columns
    base = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own_id = F.col(f"_{names.index('doc_id')}")
    whole = work.table(base.where(own_id.isNotNull()).withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = whole.select("row", F.col(f"_{names.index('text')}").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(rows, width, sample, most_frequent))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for b in batches:
            fp, n, total, first, maps, wide = [], [], [], [], [], []
            for t, s in zip(b.column(1), shingle_sets(b.column(1), width), strict=True):
                fp.append(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width))
                n.append(len(s))
                maps.append(parity(s))
                wide.append(parity(s, WIDE))
                total.append(mix(s).sum(dtype=np.uint64))
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.lexsort((s, np.where(known[at] == s, times[at], 0)))]
                keep = len(s) - int(_least(np.int64(len(s)), similarity)) + 1
                first.append(s[:keep].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            cols = [b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(n, np.int64)), pa.array(np.array(total, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(maps, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "fp", "n", "total", "first", "map", "wide"])

    sets = work.table(rows.mapInArrow(run, "row long, fp long, n long, total long, first array<long>, map array<long>, wide array<long>"), "sets")
    # Equal sets are one node, the first row of them.
    same = sets.groupBy("n", "total").agg(F.min("row").alias("node"))
    node_of = work.table(sets.select("row", "n", "total", "fp").join(same, ["n", "total"]).select("row", "node", "fp"), "nodes")
    nodes = node_of.where("row = node").select("node", "fp")

    lows = work.table(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    close = near_links(lows.select("fp"), 2)
    close = close.join(lows.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u").join(lows.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
    close = close.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    equal = nodes.join(lows, "fp").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    first = sets.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", F.posexplode("first").alias("pos", "h"))
    # Lists of one set have no pairs: a sketch of the shared shingles keeps most of them from the shuffle. A list is never
    # gathered: blocks of it are.
    shared = work.table(first.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    posted = in_sketch(first.select(F.col("h").alias("doc_id"), "node", "n", "pos"), sketch(shared.select(F.col("h").alias("doc_id")))).withColumnRenamed("doc_id", "h")
    posted = work.table(posted.join(shared, "h"), "posted")
    lists = posted.groupBy("h", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / block)).alias("b")).agg(F.collect_list(F.struct("node", "n", "pos")).alias("m")).where(F.size("m") > 1).select("h", "m")

    def paired(each) -> Callable:
        """Runs ``each`` over the lists (h, m) and gives what pairs it yields."""

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            for b in batches:
                col = b.column(1)
                fields = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in col.flatten().flatten()]
                ends = np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                us, vs, held = [none], [none], 0
                for h, i, j in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                    for u, v in each(h, *(x[i:j] for x in fields)):
                        us.append(u)
                        vs.append(v)
                        held += len(u)
                        if held > 500_000:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                            us, vs, held = [none], [none], 0
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        return run

    # Few orders, so that the lists of one group give mostly the same pairs.
    chains = lists.mapInArrow(paired(lambda h, node, n, pos: [chain_pairs(node, n, pos, h & 3, similarity)]), "u long, v long")
    links = verified(work, rows, sets, work.table(close.union(equal).union(chains).distinct(), "close"), width, similarity)
    roots = connected_components(work, links)
    placed = posted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
    words_of = [f"w{i}" for i in range(WORDS)]
    maps = sets.select(F.col("row").alias("node"), *[F.col("map")[i].alias(w) for i, w in enumerate(words_of)])
    placed = work.table(placed.join(apart, "h", "left_semi").select("h", "node", "n", "pos", "root").join(maps, "node"), "apart")
    met = blocked(placed, similarity, block).groupBy("h", "key").agg(F.collect_list(F.struct("node", "n", "pos", "root", "side", *words_of)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y"))
    pairs = met.where("x < y").select("h", "m").mapInArrow(paired(lambda h, *fields: prefix_pairs(*fields, similarity=similarity)), "u long, v long").distinct()
    more = verified(work, rows, sets, work.table(pairs, "candidates"), width, similarity)
    roots = work.table(connected_components(work, links.union(more)), "roots")
    group = node_of.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    kept = whole.select("row", own_id.alias("doc_id")).join(group, "row").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("m")).select(F.col("m.row").alias("row"))
    kept = work.table(kept, "kept")
    work.clear(whole, kept)
    return whole.join(kept, "row", "left_semi").select(*base.columns).unionByName(base.where(own_id.isNull())).toDF(*names)
