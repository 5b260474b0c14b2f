"""Quality by importance resampling.

Two generative models over hashed word n-grams (one and two words, by default 10 007 buckets), one of the target texts,
one of all texts, give each document the mean log ratio of its n-grams' probabilities. Documents are then drawn without
replacement in proportion to their importance by Gumbel top-k: the ``k`` largest values of log weight plus Gumbel noise,
where the noise is a hash of the id. The k-th largest value is found by counting, in rounds of a histogram of fixed
size; keys never meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Block, Workspace, blocks, lean, lowered, require, shingle_hashes, span_hashes, words


def hashed(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and each pair of neighbouring words."""
    starts, ends, of = words(block)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z
    h = span_hashes(lowered(block.data), starts, ends)
    pair, at = shingle_hashes(h, of, 2)
    m = np.uint64(buckets)
    return np.concatenate((h % m, pair % m)).astype(np.int64), np.concatenate((of, of[at]))


def _kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of column key (finite doubles): each round counts a histogram of what is still in question."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        inside = keys.where(F.col("key").between(low, high))
        place = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / step)).cast("int")
        got = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high


def resample(docs: DataFrame, target: DataFrame, share: float = 0.8, buckets: int = 10_007, length: float = 64.0, most_targets: int = 20_000) -> DataFrame:
    """``(doc_id, log_weight, log_ratio, score, key, selected)`` for every row of ``docs`` (doc_id, text).

    target: doc_ids of the texts that the sample should be like; the target model is fitted on at most ``most_targets`` of
    them, the first by hash of the id, so that their ids can be sent to all tasks and no text is ever shuffled. The raw
    model counts all texts. Both have add-one smoothing. log_weight: the true log importance weight, the sum of
    log p_target - log p_raw over the document's n-grams; log_ratio: the mean of that, 0 without words. Documents are
    drawn by the tempered weight, log_ratio times ``length``, so that long texts are not favoured (a text of ``length``
    n-grams has its true weight). score: the tempered weight w as w / (1 + w). selected: whether the document is among the
    ceil(share * rows) largest of tempered log weight plus Gumbel noise; ties stay together. The noise is a hash of the id,
    or of the text where there is no id. Null texts are empty ones; without targets, all weights are equal; an empty
    table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "importance")
    id_type = dict(docs.dtypes)["doc_id"]
    ids = require(target, "doc_id").where(F.col("doc_id").isNotNull()).distinct().select(F.col("doc_id").cast(id_type))
    chosen = work.table(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_targets), "targets")
    rows = require(docs, "doc_id", "text")

    @lean
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            flag = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for block in blocks(b.column(0)):
                bucket, of = hashed(block, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[flag[block.first + of]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    # At most ``most_targets`` ids are broadcast.
    flagged = rows.join(F.broadcast(chosen.withColumn("good", F.lit(True))), "doc_id", "left").select("text", "good")
    sums = flagged.mapInArrow(tally, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # at most ``buckets`` rows
    raw, good = np.ones(buckets), np.ones(buckets)
    for r in sums:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum()) if good.sum() > buckets else np.zeros(buckets)

    @lean
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, n = [], []
            for block in blocks(b.column(1)):
                bucket, of = hashed(block, buckets)
                n.append(np.bincount(of, minlength=block.n))
                weight.append(np.bincount(of, ratio[bucket], minlength=block.n))
            if n:
                w, many = np.concatenate(weight), np.concatenate(n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w), pa.array(w / np.maximum(many, 1))], ["doc_id", "noise", "log_weight", "log_ratio"])

    source = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    weighed = rows.withColumn("noise", F.xxhash64(source, F.lit("gumbel"))).mapInArrow(weigh, f"doc_id {id_type}, noise long, log_weight double, log_ratio double")
    uniform = (F.pmod("noise", F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = work.table(weighed.withColumn("key", F.col("log_ratio") * length - F.log(-F.log(uniform))).drop("noise"), "keys")
    n = keyed.count()
    names = ["doc_id", "log_weight", "log_ratio"]
    if not n:
        return keyed.select(*names, F.lit(0.0).alias("score"), "key", F.lit(False).alias("selected"))
    bar = _kth_largest(keyed, max(1, math.ceil(share * n)))
    return keyed.select(*names, (1 / (1 + F.exp(-F.col("log_ratio") * length))).alias("score"), "key", (F.col("key") >= bar).alias("selected"))
