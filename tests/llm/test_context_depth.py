"""The context trees keep their depth however many different strings the training texts hold."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import lm


def test_depth_does_not_fall_with_the_size(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(bytes(range(33, 65)) + bytes(range(91, 127)), np.uint8)
    rows = [(i, rng.choice(letters, 100_000).tobytes().decode()) for i in range(48)]
    # After "zqx" always "j"; after "qx" alone nearly never.
    rows += [(100, "zqxj " * 5000), (101, "yqxk " * 50000)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.lit(True))
    bits = {r["doc_id"]: r["bits_per_byte"] for r in got.where("doc_id >= 100").collect()}
    assert bits[100] < 0.3, bits
