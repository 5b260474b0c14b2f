"""A digest of rows as a multiset: equal in any order, different when a row is doubled and another is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import sha256

LANES = ["lane_1", "lane_2", "lane_3", "lane_4"]
#: Sums of 64-bit lanes fit a decimal of 38 digits for 5 * 10^18 rows.
_WIDE = "decimal(28,0)"
_MODULUS = "cast(18446744073709551616 as decimal(20,0))"


def multiset_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """By group: n_rows and four lanes (decimal text), each the sum modulo 2^64 of a quarter of every row's whole SHA-256.

    A row is the JSON of ``columns`` in their order; nulls are left out. One aggregate with partial sums; no row is dropped
    or compared. No rows give no group, or n_rows 0 and lanes 0 without ``by``.
    """
    hashed = df.select(*by, sha256(F.to_json(F.struct(*columns))).alias("h"))
    lanes = [F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast(_WIDE).alias(n) for i, n in enumerate(LANES)]
    sums = hashed.select(*by, *lanes).groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in LANES])
    return sums.select(*by, "n_rows", *[(F.col(n) % F.expr(_MODULUS)).cast("decimal(20,0)").cast("string").alias(n) for n in LANES])


def same_rows(a: DataFrame, b: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """By group of either side: whether both hold the same rows as often, and what ``a`` holds."""
    left, right = multiset_digest(a, by, columns), multiset_digest(b, by, columns)
    other = right.select(*by, F.struct("n_rows", *LANES).alias("other"))
    both = left.withColumn("own", F.struct("n_rows", *LANES)).join(other, by, "full")
    return both.select(*by, F.col("own").eqNullSafe(F.col("other")).alias("same"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *LANES)
