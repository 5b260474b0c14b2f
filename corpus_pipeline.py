"""The corpus pipeline: five stages, each over all that the one before it kept.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import near_copies, packing, passages, quality_rules, toxicity
from factloom.llm.queries import byte_encoder, tokenizer_path
from factloom.llm.shared import Workspace


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training=F.lit(True))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-copies; rows without a doc_id stay."""
    return near_copies.distinct_documents(docs, width=5)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return passages.cut_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 ids."""
    return packing.pack(docs, byte_encoder(tokenizer_path("byte_bpe_50k.json")), capacity=1024, end_id=2, keep={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("toxicity", civil),
    ("quality rules", good),
    ("SimHash near-dedup", distinct),
    ("substring dedup", cut),
    ("best-fit packing", packed),
]

# Trained scores, 64-bit text hashes, passages and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = work.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        work.drop(before)
        before = docs = after
    return docs
