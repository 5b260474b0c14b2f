"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filtering_lloyd, importance, language, lm, merkle, norm_buckets, oracle, packing, passages, permutation, quality_rules, simhash, tokens, toxicity, word_bpe
from .shared import remainder, worker_cache


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_encoder(path: str) -> Callable[[], Callable[[list], list]]:
    return lambda: worker_cache(f"byte_bpe:{path}", lambda: tokens.ByteBpe(path)).ids


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    found = language.predict(_documents(spark, sf_dir), training=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _documents(spark, sf_dir),
        byte_encoder(tokenizer_path("byte_bpe_50k.json")),
        capacity=1024,
        end_id=2,
        keep={"ids_crc32": F.crc32("ids")},
    )


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return importance.resample(_documents(spark, sf_dir), good)


def op5_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    found = toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), training=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(_documents(spark, sf_dir))


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_bpe.encode_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    found = lm.score(_documents(spark, sf_dir), training=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search_exact(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering_lloyd.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_byte_convnet,
            op2_best_two_fit,
            op3_permutation_index,
            op4_importance_resampling,
            op5_boosted_trees,
            op6_simhash,
            op7_compact_windows,
            op8_forced_boundary_bpe,
            op9_cascade,
            op10_context_tree,
            op11_norm_buckets,
            op12_radix_trie,
            op13_filtering_lloyd,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; trained scores, packing, approximate searches, 64-bit text hashes and tokens are beyond it."""
    return {"op9_cascade": oracle.CASCADE_SQL, "op11_norm_buckets": oracle.TOP_SQL, "op12_radix_trie": oracle.manifest_sql(), "op13_filtering_lloyd": oracle.codes_sql()}
