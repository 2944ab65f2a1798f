"""The queries of this folder's operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.best_fit import best_fit
from tallyspark.llm.common import documents
from tallyspark.llm.decontaminate import leaks
from tallyspark.llm.importance import resample
from tallyspark.llm.jaccard_join import jaccard_classes
from tallyspark.llm.license_scan import license_scan
from tallyspark.llm.line_dedup import line_dedup
from tallyspark.llm.merkle import manifest
from tallyspark.llm.oracle import IMPORTANCE, MERKLE
from tallyspark.llm.piece_codec import piece_digests
from tallyspark.llm.quality_classifier import quality_scores
from tallyspark.llm.quality_rules import quality_rules
from tallyspark.llm.sharding import interleave
from tallyspark.llm.suffix_dedup import remove_repeats
from tallyspark.llm.token_counts import token_counts
from tallyspark.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_exact", "n_near", F.octet_length("text").cast("long").alias("kept_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id", F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", "sentences").alias("sentences"),
        F.concat_ws(",", "unmatched").alias("unmatched"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir), 3, 90)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit": op5_best_fit,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_piece_codec": op13_piece_codec,
}

# DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op11_importance_resampling": IMPORTANCE,
    "op12_merkle_manifest": MERKLE,
}
