"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm import chat, context_mixing, cotraining, decontamination, divergence, licenses, line_rules, mixing, near_dedup, private_data, repeats, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *line_rules.MEASURES, "base_failed", "removed_words", "kept")


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.tilings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_file", "_row")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.locate(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_cotraining": op1_cotraining, "op2_lsh_forest": op2_lsh_forest, "op3_line_frequency": op3_line_frequency, "op4_role_repair": op4_role_repair, "op5_warc_round_trip": op5_warc_round_trip, "op6_suffix_dedup": op6_suffix_dedup, "op7_source_mix": op7_source_mix, "op8_string_tiling": op8_string_tiling, "op9_license_scan": op9_license_scan, "op10_context_mixing": op10_context_mixing, "op11_source_divergence": op11_source_divergence, "op12_embedding_whitening": op12_embedding_whitening, "op13_private_data": op13_private_data}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_frequency": line_rules.ORACLE, "op5_warc_round_trip": warc.ORACLE, "op7_source_mix": mixing.ORACLE, "op11_source_divergence": divergence.ORACLE}
