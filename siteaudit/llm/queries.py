"""The queries of the corpus operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteaudit.llm import (byte_bpe, byte_cnn, decontaminate, divergence, license_templates, ngram_join, personal_data,
                           piece_counts, projection_forest, quality_trees, sharding, vector_codes, zip_archives)
from siteaudit.llm.common import table
from siteaudit.llm.oracles import ORACLES  # noqa: F401


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op1_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.license_report(table(spark, sf_dir, "documents"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify_documents(table(spark, sf_dir, "documents"))


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"),
                                     tokenizer_pattern())


def op7_heap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.nearest_embeddings(table(spark, sf_dir, "embeddings"))


def op9_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_archives.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_contextual_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_embeddings(table(spark, sf_dir, "embeddings"))


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_combinations, op2_latent_retrieval, op3_license_templates, op4_byte_cnn, op5_rendezvous, op6_merge_replay, op7_heap_counts,
    op8_projection_forest, op9_zip_archives, op10_contextual_extraction, op11_source_divergence, op12_anchor_codes, op13_quality_trees,
    pipeline)}
