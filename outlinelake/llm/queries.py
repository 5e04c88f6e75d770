"""The ten operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outlinelake.llm import oracles
from outlinelake.llm.common import table
from outlinelake.llm.decontamination import contaminated_spans
from outlinelake.llm.fingerprints import fingerprints
from outlinelake.llm.licenses import known_digests, scan_licenses
from outlinelake.llm.mixing import mix_by_source
from outlinelake.llm.ngram_join import jaccard_classes
from outlinelake.llm.quality import judge
from outlinelake.llm.secrets import scan_secrets
from outlinelake.llm.suffix_dedup import repeated_spans
from outlinelake.llm.token_counts import context_limits, length_histogram
from outlinelake.llm.token_output import token_output


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "bits", "threshold", "keep")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_token_counts, op3_quality, op4_fingerprints, op5_suffix_dedup, op6_decontamination, op7_licenses, op8_token_output, op9_ngram_join, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL lacks the tokenizer, the hashes, the alignment or the flow, or is too slow on whole tables; tests/llm has small fixtures for them."""
    return {"op7_licenses": oracles.licenses(), "op9_ngram_join": oracles.NGRAM_JOIN}
