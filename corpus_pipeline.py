"""A training corpus from documents: quality, near duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlinelake.llm.common import scratch_path, table
from outlinelake.llm.decontamination import without_contaminated
from outlinelake.llm.mixing import mix_by_source
from outlinelake.llm.ngram_join import jaccard_classes
from outlinelake.llm.quality import classify
from outlinelake.llm.token_output import token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's trusted documents admit.

    Null and empty texts are rejected, null languages and ids judged all the same; repeated rows stay or go together.
    Without labels all other documents stay; an empty table stays empty.
    """
    return classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near copies.

    Documents without words link with nothing and stay. Of repeated rows one stays, rows of one doc_id with different
    texts all stay if any of them is the least, and rows without a doc_id stay. An empty table stays empty.
    """
    classes = jaccard_classes(docs)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together; an empty benchmark removes nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a part of a copy counts from half on.

    A null source is a source; texts without words are not taken. Repeated rows are taken alike; an empty table stays empty.
    """
    copies = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    rows = mix_by_source(docs).where("size > 0").withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files; null and empty texts are just the end id, repeated rows each have a place."""
    return token_output(docs, scratch_path(spark, "corpus")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", tokens),
]

#: SQL can't express the language model, the alignment or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of sf_dir; extra columns of the table are left out at the start."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
