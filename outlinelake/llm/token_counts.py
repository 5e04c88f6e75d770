"""Token counts: the exact histogram of encoded lengths and its suffix sums.

From the histogram alone follow, for every context limit, the documents that reach it, the tokens that a cut at the
limit keeps, and every quantile of length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.llm.common import materialize, text_or_empty
from outlinelake.llm.tokenizer import vocabulary, word_ids

#: Lengths to a bucket of the two-level sums: no window holds more rows than this, or than there are buckets.
BUCKET = 4096


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            sizes: dict[int, int] = {}
            for packed in words.packed(batch.column(0).to_pylist()):
                sizes[len(packed) // 2] = sizes.get(len(packed) // 2, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) of every encoded length that occurs.

    docs: text; other columns are ignored. Null or empty text has no tokens, which is a length too. Repeated rows count
    each time. An empty table gives no rows. The histogram is written to the shared folder, so that texts are encoded once.
    """
    found = docs.select(text_or_empty().alias("text")).mapInArrow(_lengths(path or vocabulary()), "n_tokens long, n_docs long")
    return materialize(found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what the suffix sums say.

    Columns: n_tokens (the limit), n_docs (of just this length), docs_at_least, tokens_at_least, docs_up_to, quantile
    (share of documents no longer than it), truncated_tokens (all tokens if every document is cut at the limit) and
    total_tokens. Limits between two lengths follow by linear interpolation of truncated_tokens. histogram has each
    length once; its other columns are ignored. An empty table gives no rows.
    """
    rows = histogram.select("n_tokens", "n_docs").withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    buckets = rows.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    sums = buckets.select("bucket", F.coalesce(F.sum("b_docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("b_tokens").over(above), zero).alias("tokens_above"), F.sum("b_docs").over(everything).alias("all_docs"), F.sum("b_tokens").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, "bucket").withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("tokens_above") + F.sum("tokens").over(inside))
    docs_up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", docs_up_to.alias("docs_up_to"), (docs_up_to / F.col("all_docs")).alias("quantile"), (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"), "total_tokens")
