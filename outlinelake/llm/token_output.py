"""Token-ID output: documents in ascending id order, entropy-coded in independent blocks.

Ids are written once, packed; their counts over all documents give the one frequency table that every block uses.
Documents are then dealt by range of doc_id and sorted, and every task codes its documents into blocks of whole
documents. A file is a row of the output folder's Parquet table: partition, number within it, and the block's bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.llm import rans
from outlinelake.llm.common import materialize, scratch_path, text_or_empty
from outlinelake.llm.tokenizer import vocabulary, word_ids

#: Tokens that close a block.
BLOCK = 1 << 20

_IDS = "doc_id long, n_tokens long, ids binary"
_FILES = "part int, number int, n_docs long, n_tokens long, block binary"
_DOCS = "part int, number int, place long, doc_id long, before long, n_tokens long, ids_crc32 long"


def _tokenized(path: str, end_id: int):
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                packed = [p + end for p in words.packed(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(p) // 2 for p in packed], pa.int64()), pa.array([pa.compress(p, codec="zstd", asbytes=True) for p in packed], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    for n, blob in zip(batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
        yield pa.decompress(blob.as_buffer(), decompressed_size=2 * n, codec="zstd", asbytes=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        held = b"".join(_unpacked(batch))
        counts += np.bincount(np.frombuffer(held, "<u2"), minlength=1 << 16)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["id", "n"])


def _blocks(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = rans.Tables(freq)
        docs: list[tuple[int | None, bytes]] = []
        held = number = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(p for _, p in docs), "<u2")
            block = rans.pack_block(np.array([i or 0 for i, _ in docs]), np.array([i is not None for i, _ in docs]), np.array([len(p) // 2 for _, p in docs]), ids, tables)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block], pa.binary())], names=["part", "number", "n_docs", "n_tokens", "block"])

        part = 0
        for batch in batches:
            for doc, ids, part in zip(batch.column("doc_id").to_pylist(), _unpacked(batch), batch.column("part").to_pylist(), strict=True):
                docs.append((doc, ids))
                held += len(docs[-1][1]) // 2
                if held >= BLOCK:
                    yield close()
                    docs, held, number = [], 0, number + 1
        if docs:
            yield close()

    return run


def _decoded(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = rans.Tables(freq)
        for batch in batches:
            for part, number, blob in zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), batch.column("block"), strict=True):
                doc_ids, known, sizes, ids = rans.unpack_block(blob.as_py(), tables)
                ends = np.cumsum(sizes)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(doc_ids, pa.int64(), mask=~known), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=[x.split()[0] for x in _DOCS.split(", ")])

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> np.ndarray:
    """Write the files of all documents below `folder`, and the frequency table beside them; returns the table.

    Null or empty text is just the end id. A null doc_id comes first; repeated ids are ordered by their token ids. An
    empty table writes no block.
    """
    spark = docs.sparkSession
    ids = materialize(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(_tokenized(path or vocabulary(), end_id), _IDS), "ids")
    counts = np.zeros(1 << 16, dtype=np.int64)
    for row in ids.select("n_tokens", "ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    freq = rans.quantised(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")
    parts = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids").withColumn("part", F.spark_partition_id())
    parts.mapInArrow(_blocks(freq), _FILES).write.parquet(f"{folder}/blocks")
    return freq


def read_tokens(spark, folder: str) -> DataFrame:
    """Decode the files: a row for each document with its place, first id's place (start), n_tokens and ids_crc32."""
    freq = np.zeros(1 << 16, dtype=np.int64)
    for row in spark.read.parquet(f"{folder}/frequencies").collect():
        freq[row["id"]] = row["frequency"]
    files = spark.read.schema(_FILES).parquet(f"{folder}/blocks")
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition
    before, total = {}, 0
    for row in sizes:
        before[row["part"]] = total
        total += row["n"]
    by_part = spark.createDataFrame([(int(p), int(n)) for p, n in before.items()], "part int, part_start long")
    inner = files.groupBy("part", "number").agg(F.max("n_tokens").alias("n"))
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = inner.select("part", "number", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")).alias("block_start")).join(by_part, "part").select("part", "number", (F.col("block_start") + F.col("part_start")).alias("block_start"))
    found = files.select("part", "number", "block").mapInArrow(_decoded(freq), _DOCS)
    return found.join(starts, ["part", "number"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "number", "place")


def token_output(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the documents' ids and read them back; columns as read_tokens()."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end_id)
    return read_tokens(docs.sparkSession, folder)
