"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence matrix.

The matrix is dealt into column blocks (ranges of shingle hashes), shipped as packed arrays. A block keeps only
the columns that two or more different rows share, and sends these back to the rows. Two size-derived bounds then
discard rows: a row can link only if it shares at least ceil(t * n) of its n shingles with others, and it need be
looked up only through its n - ceil(t * n) + 1 rarest shingles. For the rows and columns that are left, overlap
counts are taken between pairs. Links inside what is already one component add nothing to the classes, so rows are
first compared with one central row a column, and rows of different components only afterwards, a pair of blocks at a
time, of which only the links leave the task.

Rows with equal shingle sets are one row of the matrix, so groups of copies cost one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlinelake.llm.common import materialize, mix, release_words, shingle_sets, text_or_empty
from outlinelake.llm.components import components

#: Incidences in a column block, and in what a task packs at a time.
BLOCK = 2_500_000
CHUNK = 1_000_000
#: Rounds of stars before pairs between components are compared.
STAR_ROUNDS = 1
#: Rows in a block of a cluster, and columns in a slice of its dense product.
MEMBERS = 512
SLICE = 8192

_U = np.uint64
_KEYS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64())])
_BLOBS = pa.schema([("block", pa.int32()), ("packed", pa.binary())])
_ROWS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("columns", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position in the batch and shingle set of each text, with bounded work space."""
    texts, at = batch.column("text"), 0
    group: list[bytes] = []
    size = 0
    for i in range(len(texts)):
        raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").lower()
        group.append(raw)
        size += len(raw)
        if size >= 1 << 20 or i == len(texts) - 1:
            for found in shingle_sets(group, width):
                yield at, found
                at += 1
            group, size = [], 0


def _digest(found: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        total = mix(found ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(found)) * _U(0x14057B7EF767814F)
    return int(mix(np.array([total], dtype=_U)).view(np.int64)[0])


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [(_digest(s) if len(s) else None, len(s)) for _, s in _sets(batch, width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], schema=_KEYS)

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and length before it."""
    return b"".join(f"{a.dtype.str[1:]}:{len(a)};".encode() + a.tobytes() for a in arrays)


def _unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        end = blob.index(b";", at)
        kind, n = blob[at:end].decode().split(":")
        out.append(np.frombuffer(blob, dtype=kind, count=int(n), offset=end + 1))
        at = end + 1 + out[-1].nbytes
    return out


def _blocks_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """Column block: the hash's high half, scaled to the number of blocks."""
    return ((hashes >> _U(32)) * _U(n_blocks) >> _U(32)).astype(np.uint32)


def _deal(width: int, n_blocks: int):
    """Incidences of each distinct row, packed by column block: row names, row sizes, row of each, low half of each hash."""

    def emit(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(rows, dtype=np.int64, count=len(rows))
        sizes = np.fromiter((len(s) for s in rows.values()), dtype=np.uint32, count=len(rows))
        hashes = np.concatenate(list(rows.values()))
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
        blocks = _blocks_of(hashes, n_blocks)
        order = np.argsort(blocks, kind="stable")
        hashes, owner = hashes[order].astype(np.uint32), owner[order]
        cuts = np.searchsorted(blocks[order], np.arange(n_blocks + 1))
        names, blobs = [], []
        for b in range(n_blocks):
            if cuts[b] < cuts[b + 1]:
                held, counts = np.unique(owner[cuts[b] : cuts[b + 1]], return_counts=True)
                names.append(b)
                blobs.append(_pack(keys[held], sizes[held], counts.astype(np.uint32), hashes[cuts[b] : cuts[b + 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        rows: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, found in _sets(batch, width):
                if len(found) and (key := _digest(found)) not in rows:
                    rows[key] = found
                    held += len(found)
                    if held >= CHUNK:
                        yield from emit(rows)
                        rows, held = {}, 0
        if rows:
            yield from emit(rows)

    return run


def _concat(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*tables, strict=True)]


def _shared_columns(n_row_blocks: int):
    """Of one column block, the columns of two rows or more, packed by row block."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        keys, sizes, counts, hashes = _concat([_unpack(x.as_py()) for x in group.column("packed")])
        names, first, dense = np.unique(keys, return_index=True, return_inverse=True)
        sizes = sizes[first]
        cells = np.unique(hashes.astype(_U) << _U(32) | np.repeat(dense.astype(_U), counts))
        column = (cells >> _U(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1]))) if len(column) else np.empty(0, np.int64)
        rows_in = np.diff(np.append(starts, len(column)))
        keep = np.repeat(rows_in >= 2, rows_in)
        df = np.repeat(np.minimum(rows_in, 65535).astype(np.uint16), rows_in)[keep]
        column, row = column[keep], (cells[keep] & _U(0xFFFFFFFF)).astype(np.int64)
        home = (names.view(_U) % _U(n_row_blocks)).astype(np.int64)
        order = np.lexsort((row, home[row]))
        column, row, df = column[order], row[order], df[order]
        cuts = np.searchsorted(home[row], np.arange(n_row_blocks + 1))
        out = []
        for b in range(n_row_blocks):
            part = slice(cuts[b], cuts[b + 1])
            if cuts[b] < cuts[b + 1]:
                held, counts = np.unique(row[part], return_counts=True)
                out.append((b, _pack(names[held], sizes[held], counts.astype(np.uint32), column[part], df[part], np.array([block], np.uint32))))
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_BLOBS)

    return run


def _candidate_rows(share: float):
    """Rows of one row block that share enough columns to link with any other; columns rarest first."""

    def run(group: pa.Table) -> pa.Table:
        keys, sizes, counts, columns, dfs = [], [], [], [], []
        for blob in group.column("packed"):
            k, n, c, low, df, block = _unpack(blob.as_py())
            keys.append(k), sizes.append(n), counts.append(c), dfs.append(df)
            columns.append(low.astype(_U) | _U(block[0]) << _U(32))
        key, size, count, column, df = (np.concatenate(x) for x in (keys, sizes, counts, columns, dfs))
        names, first, dense = np.unique(key, return_index=True, return_inverse=True)
        size = size[first].astype(np.int64)
        shared = np.bincount(dense, weights=count, minlength=len(names)).astype(np.int64)
        least = np.ceil(size * share - 1e-9).astype(np.int64)
        stays = shared >= np.maximum(least, 1)
        owner = np.repeat(dense, count)
        keep = stays[owner]
        owner, column, df = owner[keep], column[keep], df[keep]
        order = np.lexsort((mix(column), df, owner))
        column = column[order].view(np.int64)
        held = np.flatnonzero(stays)
        offsets = np.concatenate(([0], np.cumsum(shared[held]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(column, pa.int64()))
        return pa.table([pa.array(names[held], pa.int64()), pa.array(size[held], pa.int32()), pa.array(shared[held], pa.int32()), lists], schema=_ROWS)

    return run


def _verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose overlap reaches the bound; overlap counts need only the shared columns."""
    left = rows.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("columns").alias("of_a"))
    right = rows.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("columns").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("of_a", "of_b")).cast("long"))
    return both.where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("n_a").cast("long") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _sizes_agree(percent: int):
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return F.lit(100) * small.cast("long") >= F.lit(percent) * large.cast("long")


def _block_links(percent: int):
    """Links between rows of one pair of blocks that are of different components, by a dense product over their common columns."""

    def run(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_numpy()
        keys, comps, sizes = (group.column(c).to_numpy() for c in ("key", "comp", "n"))
        lists = group.column("columns").combine_chunks()
        offsets = lists.offsets.to_numpy()
        cells, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(keys)), np.diff(offsets))
        names, column, times = np.unique(cells, return_inverse=True, return_counts=True)
        useful = times[column] > 1
        owner, column = owner[useful], column[useful]
        names, column = np.unique(column, return_inverse=True)
        left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        place = np.empty(len(keys), dtype=np.int64)
        overlap = np.zeros((len(left), len(right)), dtype=np.float32)
        for lo in range(0, len(names), SLICE):
            inside = (column >= lo) & (column < lo + SLICE)
            sides = []
            for side in (left, right):
                place[:] = -1
                place[side] = np.arange(len(side))
                dense = np.zeros((len(side), min(SLICE, len(names) - lo)), dtype=np.float32)
                own = inside & (place[owner] >= 0)
                dense[place[owner[own]], column[own] - lo] = 1
                sides.append(dense)
            overlap += sides[0] @ sides[1].T
        overlap = overlap.astype(np.int64)
        union = sizes[left][:, None].astype(np.int64) + sizes[right][None, :] - overlap
        linked = (100 * overlap >= percent * union) & (comps[left][:, None] != comps[right][None, :])
        i, j = np.nonzero(linked)
        return pa.table([pa.array(keys[left[i]], pa.int64()), pa.array(keys[right[j]], pa.int64())], names=["a", "b"])

    return run


def _stars(rows: DataFrame, state: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links of every column's rows to the column's most central row, the one with the fewest shingles of its own."""
    alone = (F.col("n") - F.col("shared")) / F.col("n") * (1 + F.pmod(F.xxhash64(F.lit(turn), F.col("key")), F.lit(turn + 1)))
    rank = F.struct(alone.alias("alone"), F.xxhash64(F.lit(turn), F.col("key")).alias("r"), F.col("key"), F.col("n"), F.col("comp"))
    hubs = state.groupBy("column").agg(F.min(rank).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    met = state.join(hubs.select("column", "hub"), "column").where("comp <> hub.comp").select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))
    return _verified(rows, met.where(_sizes_agree(percent)).select("a", "b").distinct(), percent)


def _between_components(rows: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """All links between rows of different components that share a prefix column.

    Rows that prefix columns connect form a cluster. A cluster's rows are dealt into blocks, those of its largest
    component apart from the others, and every pair of blocks with others in it is one small matrix product.
    """
    lows = state.groupBy("column").agg(F.min("key").alias("low"))
    cluster = components(state.join(lows, "column").select(F.col("key").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    members = state.select("key", "comp").distinct().join(cluster, "key")
    sizes = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("in_main"), F.sum("m").alias("in_all"))
    placed = members.join(sizes, "cluster").withColumn("outer", F.ceil((F.col("in_all") - F.col("in_main")) / MEMBERS).cast("int")).withColumn("inner", F.ceil(F.col("in_main") / MEMBERS).cast("int")).where("outer > 0")
    is_main = F.col("comp") == F.col("main")
    block = F.when(is_main, F.col("outer") + F.pmod(F.xxhash64("key"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("key"), F.col("outer"))).cast("int")
    partners = F.sequence(F.lit(0), F.when(is_main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    dealt = placed.withColumn("block", block).select("key", "comp", "cluster", "block", F.explode(partners).alias("other"))
    pairs = dealt.select("key", "comp", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.join(rows.select("key", "n", "columns"), "key").groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "a long, b long")


def _row_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between rows, enough of them that their components are those of all links."""
    share = percent / 100
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1 - (F.col("n") - F.col("shared"))).cast("int")
    posts = materialize(rows.withColumn("prefix", prefix).where("prefix > 0").select("key", "n", "shared", F.explode(F.slice("columns", F.lit(1), F.col("prefix"))).alias("column")), "posts")
    state = posts.withColumn("comp", F.col("key"))
    links = None
    for turn in range(STAR_ROUNDS):
        found = _stars(rows, state, percent, turn)
        links = materialize(found if links is None else links.union(found), "links")
        comp = components(links)
        state = posts.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
        open_columns = state.groupBy("column").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("column")
        state = materialize(state.join(open_columns, "column", "left_semi"), "state")
    return materialize(links.union(_between_components(rows, state, percent)), "links")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents whose shingle sets reach a Jaccard similarity of percent / 100.

    docs: any table with doc_id and text; other columns are ignored. Returns one row per row of docs: doc_id,
    n_shingles, component_id (least doc_id reachable by links) and class_key (the shingle set's name, null without
    words). Null or empty text has no shingles and links with nothing. Repeated rows come out as often as they came in.
    A null doc_id takes part in links, and a class without any other id has a null component_id. An empty table gives
    no rows. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    keyed = materialize(texts.mapInArrow(_keys(width), "doc_id long, key long, n_shingles long"), "keyed")
    sets = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    if not total:
        return keyed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("key").alias("class_key"))
    n_blocks = max(16, math.ceil(total / BLOCK))
    blobs = texts.select("text").mapInArrow(_deal(width, n_blocks), "block int, packed binary")
    shared = blobs.groupBy("block").applyInArrow(_shared_columns(n_blocks), "block int, packed binary")
    rows = materialize(shared.groupBy("block").applyInArrow(_candidate_rows(percent / 100), "key long, n int, shared int, columns array<bigint>"), "rows")
    links = _row_links(rows, percent)
    comp = components(links)
    named = sets.join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "comp").select("key", "component_id")
    return keyed.join(classes, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("key").alias("class_key"))
