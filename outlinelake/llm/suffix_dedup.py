"""Substring dedup: bytes covered by a long string that also starts elsewhere.

A suffix matters only through its first `window` bytes. Every such window has a least 48-byte gram (by hash), equal
windows have equal ones, and neighbouring windows mostly share theirs. So the table of suffixes is kept as runs of
neighbouring window starts under their gram, which stands for the leading tokens that deal suffixes out. Grams that
occur once can't have equal windows; the runs of the others are shipped with their text, dealt by sampled splitters
over the gram, and each bucket sorts its suffixes by multikey sort: by their first eight bytes, then, among equals, by a
64-bit fingerprint of the whole window; neighbours that agree in both are compared byte by byte. Equal grams never lie
across a boundary, so no suffix is left to compare there.

A gram may stand in a large share of all documents, as that of a common passage does. The runs of such a hot gram aren't
brought together: they are packed into chunks, each chunk sends the distinct 128-bit fingerprints of its windows, dealt by
their value, and gets back those that occur in other chunks too, or twice in its own.

Documents with equal texts are one document here; a copy makes every window of a text a repeated one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlinelake.llm.common import materialize, mix, text_or_empty

WINDOW = 400
GRAM = 48
#: Bytes worked on at a time, and about so many bytes of runs in a bucket.
CHUNK = 1 << 20
BUCKET = 24 << 20
#: A gram with more bytes of runs than this is hot.
HOT = 8 << 20
#: Ranges that splitters part; with more buckets, a range is dealt into parts by the gram's hash.
RANGES = 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xD1342543DE82EF95
_RUNS = "doc_id long, digest binary, n_bytes long, sha256 string, grams array<bigint>, starts array<int>, sizes array<int>, weights array<int>"


def _sliding(a: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every `width` neighbours, from prefix and suffix sums within blocks."""
    n = len(a)
    if n < width:
        return a[:0]
    padded = np.full(-(-n // width) * width, fill, dtype=a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def _string_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of every string of `width` bytes, built by doubling."""
    if len(data) < width:
        return np.empty(0, dtype=_U)
    have = mix(data.astype(_U) + _U(1))
    out, done, size, bits = None, 0, 1, width
    while bits:
        if bits & 1:
            out = have if out is None else out[: len(have) - done] * _U(pow(base, size, 1 << 64)) + have[done:]
            done += size
        bits >>= 1
        if bits:
            have = have[:-size] * _U(pow(base, size, 1 << 64)) + have[size:]
            size *= 2
    return mix(out[: len(data) - width + 1])


def _runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its runs of window starts: gram, start, size, and weight: 2 if the gram occurs twice in the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    span = WINDOW - GRAM + 1
    grams = _string_hashes(data, GRAM)
    least = _sliding(grams, span, np.minimum, np.iinfo(_U).max)
    empty = np.empty(0, np.int64)
    if not len(least):
        return [(empty,) * 4 for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(least))
    valid = at + WINDOW <= ends[owner[: len(least)]]
    masked = np.concatenate((np.zeros(span - 1, _U), np.where(valid, least, _U(0)), np.zeros(span - 1, _U)))
    chosen = np.flatnonzero(_sliding(masked, span, np.maximum, 0) == grams)
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(least)))
    starts, lengths = starts[valid[starts]], lengths[valid[starts]]
    name = lambda gram, text: mix(gram ^ mix(text.astype(_U) + _U(1)))
    names, times = np.unique(name(grams[chosen], owner[chosen]), return_counts=True)
    weights = np.minimum(2, times[np.searchsorted(names, name(least[starts], owner[starts]))]) if len(starts) else empty
    cuts = np.searchsorted(owner[starts], np.arange(len(texts) + 1))
    begins = ends - sizes
    return [(least[starts[a:b]].view(np.int64), starts[a:b] - begins[i], lengths[a:b], weights[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RUNS.split(", ")]
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        at, group, size = 0, [], 0
        for i in range(batch.num_rows):
            group.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                found = _runs(group)
                lists = [pa.array([f[k] for f in found], pa.list_(pa.int64() if not k else pa.int32())) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids[at : i + 1] if isinstance(ids, pa.Array) else ids.slice(at, i + 1 - at), pa.array([hashlib.md5(t).digest() for t in group], pa.binary()), pa.array([len(t) for t in group], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in group]), *lists], names=names)
                at, group, size = i + 1, [], 0


def _cut_out(splitters: list[int], parts: int):
    """The text of each run but those of hot grams, from its first window's start to its last one's end, with its bucket: a range of grams, or a part of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(splitters, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                rows: list[tuple] = []
                for digest, text, runs in zip(some.column("digest").to_pylist(), some.column("text").to_pylist(), some.column("runs").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    rows += [(r["gram"], digest, r["start"], raw[r["start"] : r["start"] + r["size"] + WINDOW - 1]) for r in runs if not r["hot"]]
                if rows:
                    gram, digest, start, raws = zip(*rows, strict=True)
                    key = np.array(gram, dtype=np.int64)
                    bucket = np.searchsorted(edges, key, side="right") * parts + (mix(key.view(_U)) % _U(parts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(gram, pa.int64()), pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(raws, pa.binary())], names=["bucket", "gram", "digest", "start", "run"])

    return run


def _same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    """Whether the windows that begin at left and right are pairwise equal; pairs that go on side by side are compared at once."""
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(left) != 1) | (np.diff(right) != 1))))
    ends = np.append(new[1:], len(left))
    return all(np.array_equal(data[left[a] : left[b - 1] + WINDOW], data[right[a] : right[b - 1] + WINDOW]) for a, b in zip(new, ends, strict=True))


def _repeated(data: np.ndarray, at: np.ndarray, lead: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """Which of the suffixes at these places have an equal one: sorted by their first bytes, then equals among them by fingerprint, then compared."""
    out = np.zeros(len(lead), dtype=bool)
    order = np.argsort(lead, kind="stable")
    ranked = lead[order]
    tie = np.zeros(len(lead), dtype=bool)
    tie[1:] = ranked[1:] == ranked[:-1]
    tie[:-1] |= tie[1:]
    tied = order[tie]
    group = np.cumsum(np.concatenate(([True], ranked[tie][1:] != ranked[tie][:-1])) if len(tied) else np.empty(0, bool))
    inner = np.lexsort((finger[tied], group))
    f, g, tied = finger[tied][inner], group[inner], tied[inner]
    same = np.zeros(len(tied), dtype=bool)
    same[1:] = (f[1:] == f[:-1]) & (g[1:] == g[:-1])
    pairs = np.flatnonzero(same)
    if len(pairs) and not _same_bytes(data, at[tied[pairs - 1]], at[tied[pairs]]):  # a fingerprint of two texts: by bytes alone
        by_bytes: dict[bytes, list[int]] = {}
        for k in tied:
            by_bytes.setdefault(data[at[k] : at[k] + WINDOW].tobytes(), []).append(k)
        out[[k for some in by_bytes.values() if len(some) > 1 for k in some]] = True
        return out
    same[:-1] |= same[1:]
    out[tied] = same
    return out


def _windows(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs joined; where each window begins in them, and in which run; where each run begins."""
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    counts = sizes - WINDOW + 1
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.frombuffer(b"".join(runs), dtype=np.uint8), at, np.repeat(np.arange(len(sizes)), counts), first


def _covered(repeated: np.ndarray, at: np.ndarray, run: np.ndarray, first: np.ndarray, digests: list[bytes], starts: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """The byte ranges of their documents that repeated windows cover, one for each stretch within a run."""
    mark = np.concatenate(([0], repeated.astype(np.int8), [0]))
    edge = np.ones(len(at) + 1, dtype=bool)
    edge[1:-1] = run[1:] != run[:-1]
    begin = np.flatnonzero((mark[1:-1] == 1) & ((mark[:-2] == 0) | edge[:-1]))
    stop = np.flatnonzero((mark[1:-1] == 1) & ((mark[2:] == 0) | edge[1:]))
    for b, e in zip(begin, stop, strict=True):
        k = run[b]
        base = starts[k] - first[k]
        yield digests[k], int(at[b] + base), int(at[e] + base) + WINDOW


def _ranges(rows: list[tuple[bytes, int, int]]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())]


def _compare(group: pa.Table) -> pa.Table:
    """Of one bucket, the byte ranges that repeated windows cover, a row for each range within a run."""
    group = group.sort_by("gram")
    digests, starts, runs, grams = group.column("digest").to_pylist(), group.column("start").to_numpy(), group.column("run").to_pylist(), group.column("gram").to_numpy()
    out: list[tuple] = []
    lo = 0
    while lo < len(runs):  # whole grams, about a slice at a time
        hi, size = lo, 0
        while hi < len(runs) and (size < CHUNK * 4 or grams[hi] == grams[hi - 1]):
            size += len(runs[hi])
            hi += 1
        data, at, run, first = _windows(runs[lo:hi])
        words = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
        lead = np.ascontiguousarray(words).view(">u8").ravel().astype(_U)
        repeated = _repeated(data, at, lead, _string_hashes(data, WINDOW)[at])
        out += _covered(repeated, at, run, first, digests[lo:hi], starts[lo:hi])
        lo = hi
    return pa.table(_ranges(out), names=["digest", "first", "last"])


def _hot_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hot grams in chunks of about CHUNK bytes."""
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0

    def chunk() -> pa.RecordBatch:
        digests, starts, runs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([digests], pa.list_(pa.binary())), pa.array([starts], pa.list_(pa.int32())), pa.array([runs], pa.list_(pa.binary()))], names=["chunk", "digests", "starts", "runs"])

    for batch in batches:
        for i in range(batch.num_rows):
            raw = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            for r in batch.column("runs")[i].as_py():
                if r["hot"]:
                    rows.append((batch.column("digest")[i].as_py(), r["start"], raw[r["start"] : r["start"] + r["size"] + WINDOW - 1]))
                    size += len(rows[-1][2])
                    if size >= CHUNK:
                        yield chunk()
                        number, rows, size = number + 1, [], 0
    if rows:
        yield chunk()


_PRINT = np.dtype([("a", "<u8"), ("b", "<u8"), ("twice", "u1")])


def _prints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of a chunk by their 128-bit fingerprints, and which of them each window is."""
    keys = np.empty(len(at), dtype=[("a", "<u8"), ("b", "<u8")])
    keys["a"], keys["b"] = _string_hashes(data, WINDOW)[at], _string_hashes(data, WINDOW, _OTHER_BASE)[at]
    order = np.lexsort((keys["b"], keys["a"]))
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    which = np.empty(len(at), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    found = np.zeros(int(new.sum()), dtype=_PRINT)
    found["a"], found["b"] = ranked["a"][new], ranked["b"][new]
    found["twice"] = np.bincount(which, minlength=len(found)) > 1
    return found, which


def _sent(parts: int):
    """Of each chunk its distinct fingerprints, dealt by their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, runs in zip(batch.column("chunk").to_pylist(), batch.column("runs"), strict=True):
                data, at, *_ = _windows(runs.as_py())
                found, _ = _prints(data, at)
                part = (found["a"] % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([found[order[cuts[p] : cuts[p + 1]]].tobytes() for p in some], pa.binary())], names=["part", "chunk", "prints"])

    return run


def _met(group: pa.Table) -> pa.Table:
    """Of one part, what each chunk's repeated windows are: those of two chunks, or twice in one."""
    held = [np.frombuffer(x.as_py(), dtype=_PRINT) for x in group.column("prints")]
    every = np.concatenate(held)
    order = np.lexsort((every["b"], every["a"]))
    a, b = every["a"][order], every["b"][order]
    same = np.zeros(len(every), dtype=bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    same[:-1] |= same[1:]
    repeated = every["twice"] > 0
    repeated[order] |= same
    cuts = np.cumsum([0, *map(len, held)])
    back = [every[lo:hi][repeated[lo:hi]].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([group.column("chunk"), pa.array(back, pa.binary())], names=["chunk", "prints"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges that repeated windows cover, of chunks with what came back for them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("digests", "starts", "runs", "prints")}
            data, at, run, first = _windows(row["runs"])
            found, which = _prints(data, at)
            back = np.frombuffer(b"".join(row["prints"]), dtype=_PRINT)
            both = np.concatenate((found, back))
            order = np.lexsort((both["b"], both["a"]))  # stable: what came back follows its own print
            hit = np.zeros(len(both), dtype=bool)
            a, b = both["a"][order], both["b"][order]
            hit[order[:-1]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            rows = list(_covered(hit[: len(found)][which], at, run, first, row["digests"], np.array(row["starts"])))
            yield pa.RecordBatch.from_arrays(_ranges(rows), names=["digest", "first", "last"])


def _hot_ranges(cut: DataFrame, windows: int) -> DataFrame:
    """What _compare finds, for the runs of hot grams."""
    chunks = materialize(cut.mapInArrow(_hot_chunks, "chunk long, digests array<binary>, starts array<int>, runs array<binary>"), "hot")
    parts = max(1, math.ceil(windows * _PRINT.itemsize / BUCKET))
    sent = chunks.mapInArrow(_sent(parts), "part int, chunk long, prints binary")
    back = sent.groupBy("part").applyInArrow(_met, "chunk long, prints binary").groupBy("chunk").agg(F.collect_list("prints").alias("prints"))
    return chunks.join(back, "chunk").mapInArrow(_marked, "digest binary, first int, last int")


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["first"], r["last"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, text, ranges in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw, spans = (text or "").encode("utf-8", "surrogatepass"), _merged(ranges)
            cuts = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((digest, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        d, n, k, s, x = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.string()), pa.array(x, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["digest", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """What to remove from each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes).

    docs: doc_id and text; other columns are ignored. Null text counts as empty; a text shorter than 400 bytes loses
    nothing. Repeated rows are copies of each other, so all their bytes go if they have 400 or more; every row has a
    row in the result. An empty table gives no rows. Windows are equal if their bytes are, and under grams with more than
    `hot` bytes of runs if their 128-bit fingerprints are.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    scanned = materialize(texts.mapInArrow(_scan, _RUNS), "runs")
    once = scanned.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first(F.arrays_zip(F.col("grams").alias("gram"), F.col("starts").alias("start"), F.col("sizes").alias("size"), F.col("weights").alias("weight"))).alias("runs"))
    each = once.select("digest", F.explode("runs").alias("r")).select("digest", F.col("r.gram").alias("gram"), F.col("r.start").alias("start"), F.col("r.size").alias("size"), F.col("r.weight").alias("weight"))
    shared = each.groupBy("gram").agg(F.sum("weight").alias("w"), F.sum(F.col("size").cast("long") + WINDOW).alias("volume")).where("w > 1").select("gram", (F.col("volume") > hot).alias("hot"))
    by_text = each.join(shared, "gram").groupBy("digest").agg(F.collect_list(F.struct("gram", "start", "size", "hot")).alias("runs"))
    held = texts.groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.first("text").alias("text"))
    cut = materialize(held.join(by_text, "digest"), "cut")
    total = lambda f: F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + f(r)))
    volume, hot_windows = cut.select(total(lambda r: F.when(r["hot"], 0).otherwise(r["size"] + WINDOW)), total(lambda r: F.when(r["hot"], r["size"]).otherwise(0))).first()
    n_buckets = max(16, math.ceil((volume or 0) / BUCKET))
    n_ranges = min(RANGES, n_buckets)
    cuts = cut.select(F.explode("runs").alias("r")).where("not r.hot").agg(F.percentile_approx("r.gram", [k / n_ranges for k in range(1, n_ranges)], 4 * RANGES)).first()[0] or []
    runs = cut.mapInArrow(_cut_out(sorted(set(cuts)), math.ceil(n_buckets / n_ranges)), "bucket int, gram long, digest binary, start int, run binary")
    ranges = runs.groupBy("bucket").applyInArrow(_compare, "digest binary, first int, last int")
    if hot_windows:
        ranges = ranges.unionByName(_hot_ranges(cut.where(F.exists("runs", lambda r: r["hot"])), hot_windows))
    found = ranges.groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    result = "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    part = cut.select("digest", "text").join(found, "digest").mapInArrow(_removed, result)
    copied = once.where(f"copies > 1 and n_bytes >= {WINDOW}").select("digest", F.lit(True).alias("copied"))
    rows = scanned.select("doc_id", "digest", "n_bytes", "sha256").join(copied, "digest", "left").join(part, "digest", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(F.col("copied"), whole).otherwise(F.col("spans")).alias("spans"),
    )
