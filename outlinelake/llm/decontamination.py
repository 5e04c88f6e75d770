"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are folded to lower case, with every run of other characters than letters and digits as one space. An item is
covered by overlapping probes, so that a long enough part of it holds a whole probe. A text region within e edits of a
probe of m characters shares at least m + 1 - q * (e + 1) q-grams with it, on diagonals that differ by at most e. Shared
q-grams are therefore counted in overlapping diagonal bands; bands that reach the bound are aligned within the band.
Items too short for this are found where the whole folded item stands between word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlinelake.llm.common import mix, text_or_empty

Q = 10
PROBE = 96
STEP = 48
#: Edits that are allowed, as a share of a probe's length.
ERRORS = 0.06
#: Shorter folded items are looked for as a whole, without edits.
LEAST_ITEM = 40
#: Folded characters of the benchmark that one pass over the documents indexes; longer benchmarks take several.
BLOCK = 4_000_000
#: Code points worked on at a time.
CHUNK = 1 << 20
#: Shared q-grams that are spread out at a time, about.
HITS = 4_000_000
_FILTER_BITS = 22
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

_SPANS = "doc_id long, item_id long, start long, end long, n_probes int, edits int"


def _fold_table() -> np.ndarray:
    """Folded code point of each code point; 0x20 for all that is neither letter nor digit."""
    table = np.full(0x110000, 0x20, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_tables: dict[str, np.ndarray] = {}


def _fold(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of a text, and the place of each in it."""
    if "fold" not in _tables:
        _tables["fold"] = _fold_table()
    chars = _tables["fold"][np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = chars == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = not space[0]
    places = np.flatnonzero(keep)
    return chars[places], places


def _gram_hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of each run of Q characters, built by doubling."""
    if len(chars) < Q:
        return np.empty(0, dtype=_U)
    power = lambda n: _U(pow(_BASE, n, 1 << 64))
    one = mix(chars.astype(_U) + _U(1))
    out, width, have, size = None, 0, one, 1
    bits = Q
    while bits:
        if bits & 1:
            out = have if out is None else out[: len(have) - width] * power(size) + have[width:] if len(have) > width else out
            width += size
        bits >>= 1
        if bits:
            have = have[:-size] * power(size) + have[size:]
            size *= 2
    return mix(out[: len(chars) - Q + 1])


class Probes:
    """Index of a block of benchmark items: q-grams, and where they stand in which probe."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items, texts = [], []
        self.short: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            chars, _ = _fold(text)
            chars = chars[: len(chars) - int(len(chars) > 0 and chars[-1] == 0x20)]
            if len(chars) < LEAST_ITEM:
                if len(chars):
                    self.short.setdefault(len(chars), {}).setdefault(chars.astype(np.uint32).tobytes(), []).append(item)
                continue
            starts = list(range(0, max(1, len(chars) - PROBE + 1), STEP))
            if len(chars) > PROBE and starts[-1] + PROBE < len(chars):
                starts.append(len(chars) - PROBE)
            for s in starts:
                self.items.append(item)
                texts.append(chars[s : s + PROBE])
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.edits = (self.size * ERRORS).astype(np.int64)
        self.bound = np.maximum(1, self.size + 1 - Q * (self.edits + 1))
        self.chars = np.zeros((len(texts), PROBE), dtype=np.uint32)
        for i, t in enumerate(texts):
            self.chars[i, : len(t)] = t
        hashes = [_gram_hashes(t) for t in texts]
        flat = np.concatenate(hashes) if hashes else np.empty(0, _U)
        probe = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.probe, self.place = probe[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.grams >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text place, probe and place in the probe of every shared q-gram, in windows of the text.

        Windows overlap by more than a band's q-grams of one probe reach, so that each such group is whole in one of them.
        """
        maybe = np.flatnonzero(self.filter[(hashes >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.grams, hashes[maybe])
        at[at == len(self.grams)] = 0
        same = self.grams[at] == hashes[maybe] if len(self.grams) else np.zeros(0, bool)
        maybe, at = maybe[same], at[same]
        upto = np.concatenate(([0], np.cumsum(self.count[at])))
        overlap = PROBE + 2 * (int(PROBE * ERRORS) + 1)
        lo = 0
        while lo < len(maybe):
            hi = int(np.searchsorted(upto, upto[lo] + HITS, side="right")) - 1
            hi = max(hi, int(np.searchsorted(maybe, maybe[lo] + 2 * overlap)))
            n = self.count[at[lo:hi]]
            spread = np.repeat(self.first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(maybe[lo:hi], n), self.probe[spread], self.place[spread]
            lo = len(maybe) if hi >= len(maybe) else int(np.searchsorted(maybe, maybe[hi] - overlap))


def _aligned(chars: np.ndarray, first: np.ndarray, last: np.ndarray, probes: Probes, probe: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each probe and a region of its own text, chars[first:last], on its diagonals low to low + width - 1, and where that region ends."""
    size, edits = probes.size[probe], probes.edits[probe]
    width = int((2 * (edits + 1)).max()) + 2 * int(edits.max()) + 1
    low = low - edits
    lanes = np.arange(width)
    far = 1 << 20
    cost = np.zeros((len(probe), width), dtype=np.int64)
    cost[(low[:, None] + lanes < first[:, None]) | (low[:, None] + lanes > last[:, None])] = far
    final = cost.copy()
    for i in range(int(size.max())):
        at = low[:, None] + lanes + i  # the text place that meets probe character i on each diagonal
        inside = (at >= first[:, None]) & (at < last[:, None])
        letter = chars[np.clip(at, 0, max(0, len(chars) - 1))]
        step = cost + np.where(inside, (letter != probes.chars[probe, np.minimum(i, PROBE - 1)][:, None]).astype(np.int64), far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a probe character without a partner
        for k in range(1, width):  # a text character without a partner
            step[:, k] = np.minimum(step[:, k], step[:, k - 1] + np.where(inside[:, k], 1, far))
        cost = np.minimum(step, far)
        done = size == i + 1
        final[done] = cost[done]
    best = np.argmin(final, axis=1)
    return final[np.arange(len(probe)), best], low + best + size


def _regions(chars: np.ndarray, owners: np.ndarray, bounds: np.ndarray, probes: Probes) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, probe, start, end, edits), places in chars, of each probe found in each text of a buffer; some more than once."""
    for place, probe, inner in probes.hits(_gram_hashes(chars)):
        yield from _banded(chars, owners, bounds, probes, place, probe, inner)


def _banded(chars: np.ndarray, owners: np.ndarray, bounds: np.ndarray, probes: Probes, place: np.ndarray, probe: np.ndarray, inner: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    text = owners[place]
    inside = place + Q <= bounds[text + 1]  # a q-gram across two texts is none
    place, probe, inner, text = place[inside], probe[inside], inner[inside], text[inside]
    if not len(place):
        return
    half = probes.edits[probe] + 1
    diagonal = place - inner + PROBE  # never negative
    band = diagonal // half
    for shift in (0, 1):  # bands are two halves wide and overlap by one
        both = np.stack((text, probe, band - shift))
        if shift == 0:
            keys = both
        else:
            keys = np.concatenate((keys, both), axis=1)
    order = np.lexsort(keys)
    keys = keys[:, order]
    new = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    count = np.diff(np.append(new, keys.shape[1]))
    text, probe, band = keys[:, new]
    strong = count >= probes.bound[probe]
    text, probe, band = text[strong], probe[strong], band[strong]
    for at in range(0, len(text), 4096):
        t, p, b = text[at : at + 4096], probe[at : at + 4096], band[at : at + 4096]
        low = b * (probes.edits[p] + 1) - PROBE
        edits, end = _aligned(chars, bounds[t], bounds[t + 1], probes, p, low)
        for j in np.flatnonzero(edits <= probes.edits[p]):
            lo = max(int(end[j] - probes.size[p[j]]), int(bounds[t[j]]))
            yield int(t[j]), int(p[j]), lo, min(int(end[j]), int(bounds[t[j] + 1])), int(edits[j])


def _whole(chars: np.ndarray, owners: np.ndarray, bounds: np.ndarray, short: dict[int, dict[bytes, list]]) -> Iterator[tuple[int, int | None, int, int]]:
    """(text, item, start, end), places in chars, of each short item that stands between word boundaries of a text."""
    if not short or not len(chars):
        return
    space = chars == 0x20
    first, last = ~space, ~space  # of a word
    first[1:] &= space[:-1] | (owners[1:] != owners[:-1])
    last[:-1] &= space[1:] | (owners[1:] != owners[:-1])
    begins = np.flatnonzero(first)
    for size, known in short.items():
        power = mix(np.arange(1, size + 1, dtype=_U) * _U(_BASE))
        digest = lambda rows: (rows.astype(_U) * power).sum(axis=1, dtype=_U)  # noqa: B023, E731
        at = begins[begins + size <= len(chars)]
        at = at[last[at + size - 1] & (owners[at] == owners[at + size - 1])]
        wanted = digest(np.stack([np.frombuffer(k, dtype=np.uint32) for k in known]))
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            windows = chars[some[:, None] + np.arange(size)]
            for j in np.flatnonzero(np.isin(digest(windows), wanted)):
                for item in known.get(windows[j].astype(np.uint32).tobytes(), ()):
                    yield int(owners[some[j]]), item, int(some[j]), int(some[j]) + size


def _found(texts: pa.Array, probes: Probes) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """(text, item, start, end, probes, edits) in code points of the texts, one row for each text and item."""
    at, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(_fold(text.as_py()))
        size += len(group[-1][0])
        if size >= CHUNK or i == len(texts) - 1:
            sizes = np.array([len(c) for c, _ in group])
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            chars = np.concatenate([c for c, _ in group])
            owners = np.repeat(np.arange(len(group)), sizes)
            merged: dict[tuple[int, int | None], list] = {}
            whole = ((t, -1, lo, hi, 0, item) for t, item, lo, hi in _whole(chars, owners, bounds, probes.short))
            parts = ((*region, probes.items[region[1]]) for region in _regions(chars, owners, bounds, probes))
            for t, p, lo, hi, edits, item in chain(parts, whole):
                places = group[t][1]
                first, last = int(places[lo - bounds[t]]), int(places[max(lo, hi - 1) - bounds[t]]) + 1
                row = merged.setdefault((t, item), [first, last, {}])
                row[0], row[1] = min(row[0], first), max(row[1], last)
                row[2][p] = min(edits, row[2].get(p, edits))
            for (t, item), (first, last, by_probe) in sorted(merged.items(), key=lambda x: (x[0][0], _by_id(x[0][1]))):
                yield at + t, item, first, last, len(by_probe), sum(by_probe.values())
            at, group, size = i + 1, [], 0


def _by_id(item: int | None) -> tuple[bool, int]:
    return item is not None, item or 0


def _spans(items: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = Probes(items)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[t], *rest) for t, *rest in _found(batch.column("text"), probes)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k > 3 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "item_id", "start", "end", "n_probes", "edits"])

    return run


def _clean(items: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = Probes(items)
        for batch in batches:
            mask = np.ones(batch.num_rows, dtype=bool)
            mask[[t for t, *_ in _found(batch.column("text"), probes)]] = False
            yield batch.filter(pa.array(mask))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size, read a partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).distinct()
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK:
            yield sorted(block, key=lambda x: (_by_id(x[0]), x[1]))
            block, size = [], 0
    if block:
        yield sorted(block, key=lambda x: (_by_id(x[0]), x[1]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents hold benchmark items: doc_id, item_id, start, end, n_probes, edits; one row for a document's row and item.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. start and end are code points, end
    exclusive, of the least region that covers all probes found. Null or empty text holds nothing; items with a null id
    are left out; those of fewer than 40 folded characters are found whole, between word boundaries, as one probe; repeated items count once, repeated documents are all reported. Empty tables
    give no rows. Of an item, any part of 144 folded characters is found within the edit budget of 6 %.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    out = spark.createDataFrame([], _SPANS)
    for block in _blocks(benchmark.where("item_id is not null")):
        out = out.unionByName(texts.mapInArrow(_spans(block), _SPANS))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item; items with a null id count too."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs
