"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted documents.

Counts of character 4-grams over all trusted text are summed by gram. Their suffixes give the continuation counts of the
lower orders, their contexts the discounted mass; joins of these tables give each gram seen its probability, and each
context its backoff weight. Any code point is a symbol, below the unigrams lies an equal share for each.

Documents meet the model chunk by chunk: of a chunk's distinct grams, those in the model's most frequent rows (a bounded
number, broadcast) are looked up at once. If the model has more rows than that, all other grams are joined with the
whole model in shards by their keys, and the sums of a document's two parts are its bits. Documents whose perplexity lies
above their language's quantile of the trusted documents are rejected. As a model has fewer bits for text that it was
trained on, that quantile is taken of what each half of the trusted documents costs under a model of the other half.

Toxic text is found by words, as a document's mean hides it: two more models, of the documents labelled toxic and of
those labelled not toxic, are compared over each word. Documents whose most toxic words together speak for the toxic
model by more bits than the trusted documents' quantile are rejected, however good the rest of their text is. Words with
grams that the broadcast rows can't settle are left open, and their grams are joined with the whole two models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlinelake.llm.common import materialize, mix, release_memory, release_words, rows_at_a_time, text_or_empty

ORDER = 4
#: Code points that share what the unigrams leave.
CODE_POINTS = 0x110000
#: Share of a language's trusted documents that its threshold admits. A quantile of n documents is raised by 1 / sqrt(n)
#: bits, which it is unsure by. A character's bits have a standard deviation of about 2, a mean over n characters one of
#: 2 / sqrt(n); SPREAD / sqrt(n), three of these, is taken off each document's bits first.
QUANTILE = 0.995
SPREAD = 6.0
#: Words that may tell a toxic document, the share of the trusted documents that its limit admits (which the models were
#: trained on), and how many bits above that quantile a document is still kept.
TOXIC_WORDS = 5
TOXIC_QUANTILE = 0.998
TOXIC_MARGIN = 2.0
#: With fewer documents labelled toxic there is no model of toxic text, and none is rejected as such.
LEAST_TOXIC = 20
#: Rows of each model that are broadcast, 16 bytes each. The others are joined.
FREQUENT = 1 << 20
#: Code points worked on at a time.
CHUNK = 1 << 20
#: Rows of texts in an Arrow batch, which a task takes from Spark at a time; and of counts before a task sums them up.
ROWS = 500
HELD = 1 << 19
#: Numbers of codes up to which they are told apart by direct address.
DENSE = 1 << 25
SCORES = ("bits", "adjusted_bits", "toxic_bits")

#: The models, by the labelled documents that each is trained on; the halves are those of the trusted ones, by text.
TRUSTED, TOXIC, HARMLESS, HALF, OTHER_HALF = MODELS = range(5)
#: Documents that are neither trusted nor toxic. Counts are taken of four classes, of which the models are sums.
REST = 5
CLASSES = {TOXIC: (TOXIC,), HALF: (HALF, TRUSTED, HARMLESS), OTHER_HALF: (OTHER_HALF, TRUSTED, HARMLESS), REST: (HARMLESS,)}
#: Those that score whole texts; the other two are compared over words.
SCORING = (TRUSTED, HALF, OTHER_HALF)
WORDWISE = (TOXIC, HARMLESS)
_GRAM = ("a", "b", "c", "d")
_COUNTS = "model int, a int, b int, c int, d int, n long"
_SCORED = "doc_id long, lang string, digest long, row long, n_chars long, own double, other double, toxic_bits double, rest array<struct<model:int,a:int,b:int,c:int,d:int,n:int>>, most array<double>, open array<struct<word:int,bits:double>>, spelled array<struct<word:int,a:int,b:int,c:int,d:int,n:int>>"
_U = np.uint64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The rank of each code below size among those that occur, and their number."""
    if size > DENSE:
        seen, ranks = np.unique(codes, return_inverse=True)
        return ranks, len(seen)
    there = np.zeros(size, dtype=bool)
    there[codes] = True
    seen = np.flatnonzero(there)
    ranks = np.empty(size, dtype=np.int32)
    ranks[seen] = np.arange(len(seen))
    return ranks[codes].astype(np.int64), len(seen)


class Chunk:
    """Some texts: their code points, where each text begins and ends, their distinct grams, and which of these ends at each code point."""

    def __init__(self, points: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in points], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.points = np.concatenate(points)
        self.owner = np.repeat(np.arange(len(points)), self.sizes)
        pad = np.zeros(ORDER - 1, dtype=np.uint32)
        flat = np.concatenate([x for p in points for x in (pad, p)])
        own = np.arange(len(self.points)) + (ORDER - 1) * (self.owner + 1)  # place in flat
        symbol, n = _ranked(flat.astype(np.int64), CODE_POINTS)
        rank, kinds = symbol[own - ORDER + 1], n
        for back in range(ORDER - 2, -1, -1):
            rank, kinds = _ranked(rank * n + symbol[own - back], kinds * n)
        last = np.zeros(kinds, dtype=np.int64)
        last[rank] = own
        self.grams = np.stack([flat[last - back] for back in range(ORDER - 1, -1, -1)]).astype(np.int64)
        self.which = rank


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, Chunk]]:
    """Groups of texts of about CHUNK code points, with the first one's place; a longer text is a group of its own."""
    at, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(_code_points(text))
        size += len(group[-1])
        if size >= CHUNK or i == len(texts) - 1:
            yield at, Chunk(group)
            at, group, size = i + 1, [], 0


def _keys(model: int, *symbols: np.ndarray) -> np.ndarray:
    """64-bit names of a model's grams, of as many symbols as given; without any, of the empty context."""
    name = np.full(len(symbols[0]) if symbols else 1, (model + 1) * 8 + len(symbols), dtype=_U)
    for s in symbols:
        name = mix(name * _U(0x9E3779B97F4A7C15) + s.astype(_U) + _U(1))
    return mix(name)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by class of the grams of text, summed up within a task."""
    release_words()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        rows, n = np.concatenate([r for r, _ in held], axis=1), np.concatenate([x for _, x in held])
        names = _keys(0, *rows)
        _, first, same = np.unique(names, return_index=True, return_inverse=True)
        return rows[:, first], np.bincount(same, weights=n, minlength=len(first)).astype(np.int64)

    def batch_of(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in rows), pa.array(n, pa.int64())], names=["model", *_GRAM, "n"])

    size = 0
    for batch in _slices(batches):
        models = batch.column("models").to_pylist()
        for at, chunk in _chunks(batch.column("text").to_pylist()):
            for model in CLASSES:
                trains = np.array([model in some for some in models[at : at + len(chunk.sizes)]])
                n = np.bincount(chunk.which, weights=trains[chunk.owner], minlength=chunk.grams.shape[1]).astype(np.int64)
                seen = np.flatnonzero(n)
                held.append((np.concatenate((np.full((1, len(seen)), model), chunk.grams[:, seen])), n[seen]))
                size += len(seen)
            if size >= HELD:
                held = [summed()]
                size = len(held[0][1])
                if size >= HELD // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
        release_memory()
    if held:
        yield batch_of(*summed())


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney's discounts for counts of 1, 2, and 3 or more."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.95, 2.95), strict=True)]


def _named(rows: DataFrame, symbols: tuple[str, ...]) -> DataFrame:
    """rows (model, the symbols, weight, log2p, backoff) by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, names = batch.column("model").to_numpy(), np.empty(batch.num_rows, dtype=_U)
            for model in MODELS:
                own = np.flatnonzero(models == model)
                names[own] = _keys(model, *(batch.column(s).to_numpy()[own] for s in symbols))
            yield pa.RecordBatch.from_arrays([batch.column("model"), pa.array(names.view(np.int64), pa.int64()), *(batch.column(c) for c in ("weight", "log2p", "backoff"))], names=["model", "key", "weight", "log2p", "backoff"])

    return rows.mapInArrow(run, "model int, key long, weight long, log2p double, backoff double")


def model_rows(counts: DataFrame) -> DataFrame:
    """The models as rows (model, key, weight, log2p, backoff): log2 of a gram's probability, and of its weight as a context.

    counts: model, a, b, c, d and n, each gram of a model once. A gram that is only one of the two has null for the other.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy("model", *_GRAM[ORDER - k :]).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    rows, lower = None, None
    contexts: dict[int, DataFrame] = {}
    probable: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        symbols = _GRAM[ORDER - k :]
        tally = tables[k].groupBy("model").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # a row for each model
        cut = F.lit(0.0)
        for r in tally:
            d = _discounts(r["n1"], r["n2"], r["n3"], r["n4"])
            cut = F.when(F.col("model") == r["model"], F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(cut)
        sums = tables[k].withColumn("cut", cut).groupBy("model", *symbols[:-1]).agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        contexts[k] = materialize(sums.select("model", *symbols[:-1], "total", (F.col("cuts") / F.col("total")).alias("mass")), f"contexts-{k}")
        joined = tables[k].withColumn("cut", cut).join(contexts[k], ["model", *symbols[:-1]])
        if lower is None:
            joined = joined.withColumn("lower", F.lit(1 / CODE_POINTS))
        else:
            joined = joined.join(lower.select("model", *symbols[1:], F.col("p").alias("lower")), ["model", *symbols[1:]])
        lower = probable[k] = materialize(joined.select("model", *symbols, "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("mass") * F.col("lower")).alias("p")), f"probable-{k}")
    for k in range(ORDER + 1):
        symbols = _GRAM[ORDER - k :]
        grams = probable[k].select("model", *symbols, F.col("n").alias("weight"), F.log2("p").alias("log2p")) if k else None
        heads = None
        if k < ORDER:  # the context of the next order, under the names of a gram
            heads = contexts[k + 1].select("model", *[F.col(x).alias(y) for x, y in zip(_GRAM[ORDER - k - 1 : ORDER - 1], symbols, strict=True)], F.col("total").alias("total"), F.log2("mass").alias("backoff"))
        if grams is None:
            both = heads.select("model", F.col("total").alias("weight"), F.lit(None).cast("double").alias("log2p"), "backoff")
        elif heads is None:
            both = grams.withColumn("backoff", F.lit(None).cast("double"))
        else:
            both = grams.join(heads, ["model", *symbols], "full").select("model", *symbols, (F.coalesce("weight", F.lit(0)) + F.coalesce("total", F.lit(0))).alias("weight"), "log2p", "backoff")
        named = _named(both, symbols)
        rows = named if rows is None else rows.unionByName(named)
    return rows


class Model:
    """The models' rows: all of them as a table, and the most frequent ones of each sorted by key, with whether these are all of the model's."""

    def __init__(self, rows: DataFrame, frequent: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], whole: dict[int, bool], tells_toxic: bool):
        self.rows, self.frequent, self.whole, self.tells_toxic, self._shared = rows, frequent, whole, tells_toxic, None

    def shared(self, spark):
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast((self.frequent, self.whole, self.tells_toxic))
        return self._shared


def train(labelled: DataFrame, frequent: int = FREQUENT) -> Model:
    """labelled: text, and models: the classes that it is of. Without trusted text all code points are equally probable."""
    grams = labelled.select(text_or_empty().alias("text"), "models").mapInArrow(_gram_counts, _COUNTS)
    with rows_at_a_time(labelled.sparkSession, ROWS):
        classes = materialize(grams.groupBy("model", *_GRAM).agg(F.sum("n").alias("n")), "classes")
    of = F.create_map(*[x for c, models in CLASSES.items() for x in (F.lit(c), F.array(*map(F.lit, models)))])
    counts = materialize(classes.withColumn("model", F.explode(of[F.col("model")])).groupBy("model", *_GRAM).agg(F.sum("n").alias("n")), "grams")
    rows = materialize(model_rows(counts), "model")
    sizes = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each model
    tables = {}
    for model in MODELS:
        own = rows.where(F.col("model") == model).select("key", "weight", "log2p", "backoff")
        if sizes.get(model, 0) > frequent:
            own = own.orderBy(F.desc("weight"), "key").limit(frequent)
        held = own.select("key", F.col("log2p").cast("float"), F.col("backoff").cast("float")).toArrow()  # at most `frequent` rows of 16 bytes
        keys = held.column("key").to_numpy().view(_U)
        order = np.argsort(keys)
        tables[model] = (keys[order], *(held.column(c).to_numpy()[order].astype(np.float32) for c in ("log2p", "backoff")))
    begins = counts.where("a = 0 and b = 0 and c = 0").groupBy("model").agg(F.sum("n").alias("n"))  # once a text
    texts = {r["model"]: r["n"] for r in begins.collect()}
    return Model(rows, tables, {m: sizes.get(m, 0) <= frequent for m in MODELS}, texts.get(TOXIC, 0) >= LEAST_TOXIC and HARMLESS in texts)


def _roles(grams: np.ndarray) -> list[tuple[str, tuple[np.ndarray, ...]]]:
    """What a gram is looked up as, from the longest on: itself, its context, its suffix, the suffix's context, and so on."""
    return [x for k in range(ORDER, 0, -1) for x in ((f"p{k}", tuple(grams[ORDER - k :])), (f"h{k}", tuple(grams[ORDER - k : ORDER - 1])))]


def _rows_of(keys: np.ndarray, values: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values by name in a table sorted by key, and which of the names have one."""
    if not len(keys):
        return np.zeros(len(names)), np.zeros(len(names), dtype=bool)
    at = np.searchsorted(keys, names)
    at[at == len(keys)] = 0
    found = values[at]
    return found, (keys[at] == names) & ~np.isnan(found)


def _looked_up(model: int, table: tuple[np.ndarray, np.ndarray, np.ndarray], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 probability of each gram by the rows of the table, and whether the gram itself is among them. What is found in one order isn't looked for in the lower ones."""
    keys, log2p, backoff = table
    n = grams.shape[1]
    out, seen, left = np.zeros(n), np.zeros(n, dtype=bool), np.arange(n)
    for k in range(ORDER, 0, -1):
        symbols = grams[ORDER - k :, left]
        value, hit = _rows_of(keys, log2p, _keys(model, *symbols))
        out[left[hit]] += value[hit]
        if k == ORDER:
            seen[hit] = True
        left, symbols = left[~hit], symbols[:-1, ~hit]
        value, hit = _rows_of(keys, backoff, np.broadcast_to(_keys(model, *symbols), len(left)))
        out[left[hit]] += value[hit]
    out[left] -= math.log2(CODE_POINTS)
    return out, seen


def _words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and which text it is of. A separator belongs to the word before it."""
    space = (points == 0x20) | ((points >= 9) & (points <= 13))
    begins = np.zeros(len(points), dtype=bool)
    begins[1:] = space[:-1]
    begins[starts[starts < len(points)]] = True
    first = np.flatnonzero(begins)
    return first, np.searchsorted(starts, first, side="right") - 1


def _most(sums: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOXIC_WORDS largest sums of each text, and its number, in the order of the texts."""
    order = np.lexsort((-sums, owner))
    sums, owner = sums[order], owner[order]
    most = np.arange(len(owner)) - np.searchsorted(owner, owner) < TOXIC_WORDS
    return sums[most], owner[most]


def _toxic_bits(grams: np.ndarray, tables: dict, whole: dict[int, bool]) -> tuple[np.ndarray, np.ndarray]:
    """By how many bits each gram speaks for the toxic model, none if neither model has seen its character; and whether
    that takes rows that are not broadcast, the bits being 0 then."""
    bits, known, later = np.zeros(grams.shape[1]), np.zeros(grams.shape[1], dtype=bool), np.zeros(grams.shape[1], dtype=bool)
    for model, sign in ((TOXIC, 1), (HARMLESS, -1)):
        log2p, seen = _looked_up(model, tables[model], grams)
        bits += sign * log2p
        known |= seen | np.isin(_keys(model, grams[-1]), tables[model][0])
        if not whole[model]:
            later |= ~seen
    return np.where(known & ~later, bits, 0), later


def _lists(n: int, owner: np.ndarray, values: pa.Array) -> pa.Array:
    """Values, in the order of the rows that own them, as lists of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32()), values)


def _structs(names: tuple[str, ...], columns: list[np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.float64() if x == "bits" else pa.int32()) for x, c in zip(names, columns, strict=True)], names=list(names))


def _joined(parts: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Columns of rows from several chunks, the first of which is the row that owns them, in that order."""
    if not parts:
        return [np.empty(0, dtype=np.int64) for _ in range(width)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        tables, whole, tells_toxic = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            count = batch.num_rows
            own, other, toxic = [], [], np.full(count, np.nan)
            sizes, rest, most, opened, spelled = [], [], [], [], []  # of the last four: the columns, first the place in the batch
            first_half = (batch.column("digest").to_numpy() & 1) == 0
            for at, chunk in _chunks(batch.column("text").to_pylist()):
                sizes += chunk.sizes.tolist()
                # which model each code point meets: that of all trusted text, and that of the half its text isn't in
                half = np.where(first_half[at : at + len(chunk.sizes)], OTHER_HALF, HALF)[chunk.owner]
                for sums, models in ((own, (TRUSTED,)), (other, (HALF, OTHER_HALF))):
                    each = np.zeros(len(chunk.points))
                    for m in models:
                        meets = slice(None) if m == TRUSTED else half == m
                        log2p, seen = _looked_up(m, tables[m], chunk.grams)
                        later = np.zeros(len(seen), dtype=bool) if whole[m] else ~seen
                        each[meets] = np.where(later, 0, log2p)[chunk.which[meets]]
                        if later.any():
                            places = np.flatnonzero(later[chunk.which] & (m == TRUSTED or half == m))
                            pairs, n = np.unique(chunk.owner[places] * len(seen) + chunk.which[places], return_counts=True)
                            rest.append([at + pairs // len(seen), np.full(len(pairs), m), *chunk.grams[:, pairs % len(seen)], n])
                    logs = np.concatenate(([0.0], np.cumsum(each)))
                    sums += (logs[chunk.starts] - logs[chunk.ends]).tolist()
                if not tells_toxic or not len(chunk.points):
                    continue
                # a space stands in place of the boundary, so that a text's first word is judged as any other
                inner = np.where(chunk.grams == 0, 0x20, chunk.grams)
                by_gram, later = _toxic_bits(inner, tables, whole)
                first, owner = _words(chunk.points, chunk.starts)
                sums = np.add.reduceat(by_gram[chunk.which], first)
                is_open = np.logical_or.reduceat(later[chunk.which], first)
                largest, of = _most(sums[~is_open], owner[~is_open])
                toxic[at + owner] = 0
                toxic[at : at + len(chunk.sizes)] += np.bincount(of, weights=largest, minlength=len(chunk.sizes))
                if is_open.any():
                    toxic[at + owner[is_open]] = np.nan
                    most.append([at + of, largest])
                    opened.append([at + owner[is_open], np.flatnonzero(is_open), sums[is_open]])
                    places = np.flatnonzero(later[chunk.which])
                    pairs, n = np.unique((np.searchsorted(first, places, side="right") - 1) * len(later) + chunk.which[places], return_counts=True)
                    word = pairs // len(later)
                    spelled.append([at + owner[word], word, *inner[:, pairs % len(later)], n])
            (of_rest, *rest), (of_most, most), (of_open, *opened), (of_spelled, *spelled) = (_joined(x, n) for x, n in ((rest, 7), (most, 2), (opened, 3), (spelled, 7)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"), batch.column("digest"), pa.array(range(row, row + count), pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(own, pa.float64()), pa.array(other, pa.float64()), pa.array(np.round(toxic, 6), pa.float64(), from_pandas=True),
                    _lists(count, of_rest, _structs(("model", *_GRAM, "n"), rest)), _lists(count, of_most, pa.array(most, pa.float64())),
                    _lists(count, of_open, _structs(("word", "bits"), opened)), _lists(count, of_spelled, _structs(("word", *_GRAM, "n"), spelled)),
                ],
                names=[x.split()[0] for x in _SCORED.split(", ")],
            )
            row += count
            chunk = None
            release_memory()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each gram of each model with the keys that it is looked up by."""
    for batch in batches:
        for model in MODELS:
            some = batch.filter(pa.array(batch.column("model").to_numpy() == model))
            grams = np.stack([some.column(x).to_numpy() for x in _GRAM]).astype(np.int64)
            for role, symbols in _roles(grams):
                names = np.broadcast_to(_keys(model, *symbols), some.num_rows)
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in ("model", *_GRAM)), pa.array([role] * some.num_rows, pa.string()), pa.array(np.ascontiguousarray(names).view(np.int64), pa.int64())], names=["model", *_GRAM, "role", "key"])


def _by_join(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the distinct grams of asked (model, a, b, c, d): log2p by the whole model, and known, whether the model has seen the character."""
    gram = ("model", *_GRAM)
    keys = asked.distinct().mapInArrow(_asked, "model int, a int, b int, c int, d int, role string, key long")
    value = F.when(F.col("role").startswith("p"), F.col("log2p")).otherwise(F.col("backoff"))
    met = keys.join(rows.select("key", "log2p", "backoff"), "key", "left").withColumn("value", value)
    found = met.groupBy(*gram).agg(*[F.max(F.when(F.col("role") == f"{r}{k}", F.col("value"))).alias(f"{r}{k}") for k in range(1, ORDER + 1) for r in "ph"])
    log2p: Column = F.lit(-math.log2(CODE_POINTS))
    for k in range(1, ORDER + 1):
        log2p = F.coalesce(f"p{k}", F.coalesce(f"h{k}", F.lit(0.0)) + log2p)
    return found.select(*gram, log2p.alias("log2p"), F.col("p1").isNotNull().alias("known"))


def _joined_bits(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, more_own, more_other): bits of the grams that were not among the broadcast rows, by joins with the whole models."""
    asked = scored.select("row", F.explode("rest").alias("g")).select("row", "g.*")
    gram = ("model", *_GRAM)
    bits = -F.col("n") * F.col("log2p")
    both = asked.join(_by_join(asked.select(*gram), rows), [*gram]).groupBy("row")
    return both.agg(F.sum(F.when(F.col("model") == TRUSTED, bits)).alias("more_own"), F.sum(F.when(F.col("model") != TRUSTED, bits)).alias("more_other"))


def _joined_words(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, opened): of texts with open words, the bits of each of these, by joins with the two whole models."""
    spelled = scored.select("row", F.explode("spelled").alias("g")).select("row", "g.*")
    asked = spelled.select(*_GRAM).distinct().select(F.explode(F.array(*map(F.lit, WORDWISE))).alias("model"), *_GRAM)
    speaks = F.sum(F.when(F.col("model") == TOXIC, F.col("log2p")).otherwise(-F.col("log2p")))
    grams = _by_join(asked, rows).groupBy(*_GRAM).agg(F.when(F.bool_or("known"), speaks).otherwise(0.0).alias("speaks"))
    later = spelled.join(grams, [*_GRAM]).select("row", "word", (F.col("n") * F.col("speaks")).alias("bits"))
    settled = scored.select("row", F.explode("open").alias("o")).select("row", "o.*")
    words = settled.unionByName(later).groupBy("row", "word").agg(F.sum("bits").alias("bits"))
    return words.groupBy("row").agg(F.collect_list("bits").alias("opened"))  # at most the words of a text


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, digest (of the text) and, of each row of docs: bits, the cross-entropy in bits a character; adjusted_bits, less
    the spread of its length; held_bits, the same under the model of the half of the trusted documents that the text isn't in; and
    toxic_bits, by which the most toxic words speak for the toxic model. Null without text, toxic_bits also without a toxic model. Perplexity is 2**bits."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("digest"), text_or_empty().alias("text"))
    with rows_at_a_time(docs.sparkSession, ROWS):
        scored = materialize(texts.mapInArrow(_scores(model.shared(docs.sparkSession)), _SCORED), "scored")
    own, other, toxic = F.col("own"), F.col("other"), F.col("toxic_bits")
    if model.tells_toxic and not all(model.whole[m] for m in WORDWISE):
        largest = F.slice(F.sort_array(F.concat("most", "opened"), False), 1, TOXIC_WORDS)
        scored = scored.join(_joined_words(scored, model.rows), "row", "left")
        toxic = F.when(F.col("opened").isNull(), toxic).otherwise(F.round(F.aggregate(largest, F.lit(0.0), lambda x, y: x + y), 6))
    if not all(model.whole[m] for m in SCORING):
        scored = scored.join(_joined_bits(scored, model.rows), "row", "left")
        own, other = (c + F.coalesce(m, F.lit(0.0)) for c, m in ((own, "more_own"), (other, "more_other")))
    length = F.nullif("n_chars", F.lit(0))
    bits, spread = lambda total: total / length, SPREAD / F.sqrt(length)
    return scored.select("doc_id", "lang", "digest", F.round(bits(own), 6).alias("bits"), F.round(bits(own) - spread, 6).alias("adjusted_bits"), F.round(bits(other) - spread, 6).alias("held_bits"), toxic.alias("toxic_bits"))


def thresholds(trusted: DataFrame) -> DataFrame:
    """(lang, threshold) from trusted documents' (lang, held_bits): the quantile and what it is unsure by; the row of null lang is for all others."""
    rounded = F.round("held_bits", 3)
    limit = (F.percentile(rounded, QUANTILE) + 1 / F.sqrt(F.nullif(F.count(F.lit(1)), F.lit(0)))).alias("threshold")
    some = trusted.where("held_bits is not null").select("lang", "held_bits")
    return some.where("lang is not null").groupBy("lang").agg(limit).unionByName(some.agg(limit).select(F.lit(None).cast("string").alias("lang"), "threshold"))


def toxic_limit(trusted: DataFrame) -> float | None:
    """From trusted documents' toxic_bits: the quantile plus the margin, over all languages; null without a toxic model."""
    return trusted.agg(F.percentile(F.round("toxic_bits", 3), TOXIC_QUANTILE) + TOXIC_MARGIN).first()[0]


def with_decision(scored: DataFrame, limits: DataFrame, toxic: float | None = None) -> DataFrame:
    """Adds threshold and keep. Text without characters is rejected; without any threshold all other text is kept, and without a limit no text is toxic."""
    of_all = limits.where("lang is null").first()
    joined = scored.join(limits.where("lang is not null").withColumnRenamed("threshold", "own"), "lang", "left")
    within = lambda bits, limit: F.coalesce(F.col(bits) <= limit, F.lit(True))
    rows = joined.withColumn("threshold", F.coalesce("own", F.lit(of_all["threshold"] if of_all else None).cast("double"))).drop("own")
    return rows.withColumn("keep", F.col("bits").isNotNull() & within("adjusted_bits", F.col("threshold")) & within("toxic_bits", F.lit(toxic).cast("double")))


def judge(docs: DataFrame, labels: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, lang, digest, bits, adjusted_bits, toxic_bits, threshold and keep, a row for each of docs.

    docs: doc_id, text and lang; other columns are ignored. labels: doc_id, quality and toxic; documents labelled of
    quality 1 and not toxic are trusted. A document with a null doc_id or no label is scored all the same; a null lang,
    or one without trusted documents, uses the threshold of all. With fewer than LEAST_TOXIC documents labelled toxic,
    none is rejected as toxic. Null or empty text has null bits and is rejected. Repeated rows come out as often as they
    came in; repeated labels count once. Empty tables give no rows. The model's most frequent rows, `frequent` at most,
    are broadcast; the others are joined, which changes no result.
    """
    is_trusted, is_toxic = "quality = 1 and coalesce(toxic, 0) = 0", "coalesce(toxic, 0) = 1"
    trusted_ids = labels.where(is_trusted).select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    kinds = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(F.expr(is_trusted)).alias("trusted"), F.max(F.expr(is_toxic)).alias("toxic"))
    half = F.when(F.xxhash64("text").bitwiseAND(F.lit(1)) == 0, HALF).otherwise(OTHER_HALF)
    classes = F.array_compact(F.array(F.when(F.col("trusted"), half).when(~F.col("toxic"), REST), F.when(F.col("toxic"), TOXIC)))
    labelled = docs.select("doc_id", "text").join(kinds.hint("merge"), F.col("doc_id") == F.col("labelled_id")).select("text", classes.alias("models"))
    scored = materialize(score(docs, train(labelled, frequent)), "bits")
    trusted = scored.join(trusted_ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    return with_decision(scored.drop("held_bits"), materialize(thresholds(trusted), "thresholds"), toxic_limit(trusted))


def classify(docs: DataFrame, labels: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """docs with bits, adjusted_bits, toxic_bits, threshold and keep, as judge() gives them; of these five names, the results take the place.

    Decisions come back to the texts by doc_id, lang and the text's digest, so repeated rows are decided alike. Else the
    cases are judge()'s; other columns may have any names.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*SCORES, "threshold", "keep")]
    rows = docs.select(F.struct(*kept).alias("r"), F.col("doc_id").cast("long").alias("of_id"), F.col("lang").cast("string").alias("of_lang"), F.xxhash64("text").alias("of_text"))
    judged = materialize(judge(docs, labels, frequent).dropDuplicates(["doc_id", "lang", "digest"]), "judged")
    same = F.col("of_id").eqNullSafe(F.col("doc_id")) & F.col("of_lang").eqNullSafe(F.col("lang")) & (F.col("of_text") == F.col("digest"))
    return rows.join(judged, same).select("r.*", *SCORES, "threshold", "keep")
