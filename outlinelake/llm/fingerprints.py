"""Document fingerprints by winnowing, in DataFrame functions only.

A document's words are hashed, then every k-gram of words; of each window of w neighbouring k-grams the least hash is
kept, the rightmost of equal ones, with its position. Texts that share k + w - 1 words in a row share a fingerprint
entry, and entries carry positions, so the match can be found again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.llm.common import SPACES, materialize, text_or_empty

K = 5
W = 16
#: Low bits of an entry that hold the position, in words; the others are the k-gram's hash.
PLACE_BITS = 28
#: Rows to a range of neighbouring documents, about. Ranges are parts of sections, which splitters part; a section has as
#: many ranges as its rows need, so only the number of sections is bounded.
BUCKET_ROWS = 1000
SECTIONS = 256

_LOW = (1 << 32) - 1
_PLACES = (1 << PLACE_BITS) - 1


def with_entries(df: DataFrame, text: str, entries: str) -> DataFrame:
    """Adds the fingerprint of a text column as an array of longs: hash in the high bits, position in the low ones."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    words = F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r")), f"[{SPACES}]+")
    df = df.select(*keep, F.transform(words, lambda x: F.xxhash64(x)).alias("_words"), F.expr(f"length(btrim(`{text}`, ' \\t\\n\\u000b\\f\\r')) > 0").alias("_any"))
    n = F.size("_words")
    gram = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(K)])
    grams = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), gram)).otherwise(F.array(F.xxhash64(F.col("_words"))))
    df = df.select(*keep, F.when(F.col("_any"), grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"))
    # the least of these is the least hash, and of equal hashes the rightmost
    order = F.transform("_grams", lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32).bitwiseOR(F.lit(_LOW) - i))
    df = df.select(*keep, "_grams", order.alias("_order"))
    n = F.size("_order")
    least = F.when(n > W, F.transform(F.sequence(F.lit(1), n - W + 1), lambda i: F.array_min(F.slice("_order", i, F.lit(W))))).when(n > 0, F.array(F.array_min("_order"))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, "_grams", F.array_distinct(least).alias("_least"))
    place = lambda x: F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))
    entry = lambda x: F.shiftleft(F.shiftrightunsigned(F.get(F.col("_grams"), place(x).cast("int")), PLACE_BITS), PLACE_BITS).bitwiseOR(place(x).bitwiseAND(F.lit(_PLACES)))
    return df.select(*keep, F.transform("_least", entry).alias(entries))


def hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))


def as_text(entries: Column) -> Column:
    """Entries as hash:position, the hash in hex, comma-joined."""
    return F.array_join(F.transform(entries, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))), F.lit(":"), x.bitwiseAND(F.lit(_PLACES)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _splitters(docs: DataFrame) -> list[int]:
    """Sampled splitters of doc_id; an id with many rows is a section of its own."""
    sections = max(1, min(SECTIONS, docs.count() // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / sections for k in range(1, sections)] or [0.5], 100 * sections)).first()[0] or []
    top = (1 << 63) - 1
    often = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < top}
    return sorted({*cuts, *(c + 1 for c in often)})


def _section(cuts: list[int]) -> Column:
    """Number of the section of a doc_id, by binary search; null is -1."""
    steps = max(1, len(cuts).bit_length())
    top = (1 << 63) - 1
    edges = F.array(*[F.lit(c).cast("long") for c in cuts], *[F.lit(top).cast("long")] * ((1 << steps) - len(cuts)))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(edges, at + half - 1) <= F.col("doc_id"), at + half).otherwise(at))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(F.least(found, F.lit(len(cuts))))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], extra: list[str]) -> DataFrame:
    """docs (doc_id, text) with what prepare adds, and next_text and next_<extra>: those of the next row in descending doc_id.

    After the last row comes the first. Rows of one doc_id follow in the order of a hash of their text; null ids come
    last. Documents are dealt by ranges of that order: sections between sampled splitters, cut into parts by interpolation
    over their ids, or over the hash where a section has one id or none. Each range also gets the first row of the range
    that follows, found before prepare runs, so that prepare sees each document once, and each range's first row twice.
    """
    spark = docs.sparkSession
    cuts = _splitters(docs)
    keys = docs.select("doc_id", F.xxhash64("text").alias("tie")).withColumn("section", _section(cuts))
    stats = keys.groupBy("section").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # a row for each section
    if not stats:
        return prepare(docs).select("*", F.lit(None).cast("string").alias("next_text"), *[F.col(c).alias(f"next_{c}") for c in extra])
    sections = F.create_map(*[x for r in stats for x in (F.lit(r["section"]), F.struct(F.lit(float(r["lo"] or 0)).alias("lo"), F.lit(float((r["hi"] or 0) - (r["lo"] or 0))).alias("width"), F.lit(max(1, r["n"] // BUCKET_ROWS)).cast("double").alias("parts")))])

    def ranged(df: DataFrame) -> DataFrame:
        """df (doc_id, tie and more) with section and part, which ascend with (doc_id, tie)."""
        df = df.withColumn("section", _section(cuts)).withColumn("s", sections[F.col("section")])
        share = F.when(F.col("s.width") > 0, (F.col("doc_id") - F.col("s.lo")) / F.col("s.width")).otherwise(F.col("tie") / F.lit(2.0**64) + 0.5)
        part = F.least(F.floor(share * F.col("s.parts")), F.col("s.parts") - 1)
        return df.withColumn("part", F.greatest(part, F.lit(0)).cast("long")).drop("s")

    rank = F.struct("doc_id", "tie")
    heads = ranged(keys.drop("section")).groupBy("section", "part").agg(F.max(rank).alias("head"))
    heads = materialize(heads.withColumn("follower", F.lag(F.struct("section", "part")).over(Window.partitionBy("section").orderBy(F.desc("part")))), "heads")
    ends = heads.groupBy("section").agg(F.max_by("head", "part").alias("head"), F.min("part").alias("last")).orderBy(F.desc("section")).collect()  # a row for each section
    turns = [(ends[i - 1]["section"], ends[i - 1]["last"], *h["head"]) for i, h in enumerate(ends)]  # the first row of a section follows the last range of the one before
    within = heads.where("follower is not null").select("follower.section", "follower.part", F.col("head.doc_id").alias("id"), F.col("head.tie").alias("of"))
    wanted = materialize(within.unionByName(spark.createDataFrame(turns, within.schema)), "ghosts")
    rows = docs.withColumn("tie", F.xxhash64("text"))
    met = rows.alias("r").join(wanted.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.id")) & (F.col("r.tie") == F.col("w.of")))
    ghosts = met.select("r.*", "w.section", "w.part", F.lit(1).alias("ghost")).dropDuplicates(["section", "part"])
    both = prepare(ranged(rows).withColumn("ghost", F.lit(0)).unionByName(ghosts))
    order = Window.partitionBy("section", "part").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))
    for c in ("text", *extra):
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where("ghost = 0").drop("tie", "section", "part", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they are.

    docs: doc_id and text; other columns are ignored. Edited: the last third (rounded down) of the code points gives
    way to the first as many of the next document in descending doc_id. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as empty, and has an empty fingerprint;
    fewer than five words are one k-gram. Repeated rows come out as often as they came in; of a table of one row the
    next document is that row. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    near = with_next(texts, lambda df: with_entries(df, "text", "entries"), ["entries"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    both = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "entries", "next_entries")
    both = with_entries(both, "edited", "edited_entries")
    own, new, other = "own", "new", "other"
    sets = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("entries")).alias("fingerprint"), as_text(F.col("edited_entries")).alias("edited_fingerprint"), hashes(F.col("entries")).alias(own), hashes(F.col("edited_entries")).alias(new), hashes(F.col("next_entries")).alias(other))
    return sets.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col(own), F.col(new)).alias("near_edited"), likeness(F.col(own), F.col(other)).alias("near_next"))
