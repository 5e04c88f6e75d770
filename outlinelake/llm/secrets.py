"""Secret scans with multipart linking, in DataFrame functions only.

Assignments, access identifiers and long hex strings are reported wherever they stand. Bare 40-character tokens and
endpoints are weak candidates: an interval join within a scope around each of them reports a bare token only near an
access identifier, and an endpoint only near both an access identifier and a secret. The join meets candidates with
the least and greatest place of each part in bins as wide as the scope, so no pair of parts is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.llm.common import materialize, text_or_empty

#: Code points between the starts of two parts of one credential, at most.
SCOPE = 512

# Kind, pattern, the group whose length counts, the least length.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("secret", r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 9),
]
# What a text must hold to have a span of any kind.
ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9/+]{40}"
#: Long runs only: dropping shorter ones can't change where a later match begins.
SCANNED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
BASE = ("assign", "access", "hex")


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int) -> Column:
    """Of each match: its kind's rank, its number, code points since the last one, its length, and its counted group's; an odd last entry has no match."""
    scan = F.lit(SCANNED.get(kind, pattern))
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
    found = [lengths(F.split(text, SCANNED.get(kind, pattern), -1)).alias("gap"), lengths(F.regexp_extract_all(text, scan, F.lit(0))).alias("size")]
    if group:  # else the counted part is the match
        found.append(lengths(F.regexp_extract_all(text, scan, F.lit(group))).alias("counted"))
    counted = lambda m: m["counted"] if group else m["size"]
    entry = lambda m, at: F.struct(F.lit(rank).alias("rank"), at.alias("at"), m["gap"].alias("gap"), m["size"].alias("size"), counted(m).alias("counted"))
    none = F.array().cast("array<struct<rank:int,at:int,gap:int,size:int,counted:int>>")
    return F.when(text.rlike(SCANNED.get(kind, pattern)), F.transform(F.arrays_zip(*found), entry)).otherwise(none)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text's digest) and found (all kinds' matches) of each row of docs; the last two are null where a text has none.

    The one pass over the texts, written to the shared folder: all that follows reads this small table.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("any", F.col("text").rlike(ANY))
    found = F.concat(*[_matches(F.col("text"), rank, kind, pattern, group) for rank, (kind, pattern, group, _) in enumerate(KINDS)])
    return materialize(texts.select("doc_id", F.when(F.col("any"), F.md5("text")).alias("mark"), F.when(F.col("any"), found).alias("found")), "secrets")


def find_parts(rows: DataFrame) -> DataFrame:
    """Every candidate: doc_id, mark, kind, rank, start, end in code points. rows: as from scanned()."""
    each = rows.where("found is not null").select("doc_id", "mark", F.explode("found").alias("m")).select("doc_id", "mark", "m.*")
    parts = each.repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "rank", "at"])
    before = Window.partitionBy("doc_id", "mark", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(before))
    least, kinds = (F.array(*[F.lit(k[i]) for k in KINDS]) for i in (3, 0))
    return ends.where(F.col("counted") >= least[F.col("rank")]).select("doc_id", "mark", kinds[F.col("rank")].alias("kind"), "rank", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(parts: DataFrame) -> DataFrame:
    """Weak candidates whose complementary parts start within the scope."""
    is_access, is_secret = F.col("kind") == "access", F.col("kind").isin("assign", "hex", "secret")
    bins = parts.where(is_access | is_secret).groupBy("doc_id", "mark", F.floor(F.col("start") / SCOPE).alias("bin")).agg(*[f(F.when(c, F.col("start"))).alias(n) for c, k in ((is_access, "access"), (is_secret, "secret")) for f, n in ((F.min, f"{k}_lo"), (F.max, f"{k}_hi"))])
    weak = parts.where(F.col("kind").isin("secret", "endpoint")).withColumn("own", F.floor(F.col("start") / SCOPE))
    reach = weak.withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = lambda k: F.coalesce((F.col(f"{k}_hi") >= F.col("start") - SCOPE) & (F.col(f"{k}_lo") <= F.col("start") + SCOPE), F.lit(False))
    same = F.col("w.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("w.mark") == F.col("b.mark")) & (F.col("w.bin") == F.col("b.bin"))
    met = reach.alias("w").join(bins.alias("b"), same).select("w.*", near("access").alias("access"), near("secret").alias("secret"))
    judged = met.groupBy("doc_id", "mark", "kind", "rank", "start", "end").agg(F.max("access").alias("access"), F.max("secret").alias("secret"))
    return judged.where("access and (kind = 'secret' or secret)").select("doc_id", "mark", "kind", "rank", "start", "end")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    docs: doc_id and text; other columns are ignored. spans lists kind:start:end by start, then kind, in code points,
    end exclusive; base_sha256 is of the list without linked weak candidates. Null or empty text has no spans, and an
    empty list. Rows of one doc_id with different texts are scanned apart; repeated rows come out as often as they came
    in. An empty table gives no rows.
    """
    marked = scanned(docs)
    parts = materialize(find_parts(marked), "secret-parts")
    spans = parts.where(F.col("kind").isin(*BASE)).unionByName(_linked(parts))
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("span"))))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    by_doc = spans.groupBy("doc_id", "mark").agg(*[count(k) for k in BASE], listed.alias("listed"))
    by_doc = by_doc.select("doc_id", "mark", *[f"n_{k}" for k in BASE], joined(F.filter("listed", lambda x: x["rank"] < len(BASE))).alias("base"), joined(F.col("listed")).alias("spans"), F.size("listed").cast("long").alias("n"))
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.mark").eqNullSafe(F.col("s.mark"))
    out = marked.select("doc_id", "mark").alias("d").join(by_doc.alias("s"), same, "left")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE]
    linked = F.coalesce(F.col("n") - F.col("n_assign") - F.col("n_access") - F.col("n_hex"), zero).alias("n_linked")
    return out.select("d.doc_id", *numbers, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), linked)
