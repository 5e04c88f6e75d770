"""Mixing overlapping sources to target weights as a min-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern. A pattern offers its words once at no cost and each
further time at a cost that rises with the repeat, so the flow repeats only where a quota can't be met otherwise, and
spreads what it must repeat. The flow says how many words each pattern gives; a seeded hash then orders the pattern's
documents, and a two-level sum over ranges of the hash finds the hash up to which one more copy is taken.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.llm.common import SPACES, materialize

#: Patterns that the flow may have; with more of them, sources should be grouped first.
MOST_PATTERNS = 100_000
#: Tables of a row for each pattern or source are broadcast up to this many rows; beyond, Catalyst joins them as it likes.
SMALL = 10_000
#: Rows of one pattern to a hash range, about.
RANGE_ROWS = 10_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Targets that share `share` of all sizes by weight; what goes beyond `most` times a size is reshared by weight."""
    target = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), {i for i in range(len(sizes)) if sizes[i]}
    while open_ and left:
        unit = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not above:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in above:
            target[i] = Fraction(most * sizes[i])
            left -= target[i]
        open_ -= above
    return target


def min_cost_flow(supplies: list[int], members: list[list[int]], quotas: list[int], most: int = 2) -> list[list[int]]:
    """Words that each pattern sends to each of its members (in their order): as much as the quotas take, at least cost.

    Successive shortest paths with potentials; the k-th copy of a pattern costs k, each arc as wide as the pattern.
    """
    n, m = len(supplies), len(quotas)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    for p, size in enumerate(supplies):
        for copy in range(most):
            arc(source, p, size, copy)
    sent = [[arc(p, n + s, most * supplies[p], 0) for s in members[p]] for p in range(n)]
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota, 0)
    potential = [0] * len(out)
    while True:
        dist = [math.inf] * len(out)
        via = [-1] * len(out)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if room[e] > 0 and (step := d + cost[e] + potential[x] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = step, e
                    heapq.heappush(heap, (step, to[e]))
        if dist[sink] == math.inf:
            return [[room[e ^ 1] for e in arcs] for arcs in sent]
        potential = [p + (d if d < math.inf else dist[sink]) for p, d in zip(potential, dist, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        width = min(room[e] for e in path)
        for e in path:
            room[e] -= width
            room[e ^ 1] += width


def _side(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SMALL else rows


def _row_hash(seed: int) -> Column:
    """Seeded place of a row among its pattern's; equal rows share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))


def mixing_plan(docs: DataFrame, sources: Column, quotas: dict, most: int = 2, seed: int = SEED) -> DataFrame:
    """How much of each pattern to take: pattern, copies (whole), cut (hash below which one more is taken), part and of.

    docs: doc_id and text. sources: an array column, the sources of a document, nulls allowed. quotas: words for each
    source. Documents whose hash equals the cut share `part` words of their `of`. One row for each pattern.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(sources))
    thin = materialize(docs.select(pattern.alias("pattern"), _row_hash(seed).alias("h"), word_count(F.col("text")).alias("size")), "sizes")
    sums = thin.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = sums.orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    flows = min_cost_flow([r["size"] for r in found], [[place[s] for s in r["pattern"] if s in place] for r in found], [int(quotas[s]) for s in names], most)
    plan = []
    for r, flow in zip(found, flows, strict=True):
        copies, rest = divmod(sum(flow), r["size"]) if r["size"] else (0, 0)
        plan.append((r["pattern"], int(copies), int(rest)))
    ranges = max(16, max((r["n"] for r in found), default=0) // RANGE_ROWS)
    schema = thin.select("pattern", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("rest")).schema
    wanted = spark.createDataFrame(plan, schema)
    same = lambda a, b: F.col(f"{a}.pattern").eqNullSafe(F.col(f"{b}.pattern"))
    binned = thin.withColumn("range", F.pmod(F.shiftrightunsigned("h", 1), F.lit(ranges)).cast("int"))
    in_order = Window.partitionBy("pattern").orderBy("range")
    totals = binned.groupBy("pattern", "range").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(in_order))
    cut_range = totals.alias("t").join(_side(wanted, len(plan)).alias("w"), same("t", "w")).where("rest > 0 and upto > rest and upto - size <= rest").select("t.pattern", "range", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))
    cut_range = spark.createDataFrame(cut_range.collect(), cut_range.schema)  # a row for each pattern
    inside = binned.alias("b").join(_side(cut_range, len(plan)).alias("c"), same("b", "c") & (F.col("b.range") == F.col("c.range"))).groupBy("b.pattern", "b.range", "c.rest", "h").agg(F.sum("size").alias("of"))
    by_hash = Window.partitionBy("pattern").orderBy("h")
    cut = inside.withColumn("upto", F.sum("of").over(by_hash)).where("upto > rest and upto - of <= rest").select("pattern", "range", "h", "of", (F.col("rest") - (F.col("upto") - F.col("of"))).alias("part"))
    rows = wanted.alias("w").join(cut.alias("c"), same("w", "c"), "left").select("w.pattern", "copies", F.col("range").alias("cut_range"), F.col("h").alias("cut"), "part", "of", F.lit(ranges).alias("ranges"))
    return spark.createDataFrame(rows.collect(), rows.schema)  # a row for each pattern


def mixed(docs: DataFrame, sources: Column, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size and taken, the words that the plan takes of each row, repeats counted. docs may have columns of any names but these two."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.array_sort(F.array_distinct(sources)).alias("pattern"), word_count(F.col("text")).alias("size"), _row_hash(seed).alias("h")).alias("r")
    p, h = _side(plan, plan.count()).alias("p"), F.col("r.h")
    place = F.pmod(F.shiftrightunsigned(h, 1), F.col("p.ranges")).cast("int")
    before = (place < F.col("p.cut_range")) | ((place == F.col("p.cut_range")) & (h < F.col("p.cut")))
    more = F.when(F.col("p.cut").isNull(), F.lit(0)).when(before, F.col("r.size")).when(h == F.col("p.cut"), F.floor(F.col("r.size") * F.col("p.part") / F.col("p.of"))).otherwise(F.lit(0))
    joined = rows.join(p, F.col("r.pattern").eqNullSafe(F.col("p.pattern")), "left")
    return joined.select("r.d.*", "r.size", F.coalesce((F.col("p.copies") * F.col("r.size") + more).cast("long"), F.lit(0).cast("long")).alias("taken"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2)) -> list[tuple[str | None, int, Fraction]]:
    """(source, size in words, target) of each source in code point order, null last; weights repeat in that order."""
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("size")).orderBy(F.asc_nulls_last("source")).limit(MOST_PATTERNS + 1).collect()
    if len(sizes) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    found = [r["size"] or 0 for r in sizes]
    targets = capped_targets(found, [weights[i % len(weights)] for i in range(len(found))], share)
    return [(r["source"], n, t) for r, n, t in zip(sizes, found, targets, strict=True)]


def mix_by_source(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and taken, each source as a pattern of its own.

    docs: doc_id, text, source and any other columns; of those four names, the results take the place. Null text has no words; a null source is a source.
    Repeated rows share one place in the order and are taken alike. An empty table gives no rows. Reruns agree.
    """
    spark, docs = docs.sparkSession, docs.drop("size", "source_size", "target", "taken")
    targets = source_targets(docs)
    plan = mixing_plan(docs, F.array("source"), {s: round(t) for s, _, t in targets})
    by_source = spark.createDataFrame([(s, n, float(t)) for s, n, t in targets], "source string, source_size long, target double")
    out = mixed(docs, F.array("source"), plan)
    joined = out.alias("o").join(_side(by_source, len(targets)).alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")), "left")
    return joined.select("o.*", "source_size", "target")
