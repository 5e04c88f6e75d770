"""Headings of outline files.

A file is cut before its heading lines, and everything that a heading needs is read from its own section before
anything is shuffled. One window over a file's sections then gives line numbers, positions and the tree: a running last
line for every level, of which those that no shallower heading follows are the ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.functions import markup
from outlinelake.schema import HEADINGS

#: Levels that have a running last line of their own; deeper headings are looked at together, below the last shallow one.
SHALLOW = 12


def heading_id(file: Column, line_number: Column) -> Column:
    return F.xxhash64(file, line_number)


def parse_headings(files: DataFrame, todo_keywords: tuple[str, ...] = markup.TODO_KEYWORDS, shallow: int = SHALLOW) -> DataFrame:
    """All headings of files (file, value), as schema.HEADINGS. Files without headings, and null or empty ones, give none."""
    sections = files.select("file", F.posexplode(F.split("value", markup.SECTION_CUT, -1)).alias("at", "section"))
    head, planning = markup.first_line(F.col("section")), markup.planning_line(F.col("section"))
    cut = sections.select("file", "at", "section", head.alias("head"), planning.alias("planning"))
    parts = markup.heading_parts(F.col("head"), todo_keywords)
    read = cut.select(
        "file",
        "at",
        markup.level(F.col("head")).alias("level"),
        *[c.alias(n) for n, c in parts.items()],
        *[markup.planned(F.col("planning"), k.upper()).alias(k) for k in ("scheduled", "deadline", "closed")],
        markup.properties(F.col("section")).alias("properties"),
        F.regexp_count("section", F.lit("\n")).alias("n_lines"),
        F.char_length("section").alias("n_chars"),
    )
    return with_parent(_numbered(read), shallow).select(*_columns())


def _numbered(sections: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda c: (F.coalesce(F.sum(c).over(before), F.lit(0)) + 1).cast("int")
    return sections.withColumn("line_number", place("n_lines")).withColumn("position", place("n_chars")).where("level > 0")


def with_parent(headings: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """Adds heading_id, parent_id and ancestor_ids (root first) to (file, line_number, level): the parent is the nearest heading before of a lower level.

    Any level is allowed. Headings deeper than `shallow` levels have ancestors among the deep ones since the last shallow
    heading: going back from the heading, those of a lower level than all that follow.
    """
    before = Window.partitionBy("file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("line_number")), ignorenulls=True).over(before) for k in range(1, shallow + 1)}
    rows = headings.withColumns({f"_l{k}": c for k, c in last.items()})
    above: list[Column] = []
    for k in last:
        shallower = [F.coalesce(F.col(f"_l{j}"), F.lit(0)) for j in range(1, k)]
        open_ = F.lit(True) if not shallower else F.col(f"_l{k}") > reduce(F.greatest, shallower)
        above.append(F.when((F.col("level") > k) & open_, F.col(f"_l{k}")))
    since = Window.partitionBy("file", "_block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    block = reduce(F.greatest, [F.coalesce(F.col(f"_l{k}"), F.lit(0)) for k in last])
    deep = F.when(F.col("level") > shallow, F.struct("level", "line_number"))
    rows = rows.withColumn("_block", F.when(F.col("level") > shallow, block).otherwise(F.col("line_number")))
    rows = rows.withColumn("_deep", F.collect_list(deep).over(since))
    none = F.struct(F.col("level").alias("level"), F.array().cast("array<int>").alias("lines"))
    add = lambda acc, x: F.when(x["level"] < acc["level"], F.struct(x["level"].alias("level"), F.concat(F.array(x["line_number"]), acc["lines"]).alias("lines"))).otherwise(acc)
    of_deep = F.when(F.col("level") > shallow + 1, F.aggregate(F.reverse("_deep"), none, add, lambda acc: acc["lines"])).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_lines", F.concat(F.array_compact(F.array(*above)), of_deep))
    rows = rows.withColumn("ancestor_ids", F.transform("_lines", lambda x: heading_id(F.col("file"), x)))
    return rows.withColumn("parent_id", F.try_element_at("ancestor_ids", F.lit(-1))).withColumn("heading_id", heading_id(F.col("file"), F.col("line_number"))).drop("_lines", "_deep", "_block", *[f"_l{k}" for k in last])


def _columns() -> list[Column]:
    made = markup.cookies(F.col("title"))
    return [made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in HEADINGS]
