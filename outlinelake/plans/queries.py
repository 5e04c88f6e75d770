"""Ready-made queries over headings and links; every one is a plan that Catalyst sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("DONE",)


def by_level(headings: DataFrame) -> DataFrame:
    return headings.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def with_parent_title(headings: DataFrame) -> DataFrame:
    parents = headings.select(F.col("heading_id").alias("parent_id"), F.col("title").alias("parent_title"))
    return headings.join(parents, "parent_id", "left")


def tag_counts(headings: DataFrame) -> DataFrame:
    return headings.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def agenda(headings: DataFrame, first: str, last: str) -> DataFrame:
    """Headings scheduled from first to last, both included."""
    day = F.col("scheduled").cast("date")
    return headings.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("day", day)


def overdue(headings: DataFrame, today: str, done: tuple[str, ...] = DONE) -> DataFrame:
    """Open headings whose deadline is before a given day, with days_late."""
    late = F.datediff(F.lit(today).cast("date"), F.col("deadline").cast("date"))
    return headings.where(F.col("todo").isNotNull() & ~F.col("todo").isin(*done)).withColumn("days_late", late).where("days_late > 0")


def done_ratio_by_parent(headings: DataFrame, done: tuple[str, ...] = DONE) -> DataFrame:
    """For each heading with todo children: parent_id, n_done, n_todo and ratio of done ones."""
    n_done = F.sum(F.when(F.col("todo").isin(*done), 1).otherwise(0))
    return headings.where("todo is not null and parent_id is not null").groupBy("parent_id").agg(n_done.alias("n_done"), F.count(F.lit(1)).alias("n_todo")).withColumn("ratio", F.col("n_done") / F.col("n_todo"))


def top_by_priority(headings: DataFrame, by: Column, k: int) -> DataFrame:
    """The first k headings of each group by priority, then title; headings without a priority are left out."""
    order = Window.partitionBy("group").orderBy("priority", "title", "heading_id")
    return headings.where("priority is not null").withColumn("group", by).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def subtree_rollup(headings: DataFrame) -> DataFrame:
    """Descendants of every heading: heading_id, n_below, n_open. The tree is in ancestor_ids, so one aggregation does."""
    below = headings.select(F.explode("ancestor_ids").alias("heading_id"), F.col("todo")).groupBy("heading_id").agg(F.count(F.lit(1)).alias("n_below"), F.count(F.when(~F.col("todo").isin(*DONE), 1)).alias("n_open"))
    zero = F.lit(0).cast("long")
    return headings.select("heading_id", "title", "level").join(below, "heading_id", "left").select("heading_id", "title", "level", F.coalesce("n_below", zero).alias("n_below"), F.coalesce("n_open", zero).alias("n_open"))


def inherited_tags(headings: DataFrame) -> DataFrame:
    """(heading_id, tag) of a heading's own tags and all its ancestors'."""
    up = headings.select("heading_id", F.explode(F.array_append("ancestor_ids", F.col("heading_id"))).alias("at"))
    tags = headings.where(F.size("tags") > 0).select(F.col("heading_id").alias("at"), F.explode("tags").alias("tag"))
    return up.join(tags, "at").select("heading_id", "tag").distinct()


def property_rows(headings: DataFrame) -> DataFrame:
    return headings.select("heading_id", "file", "title", F.explode("properties").alias("p")).select("heading_id", "file", "title", F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def links_by_type(links: DataFrame) -> DataFrame:
    return links.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _targets(headings: DataFrame) -> DataFrame:
    return property_rows(headings).where("upper(key) = 'CUSTOM_ID'").select("file", "heading_id", "title", F.concat(F.lit("#"), "value").alias("link"))


def backlinks(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Links to custom ids with the heading that they reach in their own file."""
    return links.where("type = 'custom-id'").join(_targets(headings), ["file", "link"])


def broken_links(links: DataFrame, headings: DataFrame) -> DataFrame:
    return links.where("type = 'custom-id'").join(_targets(headings).select("file", "link"), ["file", "link"], "left_anti")
