"""Bracket links of outline files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlinelake.functions import markup
from outlinelake.schema import LINKS

#: Code points of the pieces in which a text is compared with its links.
PIECE = 1024


def parse_links(files: DataFrame) -> DataFrame:
    """All links of files (file, value), as schema.LINKS; position is the 1-based code point of the first bracket."""
    pattern = F.lit(markup.LINK)
    found = F.arrays_zip(
        F.transform(F.split("value", markup.LINK, -1), lambda x: F.char_length(x)).alias("gap"),
        F.regexp_extract_all("value", pattern, F.lit(0)).alias("full_link"),
        F.regexp_extract_all("value", pattern, F.lit(1)).alias("link"),
        F.regexp_extract_all("value", pattern, F.lit(2)).alias("description"),
    )
    rows = files.where(F.col("value").contains("[[")).select("file", F.posexplode(found).alias("at", "m")).where("m.full_link is not null").select("file", "at", "m.*")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("full_link")).over(upto)
    rows = rows.withColumn("position", end - F.char_length("full_link") + 1).withColumn("type", markup.link_type(F.col("link"))).withColumn("description", F.nullif("description", F.lit("")))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINKS])


def with_heading(links: DataFrame, headings: DataFrame) -> DataFrame:
    """links with heading_id, the heading whose section holds each link (null before the first): an as-of join in one window.

    links: file, position and any other columns; of a column heading_id, the result takes the place.
    """
    kept = [F.col(f"`{c}`") for c in links.columns if c != "heading_id"]
    rows = links.select("file", "position", F.struct(*kept).alias("row"))
    both = rows.unionByName(headings.select("file", "position", "heading_id"), allowMissingColumns=True)
    upto = Window.partitionBy("file").orderBy("position", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading_id", F.last("heading_id", ignorenulls=True).over(upto)).where("row is not null").select("row.*", "heading_id")


def standing(links: DataFrame, files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, position, full_link, n, right) of links (file, position, full_link): their number, and whether the text of files
    (file, value) has full_link at position.

    The text is cut once into pieces of as many code points, which a link's parts meet by file and number: work grows with
    the text, and no row holds all of a file with each of its links. Links of any length are compared whole. A link that begins
    before the first code point, goes beyond the end, or has a null in it or no file isn't right; files are unique by name.
    """
    pieces = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("piece", "text"))
    first = F.floor((F.col("position") - 1) / piece).cast("int")
    last = F.floor((F.col("position") - 2 + F.greatest(F.char_length("full_link"), F.lit(1))) / piece).cast("int")
    rows = links.select("file", "position", "full_link", F.explode_outer(F.sequence(first, last)).alias("piece"))
    begin = F.col("position") - F.col("piece") * piece  # of the link, from the piece's first code point, which is 1
    upto = F.least(begin + F.char_length("full_link"), F.lit(piece + 1))
    start = F.greatest(begin, F.lit(1))
    part = F.col("full_link").substr(start - begin + 1, upto - start)
    is_first = F.coalesce(F.col("piece") == first, F.lit(True))
    parts = rows.select("file", "position", "full_link", "piece", start.alias("start"), part.alias("part"), is_first.alias("is_first"))
    met = parts.join(pieces, ["file", "piece"], "left")
    same = F.coalesce(F.col("text").substr(F.col("start"), F.char_length("part")) == F.col("part"), F.lit(False))
    return met.groupBy("file", "position", "full_link").agg(F.count_if("is_first").alias("n"), F.bool_and(same).alias("right"))
