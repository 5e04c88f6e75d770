"""Files to lines, and searches over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_lines(files: DataFrame) -> DataFrame:
    """(file, line_number, line), 1-based; a final newline starts no line."""
    body = F.regexp_replace("value", r"\r?\n$", "")
    return files.select("file", F.posexplode(F.split(body, r"\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_number"), "line")


def search(files: DataFrame, pattern: str) -> DataFrame:
    """Lines that match a regular expression; files without a match are dropped before they are cut into lines."""
    return to_lines(files.where(F.col("value").rlike(f"(?m){pattern}"))).where(F.col("line").rlike(pattern))
