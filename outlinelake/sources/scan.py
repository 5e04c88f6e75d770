"""Scan directories of outline files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The name that a file has in its file system; Spark's metadata has it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def as_path(name: str) -> str:
    """A file's name as a path for the reader, which takes paths as globs."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", name)


def scan(spark: SparkSession, dirs: list[str], pattern: str = "*.org") -> DataFrame:
    """(file, value, mtime, size), a row for each file below the directories; value is the whole text.

    dirs are paths, in which * and the like stand for any name. Files whose names begin with a dot or _ are hidden from Spark.
    """
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.load(dirs).select(file_name(F.col("_metadata.file_path")).alias("file"), "value", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))


def scan_metadata(spark: SparkSession, dirs: list[str], pattern: str = "*.org", digest: bool = False) -> DataFrame:
    """(file, mtime, size, sha256) of each file; the text is read only for the digest, which is null without."""
    sha = F.sha2("value", 256) if digest else F.lit(None).cast("string")
    return scan(spark, dirs, pattern).select("file", "mtime", "size", sha.alias("sha256"))
