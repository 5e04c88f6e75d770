"""Parquet tables of an outline database, and their refresh.

Rows are kept in buckets by a hash of their file's name. A refresh compares names, times and sizes (or digests) with the
manifest, reads only files that changed, and rewrites only the buckets that hold changed or deleted files.

The manifest is the last table to be written, and before the first one the names of the files that change are noted
beside the tables. A refresh that breaks off anywhere is thus repeated by the next one, whatever happened to the files since.
"""

from __future__ import annotations

import contextlib
import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from outlinelake.functions.markup import TODO_KEYWORDS
from outlinelake.operators.headings import parse_headings
from outlinelake.operators.links import parse_links
from outlinelake.schema import FILES, HEADINGS, LINKS
from outlinelake.sources.scan import as_path, scan, scan_metadata

#: In the order in which they are written: the manifest last.
TABLES = {"headings": HEADINGS, "links": LINKS, "files": FILES}
BUCKETS = 256
#: Changed files named to the reader one by one; beyond, all files are read and filtered by a join, with the same result.
NAMED_FILES = 20_000
#: Where a refresh notes the files that it is about to change.
PENDING = "_pending"


def bucket(file: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(n)).cast("int")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write (all of) headings, links and files as the database at path; it exists once files, the last, is written."""
    for name in TABLES:
        tables[name].withColumn("bucket", bucket(F.col("file"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the database; empty ones where it doesn't exist. The bucket column stays, for partition pruning."""
    out = {}
    for name, schema in TABLES.items():
        kept = StructType([*schema.fields, StructField("bucket", IntegerType())])
        out[name] = spark.read.schema(kept).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], kept)
    return out


def export_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables into a SQLite file on the driver's machine, a row at a time; arrays become JSON text."""
    with contextlib.closing(sqlite3.connect(path)) as db:
        for name, schema in TABLES.items():
            nested = {f.name for f in schema if isinstance(f.dataType, ArrayType)}
            rows = tables[name].select(*[F.to_json(f.name).alias(f.name) if f.name in nested else F.col(f.name).cast("string" if "Timestamp" in str(f.dataType) else f.dataType) for f in schema])
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({', '.join(schema.names)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(schema))})", map(tuple, rows.toLocalIterator()))
        db.commit()


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views files, headings and links for spark.sql()."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def parse(files: DataFrame, todo_keywords: tuple[str, ...] = TODO_KEYWORDS) -> dict[str, DataFrame]:
    return {"headings": parse_headings(files, todo_keywords), "links": parse_links(files)}


def diff(now: DataFrame, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(file, change) with change new, modified or deleted; unchanged files have no row."""
    same = (F.col("o.sha256") == F.col("n.sha256")) if digest else ((F.col("o.mtime") == F.col("n.mtime")) & (F.col("o.size") == F.col("n.size")))
    both = now.alias("n").join(manifest.alias("o"), "file", "full_outer")
    change = F.when(F.col("o.size").isNull(), "new").when(F.col("n.size").isNull(), "deleted").when(~F.coalesce(same, F.lit(False)), "modified")
    return both.select("file", change.alias("change")).where("change is not null")


def _changes(spark: SparkSession, now: DataFrame, path: str, digest: bool) -> DataFrame:
    """(file, change): what diff() says, and the files of a refresh that broke off, as modified or deleted."""
    changes = diff(now, load(spark, path)["files"], digest)
    if not exists(spark, f"{path}/{PENDING}/_SUCCESS"):
        return changes
    noted = spark.read.schema("file string").parquet(f"{path}/{PENDING}").distinct().join(changes, "file", "left_anti")
    here = noted.join(now.select("file", F.lit(True).alias("here")), "file", "left")
    return changes.unionByName(here.select("file", F.when(F.col("here"), "modified").otherwise("deleted").alias("change")))


def refresh(spark: SparkSession, dirs: list[str], path: str, pattern: str = "*.org", todo_keywords: tuple[str, ...] = TODO_KEYWORDS, digest: bool = False) -> dict[str, DataFrame]:
    """Bring the database at path up to date with the directories, and return its tables."""
    now = scan_metadata(spark, dirs, pattern, digest)
    if not exists(spark, f"{path}/files/_SUCCESS"):
        files = scan(spark, dirs, pattern)
        save({"files": now, **parse(files, todo_keywords)}, path)
        return load(spark, path)
    stage = f"{path}/_stage-{uuid.uuid4().hex}"
    _changes(spark, now, path, digest).withColumn("bucket", bucket(F.col("file"))).write.parquet(f"{stage}/changes")
    changes = spark.read.parquet(f"{stage}/changes")
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # at most BUCKETS
    if touched:
        read = changes.where("change <> 'deleted'").select("file")
        names = [r["file"] for r in read.limit(NAMED_FILES + 1).collect()]
        if not names:
            files = spark.createDataFrame([], "file string, value string, mtime timestamp, size long")
        elif len(names) <= NAMED_FILES:
            files = scan(spark, [as_path(n) for n in names], pattern)
        else:
            files = scan(spark, dirs, pattern).join(read, "file", "left_semi")
        fresh = {"files": now.join(read, "file", "left_semi"), **parse(files, todo_keywords)}
        old = load(spark, path)
        for name in TABLES:
            held = old[name].where(F.col("bucket").isin(touched)).join(changes.select("file"), "file", "left_anti")
            held.unionByName(fresh[name].withColumn("bucket", bucket(F.col("file")))).write.parquet(f"{stage}/{name}")
        changes.select("file").write.mode("append").parquet(f"{path}/{PENDING}")
        for name in TABLES:
            _replace_buckets(spark, f"{stage}/{name}", f"{path}/{name}", touched)
        delete(spark, f"{path}/{PENDING}")
    delete(spark, stage)
    return load(spark, path)


def _replace_buckets(spark: SparkSession, staged: str, table: str, touched: list[int]) -> None:
    rows = spark.read.parquet(staged)
    filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    for b in set(touched) - filled:  # an overwrite leaves a bucket without new rows as it was
        delete(spark, f"{table}/bucket={b}")
