"""The engine's queries over outlines rendered from the star schema, each with SQL over the source tables.

The SQL never sees the parser: it says what the rendered outline must mean. Outlines are rendered and parsed once into
saved tables, which all queries read, as a user's queries read the tables of catalog.refresh().
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlinelake.functions.lines import search, to_lines
from outlinelake.operators.headings import parse_headings
from outlinelake.operators.links import parse_links, standing, with_heading
from outlinelake.plans import catalog
from outlinelake.plans import queries as Q
from outlinelake.sources.scan import scan
from outlinelake.synth import render, render_parts

TODAY = "1998-01-01"
_made: dict[tuple, str] = {}


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; in a temporary one if it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='outlinelake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _database(spark: SparkSession, sf_dir: str, made: Callable[[SparkSession, str], DataFrame] = render) -> dict[str, DataFrame]:
    """text (file, value) of the rendered outlines, and the tables parsed from it: once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, made.__name__)
    if key not in _made or not catalog.exists(spark, f"{_made[key]}/files/_SUCCESS"):
        path = _folder(spark, "outlines")
        made(spark, sf_dir).write.parquet(f"{path}/text")
        text = spark.read.parquet(f"{path}/text")
        manifest = text.select("file", F.lit(None).cast("timestamp").alias("mtime"), F.char_length("value").cast("long").alias("size"), F.sha2("value", 256).alias("sha256"))
        catalog.save({"files": manifest, **catalog.parse(text)}, path)
        _made[key] = path
    return {"text": spark.read.parquet(f"{_made[key]}/text"), **catalog.load(spark, _made[key])}


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir)["headings"]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir)["links"]


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def headings_by_level(spark, sf_dir):
    return Q.by_level(_headings(spark, sf_dir)).select(F.col("level").cast("int"), F.col("n").cast("long"))


def heading_lines(spark, sf_dir):
    return _headings(spark, sf_dir).select("file", "line_number", "level", F.regexp_replace("title", r" \[\d+/\d+\]$", "").alias("title"))


def heading_positions(spark, sf_dir):
    return _headings(spark, sf_dir).select("file", "line_number", "position", "level")


def heading_parent(spark, sf_dir):
    rows = Q.with_parent_title(_headings(spark, sf_dir)).where("level in (2, 3)")
    return rows.select(F.regexp_replace("title", r" \[\d+/\d+\]$", "").alias("title"), "level", "parent_title")


def heading_ids(spark, sf_dir):
    return _headings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("heading_id").alias("n_ids"))


def heading_fields(spark, sf_dir):
    return _headings(spark, sf_dir).where("level = 3").select(F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"), F.coalesce("todo", F.lit("none")).alias("todo"), "priority")


def heading_cookies(spark, sf_dir):
    return _headings(spark, sf_dir).where("level = 3").select(F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"), F.coalesce("cookie_done", F.lit(-1)).alias("cookie_done"), F.coalesce("cookie_total", F.lit(-1)).alias("cookie_total"))


def heading_planning(spark, sf_dir):
    return _headings(spark, sf_dir).where("level = 3").select(F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"), _day("scheduled").alias("scheduled"), _day("deadline").alias("deadline"), F.coalesce(_day("closed"), F.lit("never")).alias("closed"))


def heading_tags(spark, sf_dir):
    return _headings(spark, sf_dir).where("level = 2").select("title", F.explode("tags").alias("tag"))


def property_lookup(spark, sf_dir):
    return Q.property_rows(_headings(spark, sf_dir)).select(F.regexp_replace("title", r" \[\d+/\d+\]$", "").alias("title"), "key", "value")


def tag_counts(spark, sf_dir):
    return Q.tag_counts(_headings(spark, sf_dir))


def agenda_between(spark, sf_dir):
    return Q.agenda(_headings(spark, sf_dir), "1996-03-01", "1996-03-31").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"))


def overdue(spark, sf_dir):
    return Q.overdue(_headings(spark, sf_dir), TODAY).select(F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"), F.col("days_late").cast("int"))


def done_ratio_by_parent(spark, sf_dir):
    headings = _headings(spark, sf_dir)
    names = headings.select(F.col("heading_id").alias("parent_id"), "title")
    return Q.done_ratio_by_parent(headings).join(names, "parent_id").select("title", F.col("n_done").cast("long"), F.col("n_todo").cast("long"), F.round("ratio", 6).alias("ratio"))


def priority_topk(spark, sf_dir):
    rows = Q.top_by_priority(_headings(spark, sf_dir).where("level = 3").withColumn("title", F.lpad(F.regexp_extract("title", r"^Order (\d+)", 1), 12, "0")), F.col("file"), 5)
    return rows.select("file", F.col("place").cast("int"), "priority", F.col("title").cast("long").alias("orderkey"))


def subtree_rollup(spark, sf_dir):
    rows = Q.subtree_rollup(_headings(spark, sf_dir))
    return rows.select(F.regexp_replace("title", r" \[\d+/\d+\]$", "").alias("title"), "level", F.col("n_below").cast("long"), F.col("n_open").cast("long"))


def inherited_tags(spark, sf_dir):
    headings = _headings(spark, sf_dir)
    return Q.inherited_tags(headings).join(headings.select("heading_id", "level"), "heading_id").groupBy("level", "tag").agg(F.count(F.lit(1)).alias("n"))


def link_fields(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("file", "full_link", "type", "link", "description").agg(F.count(F.lit(1)).alias("n"))


def link_positions(spark, sf_dir):
    """What stands at each link's position in its file, which must be the link."""
    tables = _database(spark, sf_dir)
    return standing(tables["links"], tables["text"]).groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("n_right"))


def links_by_type(spark, sf_dir):
    return Q.links_by_type(_links(spark, sf_dir).unionByName(_database(spark, sf_dir, render_parts)["links"]))


def part_links(spark, sf_dir):
    """Links of five types, without description, with the heading that holds each."""
    tables = _database(spark, sf_dir, render_parts)
    held = with_heading(tables["links"], tables["headings"]).join(tables["headings"].select("heading_id", "title"), "heading_id")
    return held.select(F.regexp_extract("title", r"^Part (\d+)", 1).cast("long").alias("partkey"), "type", "link", "full_link", F.coalesce("description", F.lit("none")).alias("description"))


def percent_cookies(spark, sf_dir):
    headings = _database(spark, sf_dir, render_parts)["headings"].where("level = 2")
    return headings.select(F.regexp_extract("title", r"^Part (\d+)", 1).cast("long").alias("partkey"), "cookie_pct", F.coalesce("cookie_done", F.lit(-1)).alias("cookie_done"))


def link_headings(spark, sf_dir):
    tables = _database(spark, sf_dir)
    held = with_heading(tables["links"], tables["headings"]).join(tables["headings"].select("heading_id", "title"), "heading_id")
    return held.select(F.regexp_extract("title", r"^Order (\d+)", 1).cast("long").alias("orderkey"), "link")


def backlinks(spark, sf_dir):
    tables = _database(spark, sf_dir)
    return Q.backlinks(tables["links"], tables["headings"]).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def broken_links(spark, sf_dir):
    tables = _database(spark, sf_dir)
    return Q.broken_links(tables["links"], tables["headings"]).groupBy("link", "description").agg(F.count(F.lit(1)).alias("n"))


def text_search(spark, sf_dir):
    found = search(_database(spark, sf_dir)["text"], r"^\*\*\* DONE \[#A\]")
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def line_counts(spark, sf_dir):
    return to_lines(_database(spark, sf_dir)["text"]).groupBy("file").agg(F.max("line_number").cast("long").alias("n_lines"))


def documents_without_markup(spark, sf_dir):
    """The documents table holds no outline markup: no headings, no links."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.col("text").alias("value"))
    return parse_headings(text).select("file").unionByName(parse_links(text).select("file"))


def changed_files(spark, sf_dir):
    """Of three kinds of nations, changed, added and deleted, what a manifest tells."""
    old = _database(spark, sf_dir)["text"].select("file", F.lit(1).alias("mtime"), F.char_length("value").cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"))
    number = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    new = old.where(number % 5 != 1).withColumn("size", F.when(number % 5 == 2, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.diff(new, old.where(number % 5 != 3))


def _write_files(text: DataFrame, folder: str) -> None:
    """Each outline as a file of its own, in a folder named by it; folders of other outlines stay. The writer adds the last line feed."""
    body = text.select("file", F.regexp_replace("value", r"\n$", "").alias("value"))
    body.repartition("file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").text(folder)


def _nation_file(file):
    return F.regexp_extract(file, r"file=(nation-\d+\.org)/", 1)


def scanned_files(spark, sf_dir):
    """Outlines written as files and scanned: bytes and lines of each."""
    folder = _folder(spark, "files")
    _write_files(_database(spark, sf_dir)["text"], folder)
    return scan(spark, [folder], "*.txt").select(_nation_file(F.col("file")).alias("file"), "size", F.regexp_count("value", F.lit("\n")).cast("long").alias("n_lines"))


def saved_tables(spark, sf_dir):
    """Rows of the three saved tables, and distinct files in them."""
    tables = _database(spark, sf_dir)
    counts = [tables[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files")) for n in catalog.TABLES]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def refreshed_tables(spark, sf_dir):
    """A whole refresh: of five kinds of nations one comes, one goes, and one gets a heading; what the tables hold then."""
    folder, path = _folder(spark, "files"), _folder(spark, "refreshed")
    text, number = _database(spark, sf_dir)["text"], F.regexp_extract("file", r"(\d+)", 1).cast("int")
    _write_files(text.where(number % 5 != 3), folder)
    catalog.refresh(spark, [folder], path, "*.txt")
    _write_files(text.where(number % 5 == 3), folder)
    _write_files(text.where(number % 5 == 2).withColumn("value", F.concat("value", F.lit("* Added\nsee [[#nowhere]]\n"))), folder)
    for row in text.where(number % 5 == 1).select("file").collect():  # at most a row for each nation
        catalog.delete(spark, f"{folder}/file={row['file']}")
    tables = catalog.refresh(spark, [folder], path, "*.txt")
    links = tables["links"].groupBy(_nation_file(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("n_links"))
    headings = tables["headings"].groupBy(_nation_file(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("n_headings"), F.max("line_number").cast("long").alias("last_line"))
    files = tables["files"].select(_nation_file(F.col("file")).alias("file"))
    return files.join(headings, "file", "left").join(links, "file", "left").select("file", "n_headings", "last_line", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        headings_by_level, heading_lines, heading_positions, heading_parent, heading_ids, heading_fields, heading_cookies, heading_planning, heading_tags,
        property_lookup, tag_counts, agenda_between, overdue, done_ratio_by_parent, priority_topk, subtree_rollup, inherited_tags, link_fields,
        link_positions, links_by_type, link_headings, backlinks, broken_links, text_search, line_counts, documents_without_markup, changed_files,
        part_links, percent_cookies, scanned_files, saved_tables, refreshed_tables,
    )
}

_FILE = "'nation-' || c_nationkey || '.org'"
_JOIN = "orders JOIN customer ON c_custkey = o_custkey"
_LINES = f"""
WITH o AS (SELECT c_nationkey, c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, o_orderkey) AS k FROM {_JOIN}),
c AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
n AS (SELECT c.c_nationkey, c.c_custkey, count(o_orderkey) AS m FROM c LEFT JOIN o USING (c_custkey) GROUP BY ALL),
before AS (SELECT c_nationkey, c_custkey, coalesce(sum(m) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
"""

#: Each heading's section with its number of lines and code points, in the order (nation, customer, order) of its file.
_SECTIONS = f"""
WITH items AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS d, count(*) AS t FROM lineitem GROUP BY 1),
sections AS (
    SELECT 'nation-' || n_nationkey || '.org' AS file, NULL AS c_custkey, NULL AS o_orderkey, 1 AS level, 1 AS lines, length('* ' || n_name || '  :nation:') + 1 AS chars FROM nation
    UNION ALL SELECT {_FILE}, c_custkey, NULL, 2, 4, length('** ' || c_name || '  :' || c_mktsegment || ':') + length(':PROPERTIES:') + length(CASE WHEN c_custkey % 7 = 0 THEN ':FORMER_ID: cust-' ELSE ':CUSTOM_ID: cust-' END || c_custkey) + length(':END:') + 4 FROM customer
    UNION ALL SELECT {_FILE}, c_custkey, o_orderkey, 3, 6,
        length('*** ' || CASE o_orderstatus WHEN 'F' THEN 'DONE ' WHEN 'O' THEN 'TODO ' ELSE '' END || '[#A] Order ' || o_orderkey || coalesce(' [' || d || '/' || t || ']', ''))
        + length('SCHEDULED: <2000-01-01 Sat> DEADLINE: <2000-01-01 Sat 17:30>') + CASE WHEN o_orderstatus = 'F' THEN length(' CLOSED: [2000-01-01 Sat]') ELSE 0 END
        + length(':PROPERTIES:') + length(':TOTAL: ' || printf('%.2f', o_totalprice)) + length(':END:') + length('for [[#cust-' || c_custkey || '][' || c_name || ']]') + 6
    FROM {_JOIN} LEFT JOIN items ON l_orderkey = o_orderkey
)
"""
_PART_LINK = "CASE p_partkey % 5 WHEN 0 THEN 'https://parts.example/' || p_partkey WHEN 1 THEN './part-' || p_partkey || '.org' WHEN 2 THEN 'mailto:part' || p_partkey || '@example.org' WHEN 3 THEN '#part-' || p_partkey ELSE 'part ' || p_partkey END"
_PART_TYPE = "CASE p_partkey % 5 WHEN 0 THEN 'https' WHEN 1 THEN 'file' WHEN 2 THEN 'mailto' WHEN 3 THEN 'custom-id' ELSE 'fuzzy' END"

ORACLES: dict[str, str] = {
    "headings_by_level": f"SELECT 1::int AS level, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FROM customer UNION ALL SELECT 3, count(*) FROM {_JOIN}",
    "heading_lines": f"""{_LINES} SELECT 'nation-' || n_nationkey || '.org' AS file, 1::int AS line_number, 1::int AS level, n_name AS title FROM nation
        UNION ALL SELECT {_FILE}, (2 + 4 * (k - 1) + 6 * b)::int, 2, c_name FROM c JOIN before USING (c_nationkey, c_custkey)
        UNION ALL SELECT 'nation-' || o.c_nationkey || '.org', (2 + 4 * c.k + 6 * (o.k - 1))::int, 3, 'Order ' || o_orderkey FROM o JOIN c USING (c_custkey)""",
    "heading_positions": f"""{_SECTIONS} SELECT file, (1 + coalesce(sum(lines) OVER before, 0))::int AS line_number, (1 + coalesce(sum(chars) OVER before, 0))::int AS position, level::int AS level
        FROM sections WINDOW before AS (PARTITION BY file ORDER BY c_custkey NULLS FIRST, o_orderkey NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "heading_parent": f"SELECT c_name AS title, 2::int AS level, n_name AS parent_title FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'Order ' || o_orderkey, 3, c_name FROM {_JOIN}",
    "heading_ids": f"SELECT n, n AS n_ids FROM (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM {_JOIN}) AS n)",
    "heading_fields": f"SELECT o_orderkey AS orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'TODO' ELSE 'none' END AS todo, translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') AS priority FROM {_JOIN}",
    "heading_cookies": f"SELECT o_orderkey AS orderkey, coalesce(d, -1)::int AS cookie_done, coalesce(t, -1)::int AS cookie_total FROM {_JOIN} LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS d, count(*) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "heading_planning": f"SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00') AS scheduled, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d 17:30') AS deadline, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d 00:00') ELSE 'never' END AS closed FROM {_JOIN}",
    "heading_tags": "SELECT c_name AS title, lower(c_mktsegment) AS tag FROM customer",
    "property_lookup": f"SELECT c_name AS title, CASE WHEN c_custkey % 7 = 0 THEN 'FORMER_ID' ELSE 'CUSTOM_ID' END AS key, 'cust-' || c_custkey AS value FROM customer UNION ALL SELECT 'Order ' || o_orderkey, 'TOTAL', printf('%.2f', o_totalprice) FROM {_JOIN}",
    "tag_counts": "SELECT lower(c_mktsegment) AS tag, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'nation', count(*) FROM nation",
    "agenda_between": f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS orderkey FROM {_JOIN} WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-01'",
    "overdue": f"SELECT o_orderkey AS orderkey, date_diff('day', (o_orderdate + INTERVAL 30 DAY)::date, DATE '{TODAY}')::int AS days_late FROM {_JOIN} WHERE o_orderstatus = 'O' AND (o_orderdate + INTERVAL 30 DAY)::date < DATE '{TODAY}'",
    "done_ratio_by_parent": f"SELECT c_name AS title, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) AS n_todo, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::double, 6) AS ratio FROM {_JOIN} WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "priority_topk": f"SELECT file, place::int AS place, priority, orderkey FROM (SELECT {_FILE} AS file, translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') AS priority, o_orderkey AS orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority, o_orderkey) AS place FROM {_JOIN}) WHERE place <= 5",
    "subtree_rollup": f"""SELECT n_name AS title, 1::int AS level, count(DISTINCT c_custkey) + count(o_orderkey) AS n_below, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
        UNION ALL SELECT c_name, 2, count(o_orderkey), count(*) FILTER (o_orderstatus = 'O') FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
        UNION ALL SELECT 'Order ' || o_orderkey, 3, 0, 0 FROM {_JOIN}""",
    "inherited_tags": f"""SELECT 3::int AS level, lower(c_mktsegment) AS tag, count(*) AS n FROM {_JOIN} GROUP BY ALL UNION ALL SELECT 3, 'nation', count(*) FROM {_JOIN}
        UNION ALL SELECT 2, lower(c_mktsegment), count(*) FROM customer GROUP BY ALL UNION ALL SELECT 2, 'nation', count(*) FROM customer UNION ALL SELECT 1, 'nation', count(*) FROM nation""",
    "link_fields": f"SELECT {_FILE} AS file, '[[#cust-' || c_custkey || '][' || c_name || ']]' AS full_link, 'custom-id' AS type, '#cust-' || c_custkey AS link, c_name AS description, count(*) AS n FROM {_JOIN} GROUP BY ALL",
    "link_positions": f"SELECT {_FILE} AS file, count(*) AS n, count(*) AS n_right FROM {_JOIN} GROUP BY 1",
    "links_by_type": f"SELECT type, count(*) AS n FROM (SELECT 'custom-id' AS type FROM {_JOIN} UNION ALL SELECT {_PART_TYPE} FROM part) GROUP BY 1",
    "part_links": f"SELECT p_partkey AS partkey, {_PART_TYPE} AS type, {_PART_LINK} AS link, '[[' || {_PART_LINK} || ']]' AS full_link, 'none' AS description FROM part",
    "percent_cookies": "SELECT p_partkey AS partkey, p_size AS cookie_pct, -1::int AS cookie_done FROM part",
    "scanned_files": f"{_SECTIONS} SELECT file, sum(chars)::bigint AS size, sum(lines)::bigint AS n_lines FROM sections GROUP BY 1",
    "saved_tables": f"""SELECT 'files' AS name, count(*) AS n, count(*) AS n_files FROM nation
        UNION ALL SELECT 'headings', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM {_JOIN}), (SELECT count(*) FROM nation)
        UNION ALL SELECT 'links', count(*), count(DISTINCT c_nationkey) FROM {_JOIN}""",
    "refreshed_tables": """SELECT 'nation-' || n_nationkey || '.org' AS file, 1 + count(DISTINCT c_custkey) + count(o_orderkey) + any_value(e) AS n_headings,
        CASE WHEN any_value(e) = 1 THEN 2 + 4 * count(DISTINCT c_custkey) + 6 * count(o_orderkey) ELSE any_value(last) END AS last_line, count(o_orderkey) + any_value(e) AS n_links
        FROM (SELECT *, CASE WHEN n_nationkey % 5 = 2 THEN 1 ELSE 0 END AS e FROM nation) LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
        LEFT JOIN (WITH all_c AS (SELECT c_nationkey AS k, max(c_custkey) AS c, count(*) AS m FROM customer GROUP BY 1), n_o AS (SELECT c_nationkey AS k, count(*) AS o FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
            own AS (SELECT o_custkey, count(*) AS q FROM orders GROUP BY 1)
            SELECT k, CASE WHEN coalesce(q, 0) > 0 THEN 1 + 4 * m + 6 * (coalesce(o, 0) - 1) + 1 ELSE 1 + 4 * (m - 1) + 6 * coalesce(o, 0) + 1 END AS last FROM all_c LEFT JOIN n_o USING (k) LEFT JOIN own ON o_custkey = c) ON k = n_nationkey
        WHERE n_nationkey % 5 <> 1 GROUP BY n_nationkey""",
    "link_headings": f"SELECT o_orderkey AS orderkey, '#cust-' || c_custkey AS link FROM {_JOIN}",
    "backlinks": f"SELECT c_name AS title, count(*) AS n FROM {_JOIN} WHERE c_custkey % 7 <> 0 GROUP BY 1",
    "broken_links": f"SELECT '#cust-' || c_custkey AS link, c_name AS description, count(*) AS n FROM {_JOIN} WHERE c_custkey % 7 = 0 GROUP BY ALL",
    "text_search": f"SELECT {_FILE} AS file, count(*) AS n FROM {_JOIN} WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY 1",
    "line_counts": "SELECT 'nation-' || n_nationkey || '.org' AS file, 1 + 4 * count(DISTINCT c_custkey) + 6 * count(o_orderkey) AS n_lines FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "documents_without_markup": "SELECT 'doc-' || doc_id AS file FROM documents WHERE regexp_matches(text, '(?m)^\\*+ ') OR text LIKE '%[[%]]%'",
    "changed_files": "SELECT 'nation-' || n_nationkey || '.org' AS file, CASE n_nationkey % 5 WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' WHEN 3 THEN 'new' END AS change FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)",
}
