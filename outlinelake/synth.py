"""Outline text rendered from the star schema: a file for each nation, its customers, and their orders; and one for each brand of parts.

A customer's heading has four lines (heading, drawer of one property) and an order's six (heading, planning, drawer, link).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): every order under its customer under its nation."""
    orders, customer, nation, items = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    done = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("done"), F.count(F.lit(1)).alias("total"))
    orders = orders.join(done, "o_orderkey", "left").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    todo = F.when(F.col("o_orderstatus") == "F", "DONE ").when(F.col("o_orderstatus") == "O", "TODO ").otherwise("")
    priority = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE")
    cookie = F.when(F.col("total").isNotNull(), F.concat(F.lit(" ["), "done", F.lit("/"), "total", F.lit("]"))).otherwise("")
    day = lambda c: F.date_format(c, "yyyy-MM-dd EEE")
    closed = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" CLOSED: ["), day(F.date_add("o_orderdate", 7)), F.lit("]"))).otherwise("")
    order = F.concat(
        F.lit("*** "), todo, F.lit("[#"), priority, F.lit("] Order "), "o_orderkey", cookie,
        F.lit("\nSCHEDULED: <"), day("o_orderdate"), F.lit("> DEADLINE: <"), day(F.date_add("o_orderdate", 30)), F.lit(" 17:30>"), closed,
        F.lit("\n:PROPERTIES:\n:TOTAL: "), F.format_string("%.2f", "o_totalprice"), F.lit("\n:END:\nfor [[#cust-"), "o_custkey", F.lit("]["), "c_name", F.lit("]]\n"),
    )
    by_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("text")))).alias("orders"))
    key = F.when(F.col("c_custkey") % 7 == 0, "FORMER_ID").otherwise("CUSTOM_ID")
    head = F.concat(F.lit("** "), "c_name", F.lit("  :"), F.lower("c_mktsegment"), F.lit(":\n:PROPERTIES:\n:"), key, F.lit(": cust-"), "c_custkey", F.lit("\n:END:\n"))
    people = customer.join(by_customer, "c_custkey", "left").select("c_nationkey", "c_custkey", F.concat(head, F.coalesce(F.array_join(F.transform("orders", lambda x: x["text"]), ""), F.lit(""))).alias("text"))
    by_nation = people.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))).alias("people"))
    body = F.coalesce(F.array_join(F.transform("people", lambda x: x["text"]), ""), F.lit(""))
    return nation.join(by_nation, "n_nationkey", "left").select(F.concat(F.lit("nation-"), "n_nationkey", F.lit(".org")).alias("file"), F.concat(F.lit("* "), "n_name", F.lit("  :nation:\n"), body).alias("value"))


def render_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): every part under its brand, its size as a cookie, with a link of one of five types."""
    part, key = _table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    link = F.element_at(F.array(F.concat(F.lit("https://parts.example/"), key), F.concat(F.lit("./part-"), key, F.lit(".org")), F.concat(F.lit("mailto:part"), key, F.lit("@example.org")), F.concat(F.lit("#part-"), key), F.concat(F.lit("part "), key)), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("** Part "), key, F.lit(" ["), F.col("p_size").cast("string"), F.lit("%]\nsee [["), link, F.lit("]]\n"))
    by_brand = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))).alias("parts"))
    return by_brand.select(F.concat(F.col("p_brand"), F.lit(".org")).alias("file"), F.concat(F.lit("* "), "p_brand", F.lit("\n"), F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("value"))
