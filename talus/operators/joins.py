"""Joins: semi and anti, tolerance, alternatives, latest-per-group, scalar sub-selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import nearby_bins
from talus.sources import table


def anti_join_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def semi_exists_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a customer has an urgent order, and how many open ones: one aggregate joined once."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open")
    )
    joined = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def tolerance_anti(spark: SparkSession, d: str) -> DataFrame:
    """Purchases without a click of the same user within ten minutes: users and ten-minute bins meet, the range is a filter.

    A purchase looks into three bins; it stays if none of them holds a click near enough.
    """
    events, width = table(spark, d, "events"), 600_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    buys, clicks = (events.where(F.col("event_type") == k).select("event_id", "user_id", at.alias("t")) for k in ("purchase", "click"))
    clicks = clicks.select(F.col("user_id").alias("u"), F.col("t").alias("v"), F.floor(F.col("t") / width).alias("b"))
    looks = buys.withColumn("bin", nearby_bins(F.col("t"), width, -1, 1))
    near = (F.col("user_id") == F.col("u")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("t") - F.col("v")) <= width)
    found = looks.join(clicks, near, "left_semi").select("event_id").distinct()
    return buys.join(found, "event_id", "left_anti").select("event_id", "user_id")


def or_join_top1(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier the customer of its nation or of its number, the richest first: two equalities in a union."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    best = c.groupBy("c_nationkey").agg(F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("b"))
    by_nation = s.join(best, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "b")
    by_number = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", F.struct("c_acctbal", (-F.col("c_custkey")).alias("k")).alias("b"))
    both = by_nation.unionByName(by_number).groupBy("s_suppkey").agg(F.max("b").alias("b"))
    return both.select("s_suppkey", (-F.col("b.k")).alias("c_custkey"), F.col("b.c_acctbal").alias("c_acctbal"))


def null_safe_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of languages equal or both absent, counted: null-safe equality on pre-aggregated sides."""
    docs = table(spark, d, "documents").withColumn("k", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    a = docs.groupBy("k").agg(F.count("*").alias("n_documents"))
    b = docs.where("doc_id % 2 = 0").groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n_even"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "left").select("k", "n_documents", F.coalesce("n_even", F.lit(0)).alias("n_even"))


def stitched_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines in order, as text."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["l_linenumber"], e["l_partkey"])), ",")
    return lines.select("l_orderkey", text.alias("lines"), F.size("x").cast("long").alias("n_lines"))


QUERIES = {f.__name__: f for f in (anti_join_customers, semi_exists_flag, tolerance_anti, or_join_top1, null_safe_match, stitched_children)}
SQL = {
    "anti_join_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "semi_exists_flag": """SELECT c_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "tolerance_anti": """SELECT event_id, user_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c
        WHERE c.event_type = 'click' AND c.user_id = p.user_id AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 600000000)""",
    "or_join_top1": """SELECT s_suppkey, c_custkey, c_acctbal FROM (SELECT s_suppkey, c_custkey, c_acctbal,
        row_number() OVER (PARTITION BY s_suppkey ORDER BY c_acctbal DESC, c_custkey) AS n
        FROM supplier JOIN customer ON s_nationkey = c_nationkey OR s_suppkey = c_custkey) WHERE n = 1""",
    "null_safe_match": """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS k FROM documents)
        SELECT k, count(*) AS n_documents, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_even FROM x GROUP BY k""",
    "stitched_children": """SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines,
        count(*) AS n_lines FROM lineitem GROUP BY l_orderkey""",
}
