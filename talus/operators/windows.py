"""Ranking, intervals, allocation, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import custom_rank
from talus.operators.shares import capped_shares
from talus.sources import table


def rank_sequential_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Ranks 1, 2, 3 ... of finished orders by customer; other orders have none. One window, no join back."""
    by = Window.partitionBy("o_custkey", F.col("o_orderstatus") == "F").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    rank = F.when(F.col("o_orderstatus") == "F", F.row_number().over(by))
    return table(spark, d, "orders").select("o_orderkey", rank.cast("long").alias("rank"))


def rank_competition_peers(spark: SparkSession, d: str) -> DataFrame:
    """One more than the customer's open orders that cost strictly more, for every order."""
    peer = F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    higher = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("o_custkey", "o_totalprice")
    rank = 1 + F.sum(peer).over(higher) - F.sum(peer).over(equal)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("rank"))


def covered_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Days that a user's sessions of up to three days cover, overlaps and neighbours merged."""
    start = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    spans = table(spark, d, "events").select("user_id", start.alias("a"), (start + F.pmod("event_id", F.lit(3))).cast("int").alias("b")).distinct()
    before = Window.partitionBy("user_id").orderBy("a", "b")
    spans = spans.withColumn("_far", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_new", F.when(F.col("a") > F.coalesce(F.col("_far"), F.lit(-10)) + 1, 1).otherwise(0))
    spans = spans.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = spans.groupBy("user_id", "_island").agg((F.max("b") - F.min("a") + 1).alias("days"))
    return islands.groupBy("user_id").agg(F.sum("days").alias("days"), F.count("*").alias("islands"))


def largest_remainder_weights(spark: SparkSession, d: str) -> DataFrame:
    """Whole weights of brands that add up to 100: floors, then one more by the largest remainders."""
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    found = capped_shares(brands.withColumn("all", F.lit(1)), "all", "p_brand", "n", 100, 100)
    return found.select(F.col("item").alias("p_brand"), F.col("weight").alias("n"), F.col("share").alias("weight"))


def null_sorting_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 20 orders by a chosen order of status, price descending with missing ones last, and key."""
    rows = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    order = [custom_rank(F.col("o_orderstatus"), ["P", "O", "F"]), F.col("price").desc_nulls_last(), F.col("o_orderkey")]
    return rows.orderBy(*order).offset(40).limit(20).select("o_orderkey", "o_orderstatus", "price")


def diverse_topk(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Five parts of every brand: the best of each type first, then the best of the rest."""
    by_type = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    rows = table(spark, d, "part").withColumn("_first", F.row_number().over(by_type) == 1)
    final = Window.partitionBy("p_brand").orderBy(F.desc("_first"), F.desc("p_retailprice"), "p_partkey")
    return rows.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


def status_violations(spark: SparkSession, d: str) -> DataFrame:
    """Users whose purchase follows on an error, and how often."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("_before", F.lag("event_type").over(by))
    return rows.where("event_type = 'purchase' AND _before = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))


def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Words of every conversation by the last user turn they follow on."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "conversations").withColumn("section", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(by))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.groupBy("conv_id", "section").agg(F.sum(words).alias("words"), F.count("*").alias("turns"))


def union_histories(spark: SparkSession, d: str) -> DataFrame:
    """Orders and line items as one history by month and kind."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    a = table(spark, d, "orders").select(month("o_orderdate"), F.lit("order").alias("kind"))
    b = table(spark, d, "lineitem").select(month("l_shipdate"), F.lit("shipment").alias("kind"))
    return a.unionByName(b).groupBy("month", "kind").agg(F.count("*").alias("n"))


def json_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The size of the JSON properties by type, absent and empty ones apart."""
    size = F.coalesce(F.size(F.json_object_keys("props")), F.lit(0))
    return table(spark, d, "events").groupBy("event_type", size.alias("n_keys")).agg(F.count("*").alias("n"))


def source_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and outcome: labelled good, labelled bad or not labelled."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    outcome = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("unlabelled")
    return docs.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rank_sequential_filtered, rank_competition_peers, covered_intervals, largest_remainder_weights, null_sorting_page, diverse_topk, status_violations, section_forward_fill, union_histories, json_fallback, source_accounting)}
SQL = {
    "rank_sequential_filtered": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F'
        ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) END AS rank FROM orders""",
    "rank_competition_peers": """SELECT o_orderkey, 1 + (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'O'
        AND p.o_totalprice > o.o_totalprice) AS rank FROM orders o""",
    "covered_intervals": """WITH s AS (SELECT DISTINCT user_id, (ts::DATE - DATE '1970-01-01') AS a, (ts::DATE - DATE '1970-01-01') + event_id % 3 AS b FROM events),
        days AS (SELECT DISTINCT user_id, unnest(range(a, b + 1)) AS x FROM s),
        runs AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS r FROM days)
        SELECT user_id, count(*) AS days, count(DISTINCT r) AS islands FROM runs GROUP BY user_id""",
    "largest_remainder_weights": """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
        c AS (SELECT *, (n * 100) // sum(n) OVER () AS base, (n * 100) % sum(n) OVER () AS rest FROM b)
        SELECT p_brand, n, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, p_brand) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS weight FROM c""",
    "null_sorting_page": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders
        ORDER BY list_position(['P', 'O', 'F'], o_orderstatus), price DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""",
    "diverse_topk": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) = 1 AS first FROM part)
        SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first DESC, p_retailprice DESC, p_partkey) AS place FROM f) WHERE place <= 5""",
    "status_violations": """SELECT user_id, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
        WHERE event_type = 'purchase' AND b = 'error' GROUP BY 1""",
    "section_forward_fill": r"""WITH s AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
        SELECT conv_id, section, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS words, count(*) AS turns FROM s GROUP BY 1, 2""",
    "union_histories": """SELECT month, kind, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, 'order' AS kind FROM orders
        UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'shipment' FROM lineitem) GROUP BY 1, 2""",
    "json_fallback": "SELECT event_type, coalesce(len(json_keys(props)), 0)::INT AS n_keys, count(*) AS n FROM events GROUP BY 1, 2",
    "source_accounting": """SELECT source, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'unlabelled' END AS outcome, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
}
