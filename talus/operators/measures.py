"""Measures: spreads, rates with guards, rules over counts, stability, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import minutes_since_midnight, ordinal, round_js
from talus.sources import table


def having_key(spark: SparkSession, d: str) -> DataFrame:
    """Customers with at least eight orders: a filter after the aggregate, the one on the key before it."""
    groups = table(spark, d, "orders").where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("dearest"))
    return groups.where("n_orders >= 8")


def daily_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day and kind, and purchases for each hundred views and clicks, rounded half up; no rate without them."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"), kind("error").alias("errors")
    )
    seen = F.col("views") + F.col("clicks")
    return days.withColumn("rate", F.when(seen > 0, round_js(100 * F.col("purchases") / seen)).cast("long"))


def main_pattern(spark: SparkSession, d: str) -> DataFrame:
    """One pattern for each user by a cascade over counts: the first rule that holds."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    users = table(spark, d, "events").groupBy("user_id").agg(kind("error").alias("e"), kind("purchase").alias("p"), kind("click").alias("c"), F.count("*").alias("n"))
    pattern = F.when(F.col("e") * 3 >= F.col("n"), "failing").when(F.col("p") * 3 >= F.col("n"), "buying").when(F.col("c") * 4 >= F.col("n"), "browsing")
    return users.select("user_id", pattern.otherwise("mixed").alias("pattern"))


def bucket_mode(spark: SparkSession, d: str) -> DataFrame:
    """The half hour of the day with most events of each kind, ties to the earlier one."""
    bucket = (F.floor(minutes_since_midnight(F.col("ts")) / 30) * 30).alias("bucket")
    counts = table(spark, d, "events").groupBy("event_type", bucket).agg(F.count("*").alias("n"))
    best = counts.groupBy("event_type").agg(F.max(F.struct("n", (-F.col("bucket")).alias("b"))).alias("m"))
    return best.select("event_type", (-F.col("m.b")).cast("long").alias("bucket"), F.col("m.n").alias("n"))


def weekday_peak(spark: SparkSession, d: str) -> DataFrame:
    """Errors on each working day, days without any at zero, and which day is the first with most."""
    day = F.weekday("ts")
    counts = table(spark, d, "events").where("event_type = 'error'").where(day < 5).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    days = spark.range(5).select(F.col("id").cast("int").alias("day")).join(counts, "day", "left").fillna(0, ["n"])
    peak = days.agg(F.max(F.struct("n", (-F.col("day")).alias("d"))).alias("m"))  # one row
    return days.crossJoin(F.broadcast(peak)).select(F.col("day").cast("long").alias("day"), "n", (F.col("day") == -F.col("m.d")).alias("peak"))


def daily_work_average(spark: SparkSession, d: str) -> DataFrame:
    """Sum and count by day, and the mean of a day's value."""
    days = table(spark, d, "events").where("value IS NOT NULL").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    days = days.agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("s"), F.count("*").alias("n"))
    return days.select("day", F.col("s").cast("double").alias("total"), "n", F.round(F.col("s").cast("double") / F.col("n"), 3).alias("mean"))


def spread_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.round(F.avg("o_totalprice"), 1).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count("*").alias("n")
    )


def duration_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and least days from order to shipping, over lines that ship after their order."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    days = F.when(days >= 0, days)
    return joined.agg(F.round(F.avg(days), 3).alias("mean_days"), F.min(days).cast("long").alias("least_days"), F.count(days).alias("n"))


def guarded_rate(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines by those not accepted, for each supplier; zero where there are none."""
    n = lambda k: F.count_if(F.col("l_returnflag") == k)
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(n("R").alias("returned"), (F.count("*") - n("A")).alias("open"))
    rate = F.when(F.col("open") > 0, F.round(F.col("returned") / F.col("open"), 4)).otherwise(0.0)
    return rows.select("l_suppkey", "returned", "open", rate.alias("rate"))


def count_and_first(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer and the first one in the order of price: one pass with a maximum of structs."""
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), best.alias("b"))
    return groups.select("o_custkey", "n_orders", (-F.col("b.k")).alias("first_order"))


def rounded_then_summed(spark: SparkSession, d: str) -> DataFrame:
    """Each line's discount is rounded to cents, and then summed by order."""
    cents = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)"), 2)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).cast("double").alias("discount"))


def stability(spark: SparkSession, d: str) -> DataFrame:
    """How steady each customer's orders are: least and most, population deviation (0 for one), and whether all have one priority."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.round(F.stddev_pop("o_totalprice"), 1).alias("deviation"),
        (F.min("o_orderpriority") == F.max("o_orderpriority")).alias("consistent"), F.count("*").alias("n"),
    )


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of a user's events in the order in which they first came."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    kinds = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x"))  # a handful of kinds
    return kinds.select("user_id", F.array_join("x.event_type", ",").alias("kinds"))


def submission_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Which order of its customer an order is, as a number and in words."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", n.cast("long").alias("number"), ordinal(n).alias("label"))


def covered_if_valid(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a user was seen, counted only where all the user's rows are usable; else the number of rows."""
    users = table(spark, d, "events").groupBy("user_id").agg(
        F.bool_and(F.col("value") > 1).alias("valid"), F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n")
    )
    return users.select("user_id", F.when(F.col("valid"), F.col("days")).otherwise(F.col("n")).alias("covered"))


def nation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers, balances and customers in credit by nation; aggregated by key before the names are joined."""
    money = F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double")
    by_key = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), money.alias("balance"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"))
    return by_key.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", "balance", "in_credit")


def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct kinds by user, counted: two levels of aggregation, the first before the shuffle."""
    pairs = table(spark, d, "events").select("user_id", "event_type").distinct()
    return pairs.groupBy("event_type").agg(F.count("*").alias("n_users"))


QUERIES = {
    f.__name__: f
    for f in (
        having_key, daily_counters, main_pattern, bucket_mode, weekday_peak, daily_work_average, spread_by_priority, duration_spread,
        guarded_rate, count_and_first, rounded_then_summed, stability, ordered_union, submission_ordinal, covered_if_valid,
        nation_rollup, distinct_pairs,
    )
}
SQL = {
    "having_key": """SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS dearest FROM orders GROUP BY o_custkey
        HAVING count(*) >= 8 AND o_custkey % 2 = 0""",
    "daily_counters": """SELECT *, CASE WHEN views + clicks > 0 THEN floor(100 * purchases / (views + clicks) + 0.5)::BIGINT END AS rate FROM (
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS views,
        count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
        count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY day)""",
    "main_pattern": """SELECT user_id, CASE WHEN e * 3 >= n THEN 'failing' WHEN p * 3 >= n THEN 'buying' WHEN c * 4 >= n THEN 'browsing'
        ELSE 'mixed' END AS pattern FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e,
        count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id)""",
    "bucket_mode": """SELECT event_type, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bucket) AS r FROM (
        SELECT event_type, ((hour(ts) * 60 + minute(ts)) // 30 * 30)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1""",
    "weekday_peak": """WITH x AS (SELECT day::BIGINT AS day, count(event_id) AS n FROM range(5) t(day)
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') ON isodow(ts) - 1 = day GROUP BY day)
        SELECT day, n, day = (SELECT day FROM x ORDER BY n DESC, day LIMIT 1) AS peak FROM x""",
    "daily_work_average": """SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value::DECIMAL(12,2))::DOUBLE AS total, count(*) AS n,
        round(sum(value::DECIMAL(12,2))::DOUBLE / count(*), 3) AS mean FROM events WHERE value IS NOT NULL GROUP BY day""",
    "spread_by_priority": """SELECT o_orderpriority, round(avg(o_totalprice), 1) AS mean, min(o_totalprice) AS least,
        max(o_totalprice) AS most, count(*) AS n FROM orders GROUP BY o_orderpriority""",
    "duration_spread": """SELECT round(avg(x), 3) AS mean_days, min(x)::BIGINT AS least_days, count(x) AS n FROM (
        SELECT CASE WHEN date_diff('day', o_orderdate, l_shipdate) >= 0 THEN date_diff('day', o_orderdate, l_shipdate) END AS x
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "guarded_rate": """SELECT *, CASE WHEN open > 0 THEN round(returned / open, 4) ELSE 0.0::DOUBLE END AS rate FROM (
        SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag <> 'A') AS open
        FROM lineitem GROUP BY l_suppkey)""",
    "count_and_first": """SELECT o_custkey, n_orders, o_orderkey AS first_order FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n_orders,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
    "rounded_then_summed": """SELECT l_orderkey, sum(round(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2), 2))::DOUBLE AS discount
        FROM lineitem GROUP BY l_orderkey""",
    "stability": """SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most, round(stddev_pop(o_totalprice), 1) AS deviation,
        count(DISTINCT o_orderpriority) = 1 AS consistent, count(*) AS n FROM orders GROUP BY o_custkey""",
    "ordered_union": """SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS kinds FROM (SELECT user_id, event_type, min(ts) AS t,
        arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
    "submission_ordinal": """SELECT o_orderkey, n AS number, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st'
        WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""",
    "covered_if_valid": """SELECT user_id, CASE WHEN bool_and(value > 1) THEN count(DISTINCT ts::DATE) ELSE count(*) END AS covered
        FROM events GROUP BY user_id""",
    "nation_rollup": """SELECT n_name, count(*) AS n, sum(c_acctbal::DECIMAL(12,2))::DOUBLE AS balance,
        count(*) FILTER (WHERE c_acctbal > 0) AS in_credit FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "distinct_pairs": "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
}
