"""Aggregations: conditional counts, first and last rows, modes, histograms, dense series, period comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import minutes_since_midnight, round_js
from talus.sources import table


def agg_conditional_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """Counts under conditions and a masked average by segment, in one pass over the join."""
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return rows.groupBy("c_mktsegment").agg(
        F.count("o_orderkey").alias("n_orders"),
        *(F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"),
        F.round(F.coalesce(F.avg(done), F.lit(0.0)), 2).alias("avg_done"),
    )


def dashboard_scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    """Several counts of one table in one row, in one scan."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").agg(
        F.count("*").alias("n_all"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(urgent).alias("n_urgent"),
        F.count_if(urgent & (F.col("o_orderstatus") == "O")).alias("n_urgent_open"), F.count_distinct("o_custkey").alias("n_customers"),
    )


def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user by (ts, id): a maximum of a struct instead of a join with itself."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", "x.event_id", "x.event_type")


def first_event_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the first view, click and purchase of every user in one pass."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.struct("ts", "event_id")))["event_id"].alias(f"first_{k}")
    return table(spark, d, "events").groupBy("user_id").agg(*map(first, ("view", "click", "purchase")))


def duration_avg_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Average whole minutes from a user's first view to the first purchase, not below zero, by the view's weekday."""
    at = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(k)
    users = table(spark, d, "events").groupBy("user_id").agg(at("view"), at("purchase")).where("view IS NOT NULL AND purchase IS NOT NULL")
    minutes = F.greatest(F.lit(0), F.timestamp_diff("MINUTE", F.col("view"), F.col("purchase")))
    return users.groupBy((F.dayofweek("view") - 1).alias("weekday")).agg(F.round(F.avg(minutes), 1).alias("minutes"), F.count("*").alias("n"))


def per_user_insight_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A count for every type and the share of errors, rounded half up."""
    kinds = ("view", "click", "purchase", "signup", "error")
    users = table(spark, d, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds), F.count("*").alias("n"))
    return users.withColumn("error_rate", round_js(F.col("error") * 100 / F.col("n")))


def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The commonest type of every user; among equals the one seen first."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    order = F.struct((-F.col("n")).alias("n"), "first")
    return counts.groupBy("user_id").agg(F.min_by("event_type", order).alias("mode"), F.max("n").alias("n"))


def hist_30min(spark: SparkSession, d: str) -> DataFrame:
    """Events by half hours of the day and type."""
    bucket = (F.floor(minutes_since_midnight(F.col("ts")) / 30) * 30).alias("minute")
    return table(spark, d, "events").groupBy(bucket, "event_type").agg(F.count("*").alias("n"))


def weekday_dense(spark: SparkSession, d: str) -> DataFrame:
    """Errors from Monday to Friday, days without any as zero."""
    days = spark.range(5).select(F.col("id").cast("int").alias("weekday"))
    errors = table(spark, d, "events").where("event_type = 'error'").groupBy(F.weekday("ts").alias("weekday")).agg(F.count("*").alias("n"))
    return days.join(errors, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def trend_day_or_month(spark: SparkSession, d: str, by_day_up_to: int = 90) -> DataFrame:
    """Orders by day, or by month where they span more than 90 days."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    span = orders.agg((F.datediff(F.max("day"), F.min("day")) > by_day_up_to).alias("long"))
    period = F.when(F.col("long"), F.date_format("day", "yyyy-MM")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    # the other side is one row
    return orders.crossJoin(F.broadcast(span)).groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


def period_delta(spark: SparkSession, d: str) -> DataFrame:
    """The last 30 days of events by type, and the 30 days before."""
    events = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    end = events.agg(F.max("day").alias("end"))
    age = F.datediff("end", "day")
    rows = events.crossJoin(F.broadcast(end)).where(age < 60)
    out = rows.groupBy("event_type").agg(F.count_if(age < 30).alias("now"), F.count_if(age >= 30).alias("before"))
    return out.withColumn("delta", F.col("now") - F.col("before"))


def topk_issue(spark: SparkSession, d: str) -> DataFrame:
    """The ten users with most errors, lower ids first among equals."""
    users = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return users.orderBy(F.desc("n"), "user_id").limit(10)


def weighted_average(spark: SparkSession, d: str) -> DataFrame:
    """Average discount by brand and the average of the averages weighed by count."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brands = rows.groupBy("p_brand").agg(F.avg("l_discount").alias("x"), F.count("*").alias("n"))
    return brands.agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.count("*").alias("brands"))


QUERIES = {f.__name__: f for f in (agg_conditional_by_segment, dashboard_scalar_counts, latest_event_per_user, first_event_by_type, duration_avg_minutes, per_user_insight_pivot, mode_first_seen, hist_30min, weekday_dense, trend_day_or_month, period_delta, topk_issue, weighted_average)}
SQL = {
    "agg_conditional_by_segment": """SELECT c_mktsegment, count(o_orderkey) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
        round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS avg_done
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "dashboard_scalar_counts": """SELECT count(*) AS n_all, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
        count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
        count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS n_urgent_open,
        count(DISTINCT o_custkey) AS n_customers FROM orders""",
    "latest_event_per_user": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "first_event_by_type": """SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'view') AS first_view,
        arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'click') AS first_click,
        arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id""",
    "duration_avg_minutes": """WITH u AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS v,
        min(ts) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
        SELECT dayofweek(v)::INT AS weekday, round(avg(greatest(0, date_sub('minute', v, p))), 1) AS minutes, count(*) AS n
        FROM u WHERE v IS NOT NULL AND p IS NOT NULL GROUP BY 1""",
    "per_user_insight_pivot": """SELECT *, floor(error * 100 / n + 0.5)::BIGINT AS error_rate FROM (SELECT user_id,
        count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click,
        count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup,
        count(*) FILTER (WHERE event_type = 'error') AS error, count(*) AS n FROM events GROUP BY user_id)""",
    "mode_first_seen": """SELECT user_id, event_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t, e) AS k
        FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL)) WHERE k = 1""",
    "hist_30min": """SELECT (floor((hour(ts) * 60 + minute(ts)) / 30) * 30)::BIGINT AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "weekday_dense": """SELECT d::INT AS weekday, count(event_id) AS n FROM range(5) r(d) LEFT JOIN events
        ON isodow(ts) - 1 = d AND event_type = 'error' GROUP BY d""",
    "trend_day_or_month": """WITH s AS (SELECT max(o_orderdate)::DATE - min(o_orderdate)::DATE > 90 AS long FROM orders)
        SELECT CASE WHEN long THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period,
        count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM orders, s GROUP BY 1""",
    "period_delta": """WITH e AS (SELECT event_type, max(ts::DATE) OVER () - ts::DATE AS age FROM events)
        SELECT event_type, count(*) FILTER (WHERE age < 30) AS now, count(*) FILTER (WHERE age >= 30) AS before,
        count(*) FILTER (WHERE age < 30) - count(*) FILTER (WHERE age >= 30) AS delta FROM e WHERE age < 60 GROUP BY 1""",
    "topk_issue": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "weighted_average": """SELECT round(sum(x * n) / sum(n), 6) AS weighted, count(*) AS brands FROM (SELECT p_brand, avg(l_discount) AS x,
        count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
}
