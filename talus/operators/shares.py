"""Shares of a total under a cap, in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.scratch import prefix_sums, written
from talus.sources import table


def capped_shares(items: DataFrame, group: str, item: str, weight: str, total: int, cap: int) -> DataFrame:
    """group, item, weight, capped, share: whole shares of ``total`` in proportion to weight, none above the cap.

    What capped items leave goes to the others in proportion (water filling), until none is above; the cap of a group of few
    items is at least an even share, rounded up. Parts of a whole go to the largest remainders, ties by item. Weights
    are whole numbers; a null or negative one is 0, and where all are 0 items count alike.

    Heaviest first, the k-th item is capped if its share of what is left for it and the lighter ones is above the cap; that
    needs sums of the items before it alone, so no rounds. All arithmetic is exact.
    """
    whole = "decimal(38,0)"
    rows = items.select(F.col(group).alias("group"), F.col(item).alias("item"), F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long").alias("weight"), F.lit(1).alias("one"))
    nothing = rows.groupBy(F.col("group").alias("g")).agg((F.max("weight") == 0).alias("nothing"))
    rows = rows.join(nothing, F.expr("group <=> g")).withColumn("w", F.when(F.col("nothing"), 1).otherwise(F.col("weight")).cast("long"))
    rows = prefix_sums(rows.drop("g", "nothing"), "group", [F.desc("w"), F.asc("item")], "w", "one")
    rows = rows.withColumn("cap", F.greatest(F.lit(cap), F.ceil(F.lit(total) / F.col("total_one"))).cast("long"))
    left = (F.lit(total) - F.col("before_one") * F.col("cap")).cast(whole)
    rest = (F.col("total_w") - F.col("before_w")).cast(whole)
    rows = rows.withColumns({"left": left, "rest": rest}).withColumn("capped", (F.col("left") > 0) & (F.col("w").cast(whole) * F.col("left") > F.col("cap").cast(whole) * F.col("rest")))
    # the first item that is not capped sets the level of all after it
    level = rows.where(~F.col("capped")).groupBy(F.col("group").alias("g")).agg(F.min(F.struct("before_one", "left", "rest")).alias("level"))
    rows = written(rows.join(level, F.expr("group <=> g"), "left").drop("g"), "levels")
    over, under = F.col("w").cast(whole) * F.greatest(F.col("level.left"), F.lit(0)), F.col("level.rest")
    rows = rows.withColumn("floor", F.when(F.col("capped"), F.col("cap")).otherwise(F.when(under > 0, F.expr("cast(w AS decimal(38,0)) * greatest(level.left, 0) div level.rest")).otherwise(0)).cast("long"))
    rows = rows.withColumn("remainder", F.when(F.col("capped") | (under <= 0), 0).otherwise(over % under).cast(whole))
    rows = prefix_sums(rows.select("group", "item", "weight", "capped", "floor", "remainder", "one"), "group", [F.desc("remainder"), F.asc("item")], "floor", "one")
    share = F.col("floor") + F.when((F.col("before_one") < F.lit(total) - F.col("total_floor")) & (F.col("remainder") > 0), 1).otherwise(0)
    return rows.select("group", "item", "weight", "capped", share.cast("long").alias("share"))


def nation_shares(spark: SparkSession, d: str) -> DataFrame:
    """Basis points of each nation's customers by what they ordered, none above 5 % unless the nation has fewer than twenty."""
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    customers = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    # a few very large customers, so that the cap is reached
    cents = F.when(F.col("c_custkey") % 7 == 0, F.col("cents") * 20).otherwise(F.col("cents"))
    found = capped_shares(customers.withColumn("cents", cents), "c_nationkey", "c_custkey", "cents", 10_000, 500)
    return found.select(F.col("group").alias("nationkey"), F.col("item").alias("c_custkey"), F.col("weight").alias("cents"), "capped", "share")


QUERIES = {"nation_shares": nation_shares}
SQL = {
    "nation_shares": """
WITH spent AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY o_custkey),
rows_ AS (
  SELECT c_nationkey AS nationkey, c_custkey, coalesce(cents * CASE WHEN c_custkey % 7 = 0 THEN 20 ELSE 1 END, 0)::BIGINT AS cents
  FROM customer LEFT JOIN spent ON c_custkey = o_custkey),
weighed AS (SELECT *, CASE WHEN max(cents) OVER (PARTITION BY nationkey) = 0 THEN 1 ELSE cents END::HUGEINT AS w FROM rows_),
placed AS (
  SELECT *, row_number() OVER o - 1 AS k, count(*) OVER g AS n, sum(w) OVER g AS total,
    coalesce(sum(w) OVER (PARTITION BY nationkey ORDER BY w DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM weighed WINDOW o AS (PARTITION BY nationkey ORDER BY w DESC, c_custkey), g AS (PARTITION BY nationkey)),
limits AS (SELECT *, greatest(500, (10000 + n - 1) // n)::HUGEINT AS cap, total - before AS rest FROM placed),
marked AS (SELECT *, 10000 - k * cap AS remains, 10000 - k * cap > 0 AND w * (10000 - k * cap) > cap * rest AS capped FROM limits),
levels AS (
  SELECT nationkey, min({'k': k, 'remains': remains, 'rest': rest}) AS level FROM marked WHERE NOT capped GROUP BY nationkey),
floors AS (
  SELECT m.*, CASE WHEN capped THEN cap WHEN level.rest > 0 THEN w * greatest(level.remains, 0) // level.rest ELSE 0 END AS f,
    CASE WHEN capped OR level.rest <= 0 THEN 0 ELSE w * greatest(level.remains, 0) % level.rest END AS r
  FROM marked m LEFT JOIN levels l USING (nationkey))
SELECT nationkey, c_custkey, cents, capped, (f + CASE WHEN r > 0
  AND row_number() OVER (PARTITION BY nationkey ORDER BY r DESC, c_custkey) <= 10000 - sum(f) OVER (PARTITION BY nationkey) THEN 1 ELSE 0 END)::BIGINT AS share
FROM floors
"""
}
