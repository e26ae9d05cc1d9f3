"""Differences of consecutive snapshots, and the life of every key over all of them, in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources import table


def lives(rows: DataFrame, key: str, stage: str, value: str) -> DataFrame:
    """key, life: its (stage, value) in order of stage. Stages are whole numbers; of several rows of a key and stage the one
    with the largest value holds. A life has as many entries as there are stages, at most."""
    one = rows.groupBy(F.col(key).alias("key"), F.col(stage).alias("stage")).agg(F.max(value).alias("value"))
    return one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stage", "value"))).alias("life"))


def differences(life: DataFrame, first: int, last: int) -> DataFrame:
    """key, stage, kind, before, after: added, removed or changed from the stage before, from ``first`` + 1 to ``last``.

    A null value is a value. Only what differs is a row: a key makes at most two for each of its entries.
    """

    def diff(stage: Column, kind: str, before: Column, after: Column) -> Column:
        return F.struct(stage.alias("stage"), F.lit(kind).alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"))

    none = F.lit(None)

    def at(x: Column, i: Column) -> Column:
        """What an entry makes of the stages from it to the next one."""
        prev = F.get(F.col("life"), i - 1)
        follows = (i > 0) & (prev["stage"] == x["stage"] - 1)
        own = F.when(follows & ~x["value"].eqNullSafe(prev["value"]), diff(x["stage"], "changed", prev["value"], x["value"]))
        own = own.when(~follows & (x["stage"] > first), diff(x["stage"], "added", none, x["value"]))
        later = F.get(F.col("life"), i + 1)
        ends = (x["stage"] < last) & (later.isNull() | (later["stage"] > x["stage"] + 1))
        return F.array(own, F.when(ends, diff(x["stage"] + 1, "removed", x["value"], none)))

    found = life.select("key", F.explode(F.flatten(F.transform("life", at))).alias("d"))
    return found.where("d IS NOT NULL").select("key", "d.*")


def lifecycle(life: DataFrame) -> DataFrame:
    """key, first, last, stages (present), returns (times it came back after it was gone), changes (between consecutive stages)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("life") - 1), lambda i: F.struct(F.get("life", i - 1).alias("a"), F.get("life", i).alias("b")))
    pairs = F.when(F.size("life") > 1, pairs)
    count = lambda test: F.coalesce(F.size(F.filter(pairs, test)), F.lit(0)).cast("long")
    return life.select(
        "key",
        F.get("life", F.lit(0))["stage"].alias("first"),
        F.element_at("life", -1)["stage"].alias("last"),
        F.size("life").cast("long").alias("stages"),
        count(lambda p: p["b"]["stage"] > p["a"]["stage"] + 1).alias("returns"),
        count(lambda p: (p["b"]["stage"] == p["a"]["stage"] + 1) & ~p["a"]["value"].eqNullSafe(p["b"]["value"])).alias("changes"),
    )


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """A customer's state in a quarter: the status of its last order."""
    day = F.col("o_orderdate")
    orders = table(spark, d, "orders").select("o_custkey", (F.year(day) * 4 + F.quarter(day)).cast("long").alias("stage"), "o_orderdate", "o_orderkey", "o_orderstatus")
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status")
    return lives(orders.groupBy("o_custkey", "stage").agg(last), "o_custkey", "stage", "status")


def snapshot_differences(spark: SparkSession, d: str) -> DataFrame:
    """Customers added, removed and changed from quarter to quarter, and the changes by value."""
    found = differences(_quarters(spark, d), 1995 * 4 + 1, 1998 * 4 + 2)
    return found.groupBy("stage", "kind", "before", "after").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def snapshot_lives(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle(_quarters(spark, d)).withColumnRenamed("key", "c_custkey")


_QUARTERS = """
states AS (
  SELECT o_custkey AS key, year(o_orderdate) * 4 + quarter(o_orderdate) AS stage,
    arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS value FROM orders GROUP BY ALL),
lined AS (
  SELECT *, lag(stage) OVER w AS prev, lag(value) OVER w AS prev_value, lead(stage) OVER w AS next FROM states
  WINDOW w AS (PARTITION BY key ORDER BY stage))
"""
QUERIES = {"snapshot_differences": snapshot_differences, "snapshot_lives": snapshot_lives}
SQL = {
    "snapshot_differences": f"""
WITH {_QUARTERS},
found AS (
  SELECT key, stage, 'changed' AS kind, prev_value AS before, value AS after FROM lined WHERE prev = stage - 1 AND value <> prev_value
  UNION ALL SELECT key, stage, 'added', NULL, value FROM lined WHERE coalesce(prev, 0) <> stage - 1 AND stage > 7981
  UNION ALL SELECT key, stage + 1, 'removed', value, NULL FROM lined WHERE coalesce(next, 99999) <> stage + 1 AND stage < 7994)
SELECT stage, kind, before, after, count(*) AS n, min(key) AS first_key FROM found GROUP BY ALL
""",
    "snapshot_lives": f"""
WITH {_QUARTERS}
SELECT key AS c_custkey, min(stage) AS first, max(stage) AS last, count(*) AS stages,
  count(*) FILTER (WHERE prev < stage - 1) AS returns, count(*) FILTER (WHERE prev = stage - 1 AND value <> prev_value) AS changes
FROM lined GROUP BY key
""",
}
