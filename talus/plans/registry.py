"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import aggregates, evidence, joins, lookups, matching, measures, patterns, retrieval, rules, search, shares, snapshots, upkeep, windows


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, averages and counts of line items by return flag and status: one scan, one small shuffle."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        items.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


MODULES = (joins, aggregates, windows, lookups, measures, search, retrieval, patterns, rules, matching, shares, snapshots, evidence, upkeep)
QUERIES = {"pricing_summary": pricing_summary} | {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()} | {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
"""
}
