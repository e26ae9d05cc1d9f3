"""Prefix sums over ranges when half of all rows are equal."""

from pyspark.sql import functions as F

from talus.llm.common import running_sum


def test_equal_rows_are_spread(spark):
    rows = spark.range(0, 20_000, 1, 5).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"), F.lit(1).alias("one"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = running_sum(rows, ["k"], "one", "n").cache()
        assert sorted(r.n for r in found.select("n").collect()) == list(range(1, 20_001))
        order = [r.k for r in found.orderBy("n").select("k").collect()]
        assert order == sorted(order)
        sizes = [r["count"] for r in rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "k", "_tie").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * 20_000 / 8
        found.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
