"""Tables written to the folder that the cluster shares: lineage is cut there, and a table that is read twice is the same twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of its own for a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='talus-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is written once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, group: str, order: list[Column], *values: str) -> DataFrame:
    """Add for each of ``values`` its sum over the rows before a row within ``group`` (before_...) and over the group (total_...).

    Rows are ranged by group and order, so a group of any size lies in many tasks; the sums of the ranges are a window over
    one row for each range and group. ``order`` is made total by a number that is written with the rows, so that equal rows are
    spread, too.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(df.withColumn("_tie", F.monotonically_increasing_id()), "numbered")
    ranged = numbered.repartitionByRange(n, F.col(group), *order, F.col("_tie")).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    parts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(*(F.sum(v).alias(v) for v in values))
    earlier, whole = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_group")
    sums = [F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values]
    parts = parts.select("_group", "_p", *sums, *(F.sum(v).over(whole).alias(f"total_{v}") for v in values))
    within = Window.partitionBy("_part", group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(parts, ranged[group].eqNullSafe(parts["_group"]) & (ranged["_part"] == parts["_p"]))
    joined = joined.withColumns({f"before_{v}": F.col(f"_before_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return joined.drop("_tie", "_part", "_group", "_p", *(f"_before_{v}" for v in values))
