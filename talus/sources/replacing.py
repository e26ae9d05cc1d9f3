"""Tables that are replaced as a whole: written beside the old one, then put in its place by renames.

A reader sees the old table or the new one. What fails midway leaves the old one, which the next call puts back if it
was already set aside.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote ``path`` has come to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def move(spark: SparkSession, path: str, to: str) -> bool:
    where, fs = _path(spark, path)
    return fs.rename(where, _path(spark, to)[0])


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Put back a table that was set aside by a call that did not end, and delete what it left."""
    path = path.rstrip("/")
    if exists(spark, f"{path}.old"):
        if whole(spark, path):
            delete(spark, f"{path}.old")
        else:
            delete(spark, path)
            move(spark, f"{path}.old", path)


def publish(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by ``df``, which may read it."""
    spark, path = df.sparkSession, path.rstrip("/")
    recovered(spark, path)
    made = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(made)
        if not whole(spark, made):
            raise RuntimeError(f"{made} is not whole")
    except Exception:
        delete(spark, made)
        raise
    if exists(spark, path):
        move(spark, path, f"{path}.old")
    if not move(spark, made, path):
        recovered(spark, path)
        raise RuntimeError(f"{path} could not be replaced")
    delete(spark, f"{path}.old")


def update_table(spark: SparkSession, path: str, where: Column, **values) -> int:
    """Set ``values`` (literals or columns) in the rows that ``where`` picks, and give their number: one scan, counted as it is written.

    A null condition picks nothing; values are cast to their columns' types.
    """
    recovered(spark, path)
    df = spark.read.parquet(path)
    hit = F.coalesce(where, F.lit(False))
    picked = [F.when(hit, v if isinstance(v := values[c], Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns]
    seen = Observation()
    publish(df.withColumn("_hit", hit).select(*picked, "_hit").observe(seen, F.count_if("_hit").alias("n")).drop("_hit"), path)
    return seen.get["n"]


def replace_children(parents: DataFrame, key: str, children: str, path: str) -> None:
    """In the table at ``path`` (key, position, child) put the elements of the array column ``children``, numbered from 0, in
    place of all rows of these keys; a null or empty array leaves its key without rows, and other keys stay as they are."""
    spark = parents.sparkSession
    recovered(spark, path)
    new = parents.select(key, F.posexplode(children).alias("position", "child"))
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        new = old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)
    publish(new, path)


def cached_version(make: Callable[[], DataFrame], folder: str, *versions: str, purge: bool = False) -> DataFrame:
    """A result kept under the hash of its versions: read if it is there and whole, else made, written beside and renamed.

    Of two who make the same version at once, the first to rename has it and the other reads that. With ``purge`` all
    other versions in ``folder`` are deleted once this one is there.
    """
    spark, folder = SparkSession.active(), folder.rstrip("/")
    name = hashlib.sha256("\x00".join(versions).encode()).hexdigest()
    path = f"{folder}/{name}"
    if not whole(spark, path):
        made = f"{folder}/.making-{uuid.uuid4().hex}"
        make().write.parquet(made)
        if exists(spark, path) and not whole(spark, path):
            delete(spark, path)  # half a folder of a writer that died
        if exists(spark, path) or not move(spark, made, path):
            delete(spark, made)
    if purge:
        where, fs = _path(spark, folder)
        for status in fs.listStatus(where):
            other = status.getPath()
            if other.getName() != name and not other.getName().startswith(".making-"):
                fs.delete(other, True)
    return spark.read.parquet(path)
