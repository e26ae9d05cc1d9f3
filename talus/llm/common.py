"""Shared helpers: the scratch folder that all executors see, written tables that cut lineage, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``; where that is unset, a local master gets a folder of its
    machine, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/talus-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the scratch folder, with the writer's ``options``, and read it back: later stages restart from the files, not from the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` from which nothing more will be read."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``columns`` (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    """The number of blocks that work is dealt out to: the session's setting, which follows the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, size: int, column: str = "text") -> int:
    """Blocks of about ``size`` bytes that the texts of ``docs`` make, at least one."""
    total = docs.agg(F.sum(F.octet_length(column) + 1)).first()[0]
    return max(1, -(-(total or 0) // size))


def running_sum(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to this one in the total order ``order`` (column names).

    Range partitions are written with their number; their sums give each its offset, and the rest is a window inside a
    partition. No task holds more than one range, however large a group of the leading column is: rows equal in the whole order are
    parted by a last number of their own, and which of them comes first is no matter.
    """
    spark = df.sparkSession
    df, order = df.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"]
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per range partition: small enough to broadcast at any size of the table
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(within))
        .drop("_part", "_before", "_tie")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(docs: DataFrame, keep: Sequence[str], describe: Callable, fields: dict[str, tuple[T.DataType, pa.DataType]], column: str = "text") -> DataFrame:
    """The ``keep`` columns as they are, and ``fields`` from ``describe(texts)``, which gives a list for each of them.

    Columns pass through as Arrow arrays, so nulls and large numbers stay exact. A kept column that bears the name of one of
    ``fields`` (whatever their case) gets underscores in front.
    """
    keep, named = list(dict.fromkeys(keep)), list(fields)
    for c in keep:
        named.append(free_name(named, c))
    named = named[len(fields) :]
    rows = docs.select(*dict.fromkeys([*keep, column]))
    schema = T.StructType([T.StructField(n, rows.schema[c].dataType) for n, c in zip(named, keep)] + [T.StructField(c, kind[0]) for c, kind in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = describe(batch.column(column).to_pylist())
            made = [pa.array(x, kind[1]) for x, kind in zip(found, fields.values())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *made], [*named, *fields])

    return rows.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keeps: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text ``keeps`` accepts, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keeps(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def gathered(rows: DataFrame, *by: str) -> DataFrame:
    """Equal ``by`` columns side by side in one task."""
    return rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)


def changes(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in ``by``; the first does."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = np.any([(x := rows[c].to_numpy())[1:] != x[:-1] for c in by], axis=0)
    return new


def in_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal ``by`` columns, from batches that are sorted by them, of bounded size each."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        cuts = np.flatnonzero(changes(batch, by)).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.iloc[lo:hi]
        held = batch.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held
