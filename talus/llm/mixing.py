"""Operator 9: mix sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document enters the queue of its source ``max_passes`` times, in a shuffled order that depends on its id and the
seed alone. An entry's virtual finish time is the words its source has queued up to its end, divided by the source's
target; all entries are sorted by it over all sources, and the sorted list is cut where the budget is used up.

Defined cases: a null or empty text has size 0 and is never counted; a null source is a source of its own, last in
order; an empty table gives an empty table; repeated rows are separate documents; columns other than doc_id, text and
source are read only where ``keep`` names them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import WORD, free_name, materialize, running_sum

WEIGHTS, SHARE, MAX_PASSES, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_passes=MAX_PASSES) -> DataFrame:
    """One row per source: _source, _rank, source_size, target, _start (words of the sources before it).

    Targets share ``share`` times all words by weight; those above ``max_passes`` times their source's size stop there
    and the excess goes to the others by weight, until none is above. This level is the largest, over the sources in
    order of cap by weight, of what is left divided by the weights that are left.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    level = Window.orderBy("_ratio", "_rank")
    before, rest, all_rows = (
        level.rowsBetween(Window.unboundedPreceding, -1),
        level.rowsBetween(Window.currentRow, Window.unboundedFollowing),
        Window.partitionBy(),
    )
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    return (
        sources.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * max_passes)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn(
            "_level",
            (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest),
        )
        .withColumn("_level", F.max("_level").over(all_rows))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("_source", "_rank", "source_size", "target", "_start", "_budget")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_passes=MAX_PASSES, seed=SEED, keep=()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the columns named in ``keep``."""
    names, keep = list(keep), [f"_kept{k}" for k in range(len(keep))]
    sized = docs.select(
        "doc_id",
        F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # as bytes, which sort as their hexadecimal text does
        F.unhex(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).alias("_u"),
        *(F.col(f"`{c}`").alias(k) for c, k in zip(names, keep)),
    )
    sized = materialize(sized, "sized")
    sources = materialize(source_targets(sized, weights, share, max_passes), "sources")
    # the sources' table is joined by Spark's choice: it is broadcast only while it is below the session's threshold
    queued = sized.join(sources, sized["_source"].eqNullSafe(sources["_source"])).drop("_source", "_start", "_budget")
    ordered = running_sum(queued, ["_rank", "_u", "doc_id", "size", *keep], "size", "_all")
    starts = sources.select(F.col("_rank").alias("_r"), "_start", "_budget")
    ordered = ordered.join(starts, F.col("_rank") == F.col("_r")).withColumn("_words", F.col("_all") - F.col("_start"))
    ordered = materialize(ordered.drop("_r", "_start", "_all"), "ordered")

    def key(n):
        """What an entry of pass ``n`` is sorted by."""
        return F.struct(
            ((F.col("source_size") * n + F.col("_words")) / F.col("target")).alias("f"),
            F.col("_rank").alias("r"),
            F.col("_u").alias("u"),
            F.col("doc_id").alias("d"),
            F.lit(n).alias("n"),
            F.col("size").alias("s"),
        )

    entries = ordered.where("size > 0").select(
        "_budget", F.explode(F.array(*(key(n) for n in range(max_passes)))).alias("e")
    )
    entries = entries.select("_budget", "e.*").withColumnRenamed("s", "_size")
    total = running_sum(entries, ["f", "r", "u", "d", "n", "_size"], "_size", "_total")
    cut = total.where("_total > _budget").agg(
        F.min(F.struct("f", "r", "u", "d", "n", F.col("_size").alias("s"))).alias("_cut")
    )
    # one row: the first entry that the budget does not reach
    taken = sum(
        F.when(F.col("_cut").isNull() | (key(n) < F.col("_cut")), F.col("size")).otherwise(0) for n in range(max_passes)
    )
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return ordered.crossJoin(F.broadcast(cut)).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), *(F.col(k).alias(c) for c, k in zip(names, keep))
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in the columns of ``docs`` (of any names).

    Equal rows are interchangeable, so they are joined back by all their columns' hash and repeated together.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, n = free_name(docs.columns, "_row"), free_name(docs.columns, "_n")
    keyed = docs.withColumn(row, F.xxhash64(*(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)))
    taken = mix(keyed.select("doc_id", "text", "source", F.col(row).alias("_hash")), keep=["_hash"], **params).where("taken > 0")
    times = taken.groupBy("doc_id", "_hash").agg(F.sum(F.expr("taken div size")).alias("_taken"))
    # names that docs does not have
    id_, hash_, times_ = (free_name(keyed.columns, c) for c in ("_mixed_id", "_mixed_row", "_mixed_times"))
    times = times.toDF(id_, hash_, times_)
    one = keyed.dropDuplicates(["doc_id", row])
    same = one["doc_id"].eqNullSafe(times[id_]) & (one[row] == times[hash_])
    return one.join(times, same).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times_).cast("int")))).select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS u FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS w, 2 * source_size AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM by_source),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, r, source_size, budget, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels),
queued AS (
  SELECT doc_id, size, u, r, source_size, target, budget,
         sum(size) OVER (PARTITION BY r ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS words
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT doc_id, size, u, r, budget, n, (source_size * n + words)::DOUBLE / target AS f
  FROM queued, (VALUES (0), (1)) AS p(n) WHERE size > 0),
summed AS (
  SELECT doc_id, size, budget,
         sum(size) OVER (ORDER BY f, r, u, doc_id, n, size ROWS UNBOUNDED PRECEDING) AS total FROM entries),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM summed WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""
