"""Operator 13: drop the lines that many documents share, and put the others back together by position.

Lines are exploded with their position, normalised and hashed; documents are counted per hash, and the hashes at or over
the threshold meet the lines again. Only positions of dropped lines travel back to the documents.

Defined cases: a null or empty text is one empty line; a line without a character besides white space has an empty key,
is never counted and stays; the closing line break gives a last empty line; a document counts once for a line however
often it has it; rows that repeat a doc_id are one document, rows with a null one are a document for each text; an empty
table gives an empty table; there are no ties, as all lines of a key go or stay; columns other than doc_id and text are
not read, whatever their names. Two lines are held equal where 128 bits of hash are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import materialize

LEAST_DOCS, LEAST_CHARS = 10, 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, UPPER.lower())


def hashes(x: Column, name: str) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(x).alias(f"{name}1"), F.xxhash64(F.lit(name), x).alias(f"{name}2")]


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """The hashes (_k1, _k2) of lines in at least ``least_docs`` documents.

    Documents and hashes meet by both first, so that a line of a third of all documents is counted in many tasks.
    """
    pairs = lines.select("_k1", "_k2", "doc_id", F.when(F.col("doc_id").isNull(), F.col("_t1")).alias("_no_id")).distinct()
    return pairs.groupBy("_k1", "_k2").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")


def drop_common_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, text (what stays), n_lines (before), n_dropped."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *hashes(text, "_t"), F.split(text, "\n", -1).alias("_lines"))
    lines = rows.select("doc_id", "_t1", "_t2", F.posexplode("_lines").alias("_at", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).drop("_line")
    lines = lines.where(F.char_length("_key") >= least_chars).select("doc_id", "_t1", "_t2", "_at", *hashes(F.col("_key"), "_k"))
    # written, so that the lines join a table by plain exchanges, of which Spark splits that of a hot line
    found = lines.join(materialize(common_lines(lines, least_docs), "common-lines"), ["_k1", "_k2"])
    dropped = found.groupBy("doc_id", "_t1", "_t2").agg(F.collect_set("_at").alias("_gone"))
    # written, so that Spark knows the size: documents are exchanged only where this is too large to broadcast
    dropped = materialize(dropped.toDF("_id", "_d1", "_d2", "_gone"), "dropped-lines")
    same = rows["doc_id"].eqNullSafe(dropped["_id"]) & (rows["_t1"] == dropped["_d1"]) & (rows["_t2"] == dropped["_d2"])
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    return rows.join(dropped, same, "left").select(
        "doc_id",
        F.array_join(F.transform(stay, lambda k: F.get("_lines", k)), "\n").alias("text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, i AS pos, s[i] AS line,
         translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, range(1, len(s) + 1) AS r(i)),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c ON lines.key = c.key GROUP BY doc_id
"""
