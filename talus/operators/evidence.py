"""Nested references brought into rows, and measures of found against wanted sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.retrieval import build, search, tokens
from talus.scratch import written
from talus.sources import table


def referenced(owners: DataFrame, owner: str, sections: list[str], known: DataFrame) -> DataFrame:
    """owner, ref, section, at: what the array columns ``sections`` (of longs) refer to, once per owner and reference.

    The first reference wins: by the order of sections, then by its place (from 0). References that are not in ``known``
    (a column ref) are dropped; null and empty arrays and null elements refer to nothing.
    """
    exploded = [owners.select(F.col(owner).alias("owner"), F.posexplode(c).alias("at", "ref")).withColumn("order", F.lit(k)) for k, c in enumerate(sections)]
    rows = reduce(DataFrame.unionByName, exploded).where("ref IS NOT NULL")
    first = rows.groupBy("owner", "ref").agg(F.min(F.struct("order", "at")).alias("f"))
    first = first.join(known.select("ref").distinct(), "ref", "left_semi")
    return first.select("owner", "ref", F.get(F.array(*map(F.lit, sections)), F.col("f.order")).alias("section"), F.col("f.at").cast("long").alias("at"))


def with_stored(rows: DataFrame, stored: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """``rows``, and for keys without any the entries of ``stored``'s JSON array (its ``column``); text that is no such array has none.

    ``schema`` gives the fields of an entry, which are the columns of ``rows`` besides the key; ``source`` says where a row is from.
    """
    missing = stored.join(rows.select(key).distinct(), key, "left_anti")
    entries = missing.select(key, F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("e")).where("e IS NOT NULL")
    return rows.withColumn("source", F.lit("rows")).unionByName(entries.select(key, "e.*").withColumn("source", F.lit("stored")))


def order_references(spark: SparkSession, d: str) -> DataFrame:
    """Parts that an order refers to: by returned, then discounted, then all lines; parts over size 40 are unknown. Customers
    without any order have what is stored with them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount")
    entry = F.struct("l_linenumber", "l_partkey")
    parts = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, entry))), lambda x: x["l_partkey"])
    # an order has a few lines
    nested = lines.groupBy("l_orderkey").agg(
        parts(F.col("l_returnflag") == "R").alias("returned"), parts(F.col("l_discount") > 0.05).alias("discounted"), parts(F.lit(True)).alias("listed")
    )
    known = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("ref"))
    found = referenced(nested, "l_orderkey", ["returned", "discounted", "listed"], known)
    orders = table(spark, d, "orders")
    rows = found.join(orders, F.col("owner") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("custkey"), "section").agg(F.count_distinct("ref").alias("refs"), F.max("at").alias("deepest"))
    customers = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("no array")).otherwise(F.format_string('[{"section":"%s","refs":%d,"deepest":null},null]', "c_mktsegment", F.col("c_nationkey")))
    stored = customers.select(F.col("c_custkey").alias("custkey"), text.alias("stored"))
    return with_stored(rows, stored, "custkey", "stored", "section string, refs long, deepest long")


def set_measures(found: DataFrame, wanted: DataFrame, key: str, item: str) -> DataFrame:
    """key, found, wanted, hits, precision, recall, f1 by key, then ``micro`` (sums over keys) and ``macro`` (means over keys, whole numbers summed).

    Rows of found and wanted are sets; a ratio of nothing is 0. A key of one side alone counts. Sets meet by key and item, so a
    hot key is spread.
    """
    one = lambda df, name: df.select(F.col(key).cast("string").alias("key"), F.col(item).alias("item")).distinct().withColumn(name, F.lit(1))
    both = one(found, "f").join(one(wanted, "w"), ["key", "item"], "full")
    by_key = both.groupBy("key").agg(F.count("f").alias("found"), F.count("w").alias("wanted"), F.count(F.expr("f + w")).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def measured(df: DataFrame) -> DataFrame:
        p, r = ratio(F.col("hits"), F.col("found")), ratio(F.col("hits"), F.col("wanted"))
        f1 = ratio(2 * F.col("hits"), F.col("found") + F.col("wanted"))
        return df.select("key", "found", "wanted", "hits", p.alias("precision"), r.alias("recall"), f1.alias("f1"))

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "wanted", "hits")]
    keyed = measured(by_key)
    micro = measured(by_key.agg(*sums).withColumn("key", F.lit("micro")))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    macro = keyed.agg(*sums, *means).select(F.lit("macro").alias("key"), "found", "wanted", "hits", "precision", "recall", "f1")
    return keyed.unionByName(micro).unionByName(macro)


def urgent_against_finished(spark: SparkSession, d: str) -> DataFrame:
    """How well urgent orders foretell finished ones, by nation: sets of customers."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found, wanted = orders.where("o_orderpriority = '1-URGENT' AND c_nationkey <> 3"), orders.where("o_orderstatus = 'F' AND c_nationkey <> 5")
    got = set_measures(found, wanted, "c_nationkey", "c_custkey")
    return got.select("key", "found", "wanted", "hits", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def covered(items: DataFrame, sources: DataFrame) -> DataFrame:
    """item, tokens, covered, sources, needed, complete: how far several sources together cover the tokens of an item.

    ``items`` and ``sources`` have item and token, sources source as well. ``needed`` counts sources with a token that no other
    has; an item is ``complete`` if all its tokens are covered.
    """
    wanted = items.select("item", "token").distinct()
    own = sources.select("item", "source", "token").distinct().join(wanted, ["item", "token"], "left_semi")
    by_token = own.groupBy("item", "token").agg(F.count("*").alias("n"), F.min("source").alias("only"))
    reached = by_token.groupBy("item").agg(F.count("*").alias("covered"), F.count_distinct(F.when(F.col("n") == 1, F.col("only"))).alias("needed"))
    giving = own.groupBy("item").agg(F.count_distinct("source").alias("sources"))
    found = wanted.groupBy("item").agg(F.count("*").alias("tokens")).join(reached, "item", "left").join(giving, "item", "left").na.fill(0)
    return found.select("item", "tokens", "covered", "sources", "needed", (F.col("covered") == F.col("tokens")).alias("complete"))


def items_covered(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of benchmark items that their three best documents cover together."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    index = build(docs)
    best = written(search(index, items, 3, query_id="item_id").select(F.col("query").alias("item"), "doc"), "best")  # its size decides how it is joined
    sources = best.join(index.rows, "doc").select("item", F.col("doc").alias("source"), F.explode(F.array_distinct("words")).alias("token"))
    return covered(items.select(F.col("item_id").alias("item"), F.explode(tokens(F.col("text"))).alias("token")), sources)


def _items_sql() -> str:
    from talus.operators.retrieval import SQL as RETRIEVAL

    ranked = RETRIEVAL["lexical_topk"].split("SELECT query AS item_id")[0]
    return f"""{ranked},
wanted AS (SELECT DISTINCT query AS item, token FROM asked),
own AS (
  SELECT DISTINCT r.query AS item, r.doc AS source, c.token FROM ranked r JOIN counted c USING (doc)
  JOIN wanted w ON w.item = r.query AND w.token = c.token WHERE rank <= 3),
by_token AS (SELECT item, token, count(*) AS n, min(source) AS only_one FROM own GROUP BY ALL)
SELECT w.item, count(*) AS tokens, count(n) AS covered, coalesce(any_value(s.sources), 0) AS sources,
  count(DISTINCT CASE WHEN n = 1 THEN only_one END) AS needed, count(*) = count(n) AS complete
FROM wanted w LEFT JOIN by_token t ON t.item = w.item AND t.token = w.token
LEFT JOIN (SELECT item, count(DISTINCT source) AS sources FROM own GROUP BY item) s ON s.item = w.item GROUP BY w.item
"""


QUERIES = {"order_references": order_references, "urgent_against_finished": urgent_against_finished, "items_covered": items_covered}
SQL = {
    "order_references": """
WITH placed AS (
  SELECT l_orderkey, l_partkey, l_linenumber, k, name, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber, l_partkey) - 1 AS place
  FROM lineitem JOIN (VALUES (0, 'returned'), (1, 'discounted'), (2, 'listed')) AS s(k, name)
    ON k = 2 OR k = 0 AND l_returnflag = 'R' OR k = 1 AND l_discount > 0.05),
firsts AS (
  SELECT l_orderkey, l_partkey, min({'k': k, 'place': place, 'name': name}) AS f FROM placed
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY ALL),
found AS (
  SELECT o_custkey AS custkey, f.name AS section, count(DISTINCT l_partkey) AS refs, max(f.place) AS deepest
  FROM firsts JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT custkey, section, refs, deepest, 'rows' AS source FROM found
UNION ALL
SELECT c_custkey, c_mktsegment, c_nationkey::BIGINT, NULL, 'stored' FROM customer
WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT custkey FROM found)
""",
    "urgent_against_finished": """
WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT DISTINCT c_nationkey::VARCHAR AS key, c_custkey FROM o WHERE o_orderpriority = '1-URGENT' AND c_nationkey <> 3),
w AS (SELECT DISTINCT c_nationkey::VARCHAR AS key, c_custkey FROM o WHERE o_orderstatus = 'F' AND c_nationkey <> 5),
sums AS (
  SELECT coalesce(f.key, w.key) AS key, count(f.key) AS found, count(w.key) AS wanted, count(f.key || w.key) AS hits
  FROM f FULL JOIN w ON f.key = w.key AND f.c_custkey = w.c_custkey GROUP BY 1),
every AS (
  SELECT *, false AS mean FROM sums
  UNION ALL SELECT 'micro', sum(found), sum(wanted), sum(hits), false FROM sums),
measured AS (
  SELECT key, found::BIGINT AS found, wanted::BIGINT AS wanted, hits::BIGINT AS hits, CASE WHEN found > 0 THEN hits / found ELSE 0 END AS p,
    CASE WHEN wanted > 0 THEN hits / wanted ELSE 0 END AS r, CASE WHEN found + wanted > 0 THEN 2 * hits / (found + wanted) ELSE 0 END AS f1 FROM every)
SELECT key, found, wanted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM measured
UNION ALL
SELECT 'macro', sum(found)::BIGINT, sum(wanted)::BIGINT, sum(hits)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6)
FROM measured WHERE key <> 'micro'
""",
    "items_covered": _items_sql(),
}
