"""Upkeep of tables as queries, and twins of earlier queries with stricter rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus import streaming
from talus.sources import insert_missing, merge_patch, sync_children, table, upsert

AS_OF = "1998-06-30"


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def null_safe_anti(spark: SparkSession, d: str) -> DataFrame:
    """Documents for whose pair of language and source no shorter one exists: pairs are equal where both lack a part."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("l"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("s"))
    shortest = docs.groupBy(F.col("l").alias("l2"), F.col("s").alias("s2")).agg(F.min("n_chars").alias("least"))
    return docs.join(shortest, F.col("l").eqNullSafe(F.col("l2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("n_chars") > F.col("least")), "left_anti").select("doc_id", "l", "s")


def period_rates(spark: SparkSession, d: str) -> DataFrame:
    """Purchases for a hundred views and clicks, in the last fifteen days and in the fifteen before, to one decimal, and
    their difference; null where nothing was seen."""
    events = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    end = events.agg(F.max("day").alias("end"))  # one row
    rows = events.crossJoin(F.broadcast(end)).withColumn("age", F.datediff("end", "day")).where("age < 30")

    def rate(now: Column) -> Column:
        seen = F.count_if(now & F.col("event_type").isin("view", "click"))
        return F.when(seen > 0, F.floor(F.count_if(now & (F.col("event_type") == "purchase")) * 1000 / seen + 0.5) / 10)

    out = rows.groupBy((F.col("user_id") % 10).alias("team")).agg(rate(F.col("age") < 15).alias("now"), rate(F.col("age") >= 15).alias("before"))
    return out.withColumn("delta", F.round(F.col("now") - F.col("before"), 1))


def coalesced_if_valid(spark: SparkSession, d: str) -> DataFrame:
    """Months that a customer's orders cover, merged where they overlap or touch, where each has usable bounds; else what is stored.

    An order runs from its month to that of its last shipping, three months at most, and as long where it has not shipped; a
    customer one of whose orders ships before it is made keeps the sum of the stored months, one for each order.
    """
    month = lambda t: F.year(t) * 12 + F.month(t)
    shipped = table(spark, d, "lineitem").where("l_linenumber <> 6").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    spans = orders.select(F.col("o_custkey"), month("o_orderdate").alias("a"), F.least(month("last"), month("o_orderdate") + 3).alias("b"))
    usable = spans.groupBy("o_custkey").agg(F.bool_and(F.coalesce(F.col("b") >= F.col("a"), F.lit(False))).alias("valid"), F.count("*").alias("stored"))
    order = Window.partitionBy("o_custkey").orderBy("a", "b")
    good = spans.distinct().join(usable.where("valid").select("o_custkey"), "o_custkey")
    good = good.withColumn("far", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # a month counts where no earlier span has reached it
    merged = good.select("o_custkey", F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.col("far") + 1, "a")) + 1).alias("new"))
    months = merged.groupBy("o_custkey").agg(F.sum("new").alias("months"))
    return usable.join(months, "o_custkey", "left").select("o_custkey", "valid", F.coalesce("months", "stored").cast("long").alias("months"))


def upserted_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balances by customer after those of later orders: the latest by number wins."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("at"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("v"))
    return upsert(old, new, ["k"], "at")


def synced_parts(spark: SparkSession, d: str) -> DataFrame:
    """A brand's list of parts synced with another: matched ones take the new price, missing ones become inactive, new ones enter."""
    parts = table(spark, d, "part").withColumn("active", F.lit(True))
    old = parts.where("p_partkey % 3 <> 0").select("p_partkey", "p_retailprice", "p_size", "active")
    new = parts.where("p_partkey % 4 <> 0").select("p_partkey", (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return sync_children(old, new, "p_partkey")


def inserted_nations(spark: SparkSession, d: str) -> DataFrame:
    """Customers of known nations, and one made for each nation that has none in credit."""
    rich = table(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("who"))
    made = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.lit(-1).cast("long").alias("who"))
    return insert_missing(rich, made, ["nation"])


def patched_props(spark: SparkSession, d: str) -> DataFrame:
    """Nested properties of events after a merge patch, as JSON text."""
    old = F.format_string('{"k":%d,"in":{"a":%d,"b":1}}', (F.col("event_id") % 5).cast("long"), (F.col("user_id") % 3).cast("long"))
    new = F.when(F.col("event_id") % 4 == 0, F.lit('{"in":{"b":null,"c":{"d":2}}}')).when(F.col("event_id") % 4 == 1, F.lit('{"k":null,"in":[1]}')).when(F.col("event_id") % 4 == 2, F.lit("not json"))
    return table(spark, d, "events").select("event_id", merge_patch(old, new).alias("patched"))


def archived_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer, the last one current."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return streaming.archived(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "current")


def queue_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a queue at a date: pending ones older than a year go back to open without a price, and what is older than three
    years goes; failed ones of some codes are tried again."""
    orders = table(spark, d, "orders").where(F.col("o_orderdate") <= _as_of()).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    again = streaming.requeued(orders, (F.col("o_orderstatus") == "P") & streaming.stale("o_orderdate", _as_of(), 365 * 86400), "o_orderstatus", "O", ["o_totalprice"])
    kept = streaming.unexpired(again, "o_orderdate", _as_of(), 3 * 365)
    code = F.when(F.col("o_orderstatus") == "F", F.element_at(F.array(*map(F.lit, (408, 503, 404, 0))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    tried = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 3).cast("int") - 1)
    kept = streaming.with_retries(kept.withColumns({"code": code, "tries": tried}), "code", "tries", [0, 408], 1)
    return kept.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), "retry")


def half_queued_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders older than two months at a date of which no line has shipped by then."""
    orders = table(spark, d, "orders").where(F.col("o_orderdate") <= _as_of())
    jobs = table(spark, d, "lineitem").where(F.col("l_shipdate") <= _as_of()).select(F.col("l_orderkey").alias("o_orderkey"))
    return streaming.half_queued(orders, jobs, "o_orderkey", "o_orderdate", _as_of(), 60 * 86400).select("o_orderkey", "o_custkey")


def status_log(spark: SparkSession, d: str) -> DataFrame:
    """What the change of status from one order of a customer to the next means, counted."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    changes = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), before.alias("old_status"))
    found = streaming.derived_events(changes, "status", {"F": "finished", "O": "opened"})
    return found.groupBy("action", "old_status", "status").agg(F.count("*").alias("n"))


def working_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from Monday to Friday from an order to the first shipping after it, the first day not counted, without days of a list.

    Whole weeks have five; what is left is counted by weekday; free days are looked up by their range.
    """
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate")
    spans = lines.groupBy("o_orderkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.min(F.to_date("l_shipdate")).alias("b"))
    # Monday to Friday up to a day, from a Monday long ago
    upto = lambda day: (F.datediff(day, F.lit("1900-01-01")) + 1).alias("n")
    count = lambda day: F.floor(upto(day) / 7) * 5 + F.least(upto(day) % 7, F.lit(5))
    free = F.sequence(F.lit(1990), F.lit(2005))
    newyear = F.filter(F.transform(free, lambda y: F.make_date(y, F.lit(1), F.lit(1))), lambda x: (x > F.col("a")) & (x <= F.col("b")) & (F.weekday(x) < 5))
    return spans.select("o_orderkey", (count(F.col("b")) - count(F.col("a")) - F.size(newyear)).cast("long").alias("days"))


def names_in_forms(spark: SparkSession, d: str) -> DataFrame:
    """Title case, initials, and a leading list number taken off, of the parts' names."""
    mixed = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". "))).when(F.col("p_partkey") % 3 == 1, F.lit("b) ")).otherwise(F.lit("- ")), F.upper("p_name"))
    bare = F.trim(F.regexp_replace(mixed, r"^\s*(?:[0-9]+[.)]|[a-z][.)]|[-*])\s+", ""))
    initials = F.array_join(F.transform(F.split(bare, " "), lambda w: F.left(w, F.lit(1))), "")
    return table(spark, d, "part").select("p_partkey", F.initcap(bare).alias("title"), initials.alias("initials"))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects in order and no spaces, so that equal values have equal text; null where it is no JSON."""

    @F.pandas_udf("string")
    def one(texts: pd.Series) -> pd.Series:
        def form(x):
            try:
                return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return pd.Series([form(x) for x in texts], dtype=object)

    return one(text)


def canonical_nested_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of nested JSON, whatever the order in which its keys are written: two spellings of each nation."""
    one = F.format_string('{"name":"%s","in":{"region":%d,"key":%d},"tags":[1, 2]}', "n_name", "n_regionkey", "n_nationkey")
    other = F.format_string('{ "tags":[1,2], "in":{"key":%d, "region":%d}, "name":"%s"}', "n_nationkey", "n_regionkey", "n_name")
    return table(spark, d, "nation").select("n_nationkey", F.sha2(canonical_json(one), 256).alias("hash"), (F.sha2(canonical_json(one), 256) == F.sha2(canonical_json(other), 256)).alias("same"))


def sections_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents by the heading above them: a heading is a line of at most two words; those before the first have none.

    A line's heading is carried forward within its document.
    """
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    lines = lines.withColumn("heading", F.when((words >= 1) & (words <= 2), F.trim("line")))
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lines.withColumn("section", F.last("heading", ignorenulls=True).over(so_far)).where(F.col("heading").isNull() & (words > 0))
    return carried.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.min("at").cast("long").alias("first_line"))


def accounted(items: DataFrame, outcomes: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key, outcome: each item once, under the first of ``outcomes`` (name and table of keys, in order) that has it, else unaccounted."""
    found = items.select(key).distinct()
    for k, (_, rows) in enumerate(outcomes):
        found = found.join(rows.select(key).distinct().withColumn(f"_{k}", F.lit(True)), key, "left")
    named = F.coalesce(*(F.when(F.col(f"_{k}"), F.lit(name)) for k, (name, _) in enumerate(outcomes)), F.lit("unaccounted"))
    return found.select(key, named.alias("outcome"))


def accounted_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by what became of them, the first that holds: returned, shipped late, shipped, unaccounted."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    outcomes = [("returned", lines.where("l_returnflag = 'R'")), ("late", lines.where("l_linestatus = 'O'")), ("shipped", lines)]
    return accounted(table(spark, d, "orders"), outcomes, "o_orderkey").groupBy("outcome").agg(F.count("*").alias("orders"))


def rounded_robin(spark: SparkSession, d: str) -> DataFrame:
    """Whole weights of a nation's segments that sum to 100: at least 1 each, floors, and what is over or short dealt one at a
    time in order, the first ones first; no weight is taken below 1."""
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    whole, order = Window.partitionBy("c_nationkey"), Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    rows = counts.withColumn("base", F.greatest(F.lit(1), F.expr("n * 100 div sum(n) OVER (PARTITION BY c_nationkey)")))
    rows = rows.withColumn("short", 100 - F.sum("base").over(whole)).withColumn("k", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(whole))
    # floors leave less than one for each, so one turn is enough, unless the least weight of 1 has taken too much
    up = F.when((F.col("short") > 0) & (F.col("k") < F.col("short")), 1).otherwise(0)
    spare = F.sum(F.when(F.col("base") > 1, 1).otherwise(0)).over(order)
    down = F.when((F.col("short") < 0) & (F.col("base") > 1) & (spare <= -F.col("short")), -1).otherwise(0)
    return rows.select("c_nationkey", "c_mktsegment", "n", (F.col("base") + up + down).cast("long").alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        null_safe_anti, period_rates, coalesced_if_valid, upserted_balances, synced_parts, inserted_nations, patched_props, archived_orders,
        queue_upkeep, half_queued_orders, status_log, working_days, names_in_forms, canonical_nested_hash, sections_of_lines, accounted_orders, rounded_robin,
    )
}
SQL = {
    "null_safe_anti": """
WITH docs AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 <> 0 THEN lang END AS l, CASE WHEN doc_id % 5 <> 0 THEN source END AS s FROM documents)
SELECT doc_id, l, s FROM docs a WHERE NOT EXISTS (
  SELECT 1 FROM docs b WHERE b.l IS NOT DISTINCT FROM a.l AND b.s IS NOT DISTINCT FROM a.s AND b.n_chars < a.n_chars)
""",
    "period_rates": """
WITH e AS (SELECT user_id % 10 AS team, event_type AS t, max(ts::DATE) OVER () - ts::DATE AS age FROM events),
c AS (
  SELECT team, count(*) FILTER (WHERE t = 'purchase' AND age < 15) AS p1, count(*) FILTER (WHERE t IN ('view', 'click') AND age < 15) AS s1,
    count(*) FILTER (WHERE t = 'purchase' AND age >= 15) AS p2, count(*) FILTER (WHERE t IN ('view', 'click') AND age >= 15) AS s2
  FROM e WHERE age < 30 GROUP BY team),
r AS (
  SELECT team, CASE WHEN s1 > 0 THEN floor(p1 * 1000 / s1 + 0.5) / 10 END AS now, CASE WHEN s2 > 0 THEN floor(p2 * 1000 / s2 + 0.5) / 10 END AS before FROM c)
SELECT team, now, before, round(now - before, 1) AS delta FROM r
""",
    "coalesced_if_valid": """
WITH shipped AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber <> 6 GROUP BY 1),
spans AS (
  SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS a,
    CASE WHEN last IS NULL THEN year(o_orderdate) * 12 + month(o_orderdate) + 3
      ELSE least(year(last) * 12 + month(last), year(o_orderdate) * 12 + month(o_orderdate) + 3) END AS b
  FROM orders LEFT JOIN shipped ON o_orderkey = l_orderkey),
usable AS (SELECT o_custkey, bool_and(b >= a) AS valid, count(*) AS stored FROM spans GROUP BY 1),
months AS (SELECT o_custkey, count(DISTINCT x) AS months FROM (SELECT o_custkey, unnest(range(a, b + 1)) AS x FROM spans) GROUP BY 1)
SELECT o_custkey, valid, CASE WHEN valid THEN months ELSE stored END AS months FROM usable LEFT JOIN months USING (o_custkey)
""",
    "upserted_balances": """
SELECT c_custkey AS k, coalesce(max(o_orderkey), 0) AS at, coalesce(arg_max(o_totalprice, o_orderkey), any_value(c_acctbal)) AS v
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey
UNION ALL
SELECT o_custkey, max(o_orderkey), arg_max(o_totalprice, o_orderkey) FROM orders
WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
""",
    "synced_parts": """
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, p_partkey % 4 <> 0 AS active
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0
""",
    "inserted_nations": """
SELECT c_nationkey AS nation, c_custkey AS who FROM customer WHERE c_acctbal > 9800
UNION ALL SELECT n_nationkey, -1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)
""",
    "patched_props": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":' || event_id % 5 || ',"in":{"a":' || user_id % 3 || ',"c":{"d":2}}}'
  WHEN 1 THEN '{"in":[1]}' END AS patched FROM events
""",
    "archived_orders": """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders
""",
    "queue_upkeep": """
WITH hit AS (
  SELECT *, o_orderstatus = 'P' AND epoch(TIMESTAMP '1998-06-30') - epoch(o_orderdate) > 365 * 86400 AS again FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30')
SELECT o_orderkey, CASE WHEN again THEN 'O' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN again THEN NULL ELSE o_totalprice END AS price,
  o_orderstatus = 'F' AND [true, true, false, true][(o_orderkey % 4 + 1)::INT] AND o_orderkey % 3 < 2 AS retry
FROM hit WHERE o_orderdate >= TIMESTAMP '1998-06-30' - INTERVAL 1095 DAY
""",
    "half_queued_orders": """
SELECT o_orderkey, o_custkey FROM orders WHERE epoch(TIMESTAMP '1998-06-30') - epoch(o_orderdate) > 60 * 86400
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30')
""",
    "status_log": """
WITH c AS (SELECT o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_status FROM orders)
SELECT CASE status WHEN 'F' THEN 'finished' WHEN 'O' THEN 'opened' ELSE 'updated' END AS action, old_status, status, count(*) AS n
FROM c WHERE status IS DISTINCT FROM old_status GROUP BY ALL
""",
    "working_days": """
WITH spans AS (
  SELECT o_orderkey, o_orderdate::DATE AS a, min(l_shipdate::DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate > o_orderdate GROUP BY ALL)
SELECT o_orderkey, len(list_filter(range((a + 1)::TIMESTAMP, (b + 1)::TIMESTAMP, INTERVAL 1 DAY),
  lambda x: isodow(x) < 6 AND NOT (month(x) = 1 AND day(x) = 1)))::BIGINT AS days FROM spans
""",
    "names_in_forms": """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title,
  upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '')) AS initials FROM part
""",
    "canonical_nested_hash": """
SELECT n_nationkey, sha256('{"in":{"key":' || n_nationkey || ',"region":' || n_regionkey || '},"name":"' || n_name || '","tags":[1,2]}') AS hash, true AS same FROM nation
""",
    "sections_of_lines": r"""
WITH lines AS (SELECT doc_id, i - 1 AS pos, s[i] AS line, len(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d, range(1, len(s) + 1) AS r(i)),
carried AS (
  SELECT *, last_value(CASE WHEN words BETWEEN 1 AND 2 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section
  FROM lines)
SELECT doc_id, section, count(*) AS lines, min(pos) AS first_line FROM carried WHERE words > 2 GROUP BY ALL
""",
    "accounted_orders": """
SELECT outcome, count(*) AS orders FROM (
  SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_linestatus = 'O') THEN 'late'
    WHEN count(l_orderkey) > 0 THEN 'shipped' ELSE 'unaccounted' END AS outcome
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY outcome
""",
    "rounded_robin": """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
b AS (SELECT *, greatest(1, n * 100 // sum(n) OVER (PARTITION BY c_nationkey))::BIGINT AS base FROM c),
s AS (
  SELECT *, 100 - sum(base) OVER (PARTITION BY c_nationkey) AS short, row_number() OVER w AS k,
    sum((base > 1)::INT) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS UNBOUNDED PRECEDING) AS spare
  FROM b WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment))
SELECT c_nationkey, c_mktsegment, n, (base + CASE WHEN short > 0 AND k <= short THEN 1 WHEN short < 0 AND base > 1 AND spare <= -short THEN -1 ELSE 0 END)::BIGINT AS weight FROM s
""",
}
