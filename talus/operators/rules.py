"""Rules as data: requirements are rows, facts are rows of entity, attribute and value, and nothing of a rule is in code.

A requirement has a scope (which entities it is asked of), a field, an operator and a value. Facts and values are text;
the operator says how both are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import word_tokens
from talus.sources import table


def has_words(fact: Column, value: Column) -> Column:
    """All words of the value are among those of the fact; a value without words asks for nothing that can be met."""
    wanted = word_tokens(value, 1)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, word_tokens(fact, 1))) == 0)


#: How an operator tests a fact against a value. A null result means that one of them cannot be read as it asks.
OPERATORS = {
    ">=": lambda fact, value: fact.try_cast("double") >= value.try_cast("double"),
    "<=": lambda fact, value: fact.try_cast("double") <= value.try_cast("double"),
    "=": lambda fact, value: F.lower(F.trim(fact)) == F.lower(F.trim(value)),
    "<>": lambda fact, value: F.lower(F.trim(fact)) != F.lower(F.trim(value)),
    "in": lambda fact, value: F.array_contains(F.split(F.lower(value), r"\s*,\s*"), F.lower(F.trim(fact))),
    "from": lambda fact, value: fact.try_cast("timestamp") >= value.try_cast("timestamp"),
    "before": lambda fact, value: fact.try_cast("timestamp") < value.try_cast("timestamp"),
    "words": has_words,
}


def facts(rows: DataFrame, entity: str, *fields: str) -> DataFrame:
    """entity, field, fact: one row for each field that is not null."""
    text = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("fact")) for c in fields]
    return rows.select(F.col(entity).alias("entity"), F.explode(F.array(*text)).alias("f")).select("entity", "f.*").where("fact IS NOT NULL")


def evaluated(entities: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """entity, scope, asked, passed, failed: requirements that do not hold, with reasons, by rule.

    ``entities`` has entity and scope, ``rules`` rule, scope, field, operator and value, ``known`` entity, field and fact. A
    field may have several facts: one that meets the requirement is enough. Reasons are missing (no fact), unreadable (no fact
    can be read as the operator asks), unmet, and unknown operator. An entity whose scope has no rules passes.

    Facts are tested before they are brought together, and what is left of a rule is one of four numbers, whose
    least is found by partial aggregates: an entity with very many facts is nobody's group.
    """
    held = {name: test(F.col("fact"), F.col("value")) for name, test in OPERATORS.items()}
    outcome = F.coalesce(*(F.when(F.col("operator") == name, F.when(test, 0).when(~test, 1).otherwise(2)) for name, test in held.items()))
    asked = entities.join(rules, "scope")
    met = asked.join(known, ["entity", "field"], "left").withColumn("outcome", F.when(~F.col("operator").isin(*OPERATORS), 4).when(F.col("fact").isNull(), 3).otherwise(outcome))
    by_rule = met.groupBy("entity", "scope", "rule", "field").agg(F.min("outcome").alias("outcome"))
    reason = F.get(F.array(*map(F.lit, ("", "unmet", "unreadable", "missing", "unknown operator"))), F.col("outcome"))
    failure = F.when(F.col("outcome") > 0, F.struct("rule", "field", reason.alias("reason")))
    found = by_rule.groupBy("entity", "scope").agg(F.count("*").alias("asked"), F.array_sort(F.collect_list(failure)).alias("failed"))
    every = entities.select("entity", "scope").join(found, ["entity", "scope"], "left")
    none = F.array().cast("array<struct<rule:bigint,field:string,reason:string>>")
    failed = F.coalesce(F.col("failed").cast("array<struct<rule:bigint,field:string,reason:string>>"), none)
    return every.select("entity", "scope", F.coalesce("asked", F.lit(0)).cast("long").alias("asked"), (F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def customer_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that customers are held to, made from the tables: scope is the market segment.

    Every segment asks for its mean balance, for a last order not before its median customer's, and for a nation of the
    region that most of its customers are of; some rules name fields that customers lack, or values that are no numbers.
    """
    customers = table(spark, d, "customer")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_region = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("n"))
    region = by_region.groupBy("c_mktsegment").agg(F.max_by("r_name", F.struct("n", "r_name")).alias("r_name"))
    lists = nations.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))
    base = customers.groupBy("c_mktsegment").agg(F.floor(F.avg("c_acctbal")).cast("long").alias("mean"), F.count("*").alias("n"))
    base = base.join(region.join(lists, "r_name"), "c_mktsegment")
    rule = lambda k, field, op, value: F.struct(F.lit(k).cast("long").alias("rule"), F.lit(field).alias("field"), F.lit(op).alias("operator"), value.cast("string").alias("value"))
    rules = F.array(
        rule(1, "balance", ">=", F.col("mean")),
        rule(2, "nation", "in", F.upper("nations")),
        rule(3, "last_order", "from", F.lit("1998-06-01")),
        rule(4, "priority", "words", F.lit("Urgent")),
        rule(5, "orders", "<=", F.when(F.col("n") % 2 == 0, "a dozen").otherwise("12")),
        rule(6, "status", "<>", F.lit("p ")),
        rule(7, "referee", "=", F.lit("any")),
        rule(8, "orders", "about", F.lit("3")),
    )
    # two of the rules hold for a part of the segments only
    kept = base.select(F.col("c_mktsegment").alias("scope"), F.explode(rules).alias("r")).select("scope", "r.*")
    return kept.where("NOT (rule = 7 AND scope < 'F') AND NOT (rule = 8 AND scope < 'M')")


def rules_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers against the rules of their segment."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    last = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))
    named = customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = facts(named.withColumns({"balance": F.col("c_acctbal"), "nation": F.col("n_name")}), "c_custkey", "balance", "nation")
    known = known.unionByName(facts(last, "o_custkey", "orders", "last_order"))
    many = orders.select("o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).distinct()
    known = known.unionByName(facts(many, "o_custkey", "priority", "status"))
    entities = customers.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("scope"))
    found = evaluated(entities, customer_rules(spark, d), known)
    told = F.array_join(F.transform("failed", lambda x: F.concat_ws(":", x["rule"].cast("string"), x["field"], x["reason"])), ";")
    return found.select(F.col("entity").alias("c_custkey"), "scope", "asked", "passed", told.alias("failed"))


QUERIES = {"rules_from_rows": rules_from_rows}
SQL = {
    "rules_from_rows": r"""
WITH nations AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
by_region AS (
  SELECT c_mktsegment, r_name, count(*) AS n FROM customer JOIN nations ON c_nationkey = n_nationkey GROUP BY ALL),
regions AS (SELECT c_mktsegment, arg_max(r_name, {'n': n, 'r': r_name}) AS r_name FROM by_region GROUP BY c_mktsegment),
lists AS (SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nations GROUP BY r_name),
base AS (
  SELECT c.c_mktsegment AS scope, floor(avg(c_acctbal))::BIGINT AS mean, count(*) AS n, any_value(nations) AS nations
  FROM customer c JOIN regions USING (c_mktsegment) JOIN lists USING (r_name) GROUP BY c.c_mktsegment),
rules AS (
  SELECT 1 AS rule, scope, 'balance' AS field, '>=' AS op, mean::VARCHAR AS value FROM base
  UNION ALL SELECT 2, scope, 'nation', 'in', upper(nations) FROM base
  UNION ALL SELECT 3, scope, 'last_order', 'from', '1998-06-01' FROM base
  UNION ALL SELECT 4, scope, 'priority', 'words', 'Urgent' FROM base
  UNION ALL SELECT 5, scope, 'orders', '<=', CASE WHEN n % 2 = 0 THEN 'a dozen' ELSE '12' END FROM base
  UNION ALL SELECT 6, scope, 'status', '<>', 'p ' FROM base
  UNION ALL SELECT 7, scope, 'referee', '=', 'any' FROM base WHERE scope >= 'F'
  UNION ALL SELECT 8, scope, 'orders', 'about', '3' FROM base WHERE scope >= 'M'),
facts AS (
  SELECT c_custkey AS entity, 'balance' AS field, c_acctbal::VARCHAR AS fact FROM customer
  UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT o_custkey, 'orders', count(*)::VARCHAR FROM orders GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'last_order', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders GROUP BY o_custkey
  UNION ALL SELECT DISTINCT o_custkey, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders),
met AS (
  SELECT c.c_custkey, c.c_mktsegment AS scope, r.rule, r.field, r.op, f.fact,
    CASE r.op WHEN '>=' THEN try_cast(f.fact AS DOUBLE) >= try_cast(r.value AS DOUBLE)
      WHEN '<=' THEN try_cast(f.fact AS DOUBLE) <= try_cast(r.value AS DOUBLE)
      WHEN '=' THEN lower(trim(f.fact)) = lower(trim(r.value)) WHEN '<>' THEN lower(trim(f.fact)) <> lower(trim(r.value))
      WHEN 'in' THEN list_contains(list_transform(string_split(lower(r.value), ','), lambda x: trim(x)), lower(trim(f.fact)))
      WHEN 'from' THEN try_cast(f.fact AS TIMESTAMP) >= try_cast(r.value AS TIMESTAMP)
      WHEN 'words' THEN list_has_all(regexp_extract_all(lower(f.fact), '[a-z0-9]+'), regexp_extract_all(lower(r.value), '[a-z0-9]+')) END AS held
  FROM customer c JOIN rules r ON r.scope = c.c_mktsegment LEFT JOIN facts f ON f.entity = c.c_custkey AND f.field = r.field),
by_rule AS (
  SELECT c_custkey, scope, rule, field, min(CASE WHEN op = 'about' THEN 4 WHEN fact IS NULL THEN 3 WHEN held THEN 0 WHEN NOT held THEN 1 ELSE 2 END) AS outcome
  FROM met GROUP BY ALL)
SELECT c_custkey, scope, count(*) AS asked, max(outcome) = 0 AS passed,
  coalesce(string_agg(rule || ':' || field || ':' || ['', 'unmet', 'unreadable', 'missing', 'unknown operator'][outcome + 1], ';' ORDER BY rule)
    FILTER (WHERE outcome > 0), '') AS failed
FROM by_rule GROUP BY c_custkey, scope
"""
}
