"""Joins of several tables, with ranges, parameters and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import jaccard, nearby_bins, word_tokens
from talus.sources import table


def nway_inner(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of finished orders by the customer's nation: three equalities in a row."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by_key = joined.groupBy("c_nationkey").agg(F.sum("price").alias("price"), F.count("*").alias("n_lines"))
    named = by_key.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", F.round("price", 1).alias("revenue"), "n_lines")


def left_made_inner(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a condition on their orders: an outer join whose filter drops unmatched rows is an inner one."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    joined = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))


def range_in_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of a user from the first signup on: the user's first signup is one row, so the range filters an equality join."""
    events = table(spark, d, "events")
    first = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("since"))
    clicks = events.where("event_type = 'click'").select("user_id", "ts")
    joined = clicks.join(first, "user_id").where("ts >= since")
    return joined.groupBy("user_id").agg(F.count("*").alias("n_clicks"))


def interval_semi(spark: SparkSession, d: str) -> DataFrame:
    """Purchases that follow a view of the same user within six hours. Users and six-hour bins meet, so a busy user is spread."""
    events, width = table(spark, d, "events"), 6 * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", at.alias("t"))
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("u"), at.alias("v"))
    buys = buys.withColumn("bin", nearby_bins(F.col("t"), width, -1, 0))
    views = views.withColumn("b", F.floor(F.col("v") / width))
    near = (F.col("user_id") == F.col("u")) & (F.col("bin") == F.col("b")) & F.col("v").between(F.col("t") - width, F.col("t"))
    return buys.join(views, near, "left_semi").select("event_id", "user_id").distinct()


def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's dearest open order, or nothing: a maximum of structs in one pass instead of a subquery a row."""
    best = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    joined = table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


def count_plus_one(spark: SparkSession, d: str) -> DataFrame:
    """The number that each customer's next finished order would have."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", (F.coalesce("n", F.lit(0)) + 1).alias("next_number"))


def inline_values_product(spark: SparkSession, d: str) -> DataFrame:
    """Every region with every literal tier: the literals are exploded, no cross join is planned."""
    tiers = F.array(*(F.struct(F.lit(n).alias("tier"), F.lit(f).alias("floor")) for n, f in (("bronze", 0), ("silver", 10), ("gold", 50))))
    rows = table(spark, d, "region").select("r_name", F.explode(tiers).alias("t"))
    return rows.select("r_name", "t.tier", F.col("t.floor").cast("long").alias("floor"))


def join_on_parameter(spark: SparkSession, d: str, supplier: int = 7) -> DataFrame:
    """Customers in the nation of one supplier, with its name: the supplier is one row at most."""
    one = table(spark, d, "supplier").where(F.col("s_suppkey") == supplier).limit(1).select("s_nationkey", "s_name")
    joined = table(spark, d, "customer").join(F.broadcast(one), F.col("c_nationkey") == F.col("s_nationkey"))
    return joined.select("c_custkey", "s_name")


def two_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders that have both a returned and an accepted line: one pass over the lines stands for two semi joins."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a")
    )
    found = table(spark, d, "orders").join(lines.where("r AND a"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return found.select("o_orderkey", "o_orderstatus")


def existence_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A customer's kind: the trimmed segment unless it is empty, else whether there is an open order, else a default."""
    flags = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"))
    segment = F.nullif(F.trim(F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))), F.lit(""))
    joined = table(spark, d, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce(segment, F.when(F.col("open"), "waiting"), F.lit("idle")).alias("kind"))


def json_path_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A label for every event: an empty value counts as missing, then a JSON path, then the type before its first letter p."""
    own = F.nullif(F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.when(F.col("event_id") % 3 == 0, F.lit("named"))), F.lit(""))
    path = F.nullif(F.get_json_object("props", "$.k"), F.lit("0"))
    rest = F.substring_index("event_type", "p", 1)
    return table(spark, d, "events").select("event_id", F.coalesce(own, path, rest).alias("label"))


def greatest_by_self(spark: SparkSession, d: str) -> DataFrame:
    """For each part the supplier of its largest line, ties to the smaller key, with the supplier's name."""
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_quantity", (-F.col("l_suppkey")).alias("k"))).alias("b"))
    joined = best.join(table(spark, d, "supplier"), -F.col("b.k") == F.col("s_suppkey"), "left")
    return joined.select("l_partkey", F.col("b.l_quantity").alias("l_quantity"), "s_name")


def similar_within_key(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    """Pairs of different word sets among the part names of a brand that are ``least`` similar or more, and how many parts have each.

    Parts with one word set are one row before anything is paired. Sets meet by the rarest of their words: of two sets as similar as
    asked, the first common word in order of rarity is among the first size - least * size + 1 of both, so no pair is lost, and a
    word that most parts have brings few together.
    """
    words = F.array_sort(word_tokens(F.col("p_name"), 1))
    sets = table(spark, d, "part").groupBy("p_brand", words.alias("words")).agg(F.count("*").alias("parts")).where("size(words) > 0")
    each = sets.select("p_brand", "words", "parts", F.explode("words").alias("word"))
    often = each.groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    rare = each.join(often, ["p_brand", "word"]).groupBy("p_brand", "words", "parts").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("rare"))
    sets = rare.withColumn("rare", F.transform("rare", lambda x: x["word"]))
    first = F.size("rare") - F.ceil(F.size("rare") * least - 1e-9).cast("int") + 1
    met = sets.withColumn("word", F.explode(F.slice("rare", 1, first)))
    a, b = (met.select("p_brand", "word", F.col("words").alias(f"{s}_set"), F.col("rare").alias(f"{s}_rare"), F.col("parts").alias(f"{s}_parts")) for s in ("left", "right"))
    pairs = a.join(b, ["p_brand", "word"]).withColumns({f"{s}_words": F.array_join(f"{s}_set", " ") for s in ("left", "right")})
    common = F.array_intersect("left_rare", "right_rare")
    similarity = jaccard(F.col("left_set"), F.col("right_set"))
    pairs = pairs.where((F.col("left_words") < F.col("right_words")) & (common[0] == F.col("word")) & (similarity >= least))
    return pairs.select("p_brand", "left_words", "right_words", "left_parts", "right_parts", F.round(similarity, 4).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        nway_inner, left_made_inner, range_in_aggregate, interval_semi, lateral_top1, count_plus_one, inline_values_product,
        join_on_parameter, two_children, existence_fallback, json_path_fallback, greatest_by_self, similar_within_key,
    )
}
SQL = {
    "similar_within_key": """WITH s AS (SELECT p_brand, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS w FROM part),
        g AS (SELECT p_brand, w, array_to_string(w, ' ') AS words, count(*) AS parts FROM s WHERE len(w) > 0 GROUP BY p_brand, w),
        p AS (SELECT a.p_brand, a.words AS left_words, b.words AS right_words, a.parts AS left_parts, b.parts AS right_parts,
            len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS x
            FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.words < b.words)
        SELECT p_brand, left_words, right_words, left_parts, right_parts, round(x, 4) AS similarity FROM p WHERE x >= 0.3""",
    "nway_inner": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(*) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' GROUP BY n_name""",
    "left_made_inner": """SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY c_mktsegment""",
    "range_in_aggregate": """SELECT c.user_id, count(*) AS n_clicks FROM events c
        JOIN (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY user_id) s
        ON c.user_id = s.user_id AND c.ts >= s.since WHERE c.event_type = 'click' GROUP BY c.user_id""",
    "interval_semi": """SELECT event_id, user_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events v
        WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts)""",
    "lateral_top1": """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
        ON c_custkey = o_custkey AND n = 1""",
    "count_plus_one": """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') + 1 AS next_number
        FROM customer""",
    "inline_values_product": """SELECT r_name, tier, floor::BIGINT AS floor FROM region,
        (VALUES ('bronze', 0), ('silver', 10), ('gold', 50)) AS t(tier, floor)""",
    "join_on_parameter": "SELECT c_custkey, s_name FROM customer JOIN supplier ON s_suppkey = 7 AND c_nationkey = s_nationkey",
    "two_children": """SELECT o_orderkey, o_orderstatus FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""",
    "existence_fallback": """SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''),
        CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'waiting' END, 'idle') AS kind
        FROM customer""",
    "json_path_fallback": """SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'named' END, ''),
        nullif(json_extract_string(props, '$.k'), '0'), split_part(event_type, 'p', 1)) AS label FROM events""",
    "greatest_by_self": """SELECT l_partkey, l_quantity, s_name FROM (SELECT *,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey) AS n FROM lineitem)
        LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE n = 1""",
}
