"""Searching, presets, sorting with missing values, set algebra, and scalar families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import contains_any, jaccard, optional_filters
from talus.sources import table


def recent_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last day before the newest one: the reference time is one row."""
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts").alias("as_of"))
    return events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.expr("as_of - INTERVAL 1 DAY")).select("event_id", "user_id")


def prefix_suggestions(spark: SparkSession, d: str, prefix: str = "s") -> DataFrame:
    """The first eight distinct names that begin with a prefix, whatever their case."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).where(F.col("name").startswith(prefix.lower()))
    return names.distinct().orderBy("name").limit(8)


def range_presets(spark: SparkSession, d: str) -> DataFrame:
    """Events within each preset range of whole days up to the newest day: one scan, a row a preset."""
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"))
    events = events.crossJoin(F.broadcast(events.agg(F.max("day").alias("today"))))
    ago = lambda n: F.count_if(F.col("day") > F.date_sub("today", n))
    months = F.count_if(F.col("day") > F.add_months("today", -3))
    wide = events.agg(ago(7).alias("7d"), ago(14).alias("14d"), months.alias("3m"))
    return wide.unpivot([], ["7d", "14d", "3m"], "preset", "n")


def status_tabs(spark: SparkSession, d: str) -> DataFrame:
    """Orders by tab, where a flag goes before the status."""
    tab = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus").isin("O", "P"), "open").otherwise("done")
    return table(spark, d, "orders").groupBy(tab.alias("tab")).agg(F.count("*").alias("n"))


def folded_key(spark: SparkSession, d: str) -> DataFrame:
    """Segments as written in different cases, grouped by their folded key."""
    written = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
    key = F.lower(F.trim(written)).alias("key")
    return table(spark, d, "customer").groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(written).alias("spellings"))


def search_with_facets(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a search finds, counted for each of the constant sizes and for sizes that occur."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    hits = table(spark, d, "part").where(text.contains("brand#1") & (F.col("p_type") != "PROMO")).groupBy("p_type").agg(F.count("*").alias("n"))
    constant = spark.createDataFrame([(x,) for x in ("ECONOMY", "PROMO", "NONE")], "p_type string")
    facets = table(spark, d, "part").select("p_type").union(constant).distinct()
    return facets.join(hits, "p_type", "left").fillna(0, ["n"])


def guarded_transition(spark: SparkSession, d: str) -> DataFrame:
    """A request to withdraw every order, which only some states allow."""
    allowed = F.col("o_orderstatus").isin("O", "P")
    return table(spark, d, "orders").select("o_orderkey", F.when(allowed, "W").otherwise(F.col("o_orderstatus")).alias("status"), allowed.alias("taken"))


def _partly(c: str, key: str):
    return F.when(F.col(key) % 7 != 0, F.col(c))


def sentinel_sort(spark: SparkSession, d: str) -> DataFrame:
    """Twenty orders by falling price, where a missing price counts as the largest."""
    rows = table(spark, d, "orders").select("o_orderkey", _partly("o_totalprice", "o_orderkey").alias("price"))
    return rows.orderBy(F.coalesce("price", F.lit(1e18)).desc(), "o_orderkey").limit(20)


def fallback_sort(spark: SparkSession, d: str) -> DataFrame:
    """Thirty parts by falling price, where a missing price counts as -1 and so comes last."""
    rows = table(spark, d, "part").select("p_partkey", F.coalesce(_partly("p_retailprice", "p_partkey"), F.lit(-1.0)).alias("price"))
    return rows.orderBy(F.desc("price"), "p_partkey").limit(30)


def folded_sort(spark: SparkSession, d: str) -> DataFrame:
    """The fifty suppliers of least balance, missing ones last, ties by folded name and key: every task keeps its first fifty."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", _partly("s_acctbal", "s_suppkey").alias("balance"))
    return rows.orderBy(F.col("balance").asc_nulls_last(), F.lower("s_name"), "s_suppkey").limit(50)


def first_three(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(3)


def page_with_total(spark: SparkSession, d: str, page: int = 10**6, size: int = 12) -> DataFrame:
    """A page of suppliers with the number of rows; a page past the end is the last one.

    An offset is a constant of the plan, so the rows are counted while it is made.
    """
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    total = rows.count()
    at = min(page, max(0, (total - 1) // size))
    return rows.orderBy("s_suppkey").offset(at * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def literal_union(spark: SparkSession, d: str) -> DataFrame:
    """A union of literal rows, with counts where there are any."""
    literals = [spark.range(1).select(F.lit(k).alias("o_orderstatus"), F.lit(v).alias("label")) for k, v in (("F", "finished"), ("O", "open"), ("X", "unknown"))]
    rows = literals[0].unionByName(literals[1]).unionByName(literals[2])
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return rows.join(counts, "o_orderstatus", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def token_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Words of a part's name against those of its type and brand: shared, either, contained, similarity."""
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", F.lit("widget"))), " "))
    rows = table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    shared, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return rows.select(
        "p_partkey", shared.cast("long").alias("shared"), either.cast("long").alias("either"), (shared == F.size("a")).alias("contained"),
        F.round(jaccard(F.col("a"), F.col("b")), 4).alias("similarity"),
    )


def distinct_options(spark: SparkSession, d: str) -> DataFrame:
    """The options of a list and of the list that depends on it, numbered in order."""
    pairs = table(spark, d, "part").select("p_brand", "p_type").distinct()
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type"))
    return pairs.select("p_brand", "p_type", n.cast("long").alias("place"))


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether a customer's odd and even orders have the same set of states, ignoring case and order."""
    states = lambda k: F.array_sort(F.collect_set(F.when(F.col("o_orderkey") % 2 == k, F.lower("o_orderstatus"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg((states(0) == states(1)).alias("equal"))


def status_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Internal states to public ones by a map, with a default, counted."""
    names = F.create_map(*map(F.lit, ("F", "finished", "O", "open")))
    return table(spark, d, "orders").groupBy(F.coalesce(names[F.col("o_orderstatus")], F.lit("submitted")).alias("status")).agg(F.count("*").alias("n"))


def levels_from_score(spark: SparkSession, d: str) -> DataFrame:
    """A repaired score (other scale, clamped, rounded), its level and the item's state."""
    raw = F.col("l_quantity")
    score = F.round(F.least(F.greatest(F.when(raw > 20, raw / 20).otherwise(raw), F.lit(0.0)), F.lit(20.0)), 2)
    level = F.when(F.col("score") <= 1, "none").when(F.col("score") < 4, "weak").when(F.col("score") < 12, "fair").otherwise("strong")
    state = F.when(F.col("score") >= 10, "met").when(F.col("score") >= 2, "partly").otherwise("missing")
    rows = table(spark, d, "lineitem").select(score.alias("score"))
    return rows.groupBy("score", level.alias("level"), state.alias("state")).agg(F.count("*").alias("n"))


def masked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Prices hidden while an order is open, zero for those in between."""
    price = F.when(F.col("o_orderstatus") == "O", None).when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", price.alias("price"))


def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a term in their name or brand, and filters that ask for nothing left out."""
    found = table(spark, d, "part").where(contains_any("SMALL", "p_name", "p_brand")).where(optional_filters(p_type="ECONOMY", p_brand="all", p_size=None))
    return found.select("p_partkey", "p_name", "p_type")


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """The last part of a path, a filled template, and white space collapsed."""
    return table(spark, d, "pages").select(
        "page_id", F.substring_index("url", "/", -1).alias("leaf"),
        F.replace(F.lit("page {id} of {{site}}"), F.lit("{id}"), F.col("page_id").cast("string")).alias("filled"),
        F.trim(F.regexp_replace(F.concat(F.lit("  a\t\n"), F.col("page_id").cast("string"), F.lit("  b ")), r"\s+", " ")).alias("collapsed"),
    )


def pattern_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Validity of a number after its separators are dropped, and the first number in a text."""
    phone = F.regexp_replace(F.concat(F.lit("01"), F.col("c_custkey").cast("string"), F.lit("-55 44.33")), r"[\s.-]", "")
    return table(spark, d, "customer").select(
        "c_custkey", phone.rlike("^01[0-9]{7,9}$").alias("valid"), F.regexp_extract("c_name", "([1-9][0-9]*)", 1).alias("number")
    )


def dates_in_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in three ways, read by trying one format after the other; others are missing."""
    at = F.col("o_orderdate").cast("timestamp")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]
    written = F.when(F.col("o_orderkey") % 4 == 3, F.lit("soon"))
    for k, form in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 4 == k, F.date_format(at, form)).otherwise(written)
    read = F.coalesce(*(F.try_to_timestamp("w", F.lit(form)) for form in forms))
    return table(spark, d, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", F.date_format(read, "yyyy-MM-dd").alias("day"))


def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each nation as JSON with its keys in order."""
    text = F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")))
    return table(spark, d, "nation").select("n_nationkey", F.sha2(text, 256).alias("hash"))


def merged_objects(spark: SparkSession, d: str) -> DataFrame:
    """A flat JSON object patched with another: new values win, a null removes its key."""
    kind = "map<string,string>"
    patch = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": null, "seen": "yes"}')).otherwise(F.lit('{"seen": "no"}'))
    old, new = F.from_json("props", kind), F.from_json(patch, kind)
    merged = F.map_filter(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new), lambda _, v: v.isNotNull())
    keys = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "events").select("event_id", keys.alias("merged"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_window, prefix_suggestions, range_presets, status_tabs, folded_key, search_with_facets, guarded_transition, sentinel_sort,
        fallback_sort, folded_sort, first_three, page_with_total, literal_union, token_algebra, distinct_options, set_equality,
        status_mapping, levels_from_score, masked_scores, substring_search, text_helpers, pattern_helpers, dates_in_formats,
        canonical_hash, merged_objects,
    )
}
SQL = {
    "recent_window": "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "prefix_suggestions": "SELECT DISTINCT lower(p_name) AS name FROM part WHERE lower(p_name) LIKE 's%' ORDER BY name LIMIT 8",
    "range_presets": """WITH x AS (SELECT ts::DATE AS day, (SELECT max(ts)::DATE FROM events) AS today FROM events)
        SELECT '7d' AS preset, count(*) FILTER (WHERE day > today - 7) AS n FROM x UNION ALL
        SELECT '14d', count(*) FILTER (WHERE day > today - 14) FROM x UNION ALL
        SELECT '3m', count(*) FILTER (WHERE day > today - INTERVAL 3 MONTH) FROM x""",
    "status_tabs": """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'done' END AS tab,
        count(*) AS n FROM orders GROUP BY tab""",
    "folded_key": """WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || lower(c_mktsegment) END AS w FROM customer)
        SELECT lower(trim(w)) AS key, count(*) AS n, count(DISTINCT w) AS spellings FROM x GROUP BY key""",
    "search_with_facets": """SELECT p_type, coalesce(n, 0) AS n FROM (SELECT p_type FROM part UNION SELECT unnest(['ECONOMY', 'PROMO', 'NONE']))
        LEFT JOIN (SELECT p_type, count(*) AS n FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')
        AND p_type <> 'PROMO' GROUP BY p_type) USING (p_type)""",
    "guarded_transition": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'W' ELSE o_orderstatus END AS status,
        o_orderstatus IN ('O', 'P') AS taken FROM orders""",
    "sentinel_sort": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders
        ORDER BY coalesce(price, 1e18) DESC, o_orderkey LIMIT 20""",
    "fallback_sort": """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END, -1) AS price FROM part
        ORDER BY price DESC, p_partkey LIMIT 30""",
    "folded_sort": """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS balance FROM supplier
        ORDER BY balance NULLS LAST, lower(s_name), s_suppkey LIMIT 50""",
    "first_three": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3",
    "page_with_total": """SELECT s_suppkey, s_name, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY s_suppkey) - 1 AS r
        FROM supplier) WHERE r // 12 = (total - 1) // 12""",
    "literal_union": """SELECT label, (SELECT count(*) FROM orders WHERE o_orderstatus = k) AS n
        FROM (SELECT 'F' AS k, 'finished' AS label UNION ALL SELECT 'O', 'open' UNION ALL SELECT 'X', 'unknown')""",
    "token_algebra": """WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a,
        list_distinct(string_split(lower(p_type || ' widget'), ' ')) AS b FROM part),
        y AS (SELECT *, len(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS either FROM x)
        SELECT p_partkey, shared, either, shared = len(a) AS contained, round(shared / either, 4) AS similarity FROM y""",
    "distinct_options": """SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS place
        FROM (SELECT DISTINCT p_brand, p_type FROM part)""",
    "set_equality": """SELECT o_custkey, coalesce(list_sort(list(DISTINCT lower(o_orderstatus)) FILTER (WHERE o_orderkey % 2 = 0)), [])
        = coalesce(list_sort(list(DISTINCT lower(o_orderstatus)) FILTER (WHERE o_orderkey % 2 = 1)), []) AS equal FROM orders GROUP BY o_custkey""",
    "status_mapping": """SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'submitted' END AS status, count(*) AS n
        FROM orders GROUP BY status""",
    "levels_from_score": """WITH x AS (SELECT round(least(greatest(CASE WHEN l_quantity > 20 THEN l_quantity / 20 ELSE l_quantity END, 0), 20), 2) AS score
        FROM lineitem) SELECT score, CASE WHEN score <= 1 THEN 'none' WHEN score < 4 THEN 'weak' WHEN score < 12 THEN 'fair' ELSE 'strong' END AS level,
        CASE WHEN score >= 10 THEN 'met' WHEN score >= 2 THEN 'partly' ELSE 'missing' END AS state, count(*) AS n FROM x GROUP BY ALL""",
    "masked_scores": """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN 0 ELSE o_totalprice END AS price FROM orders""",
    "substring_search": """SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'small') OR contains(lower(p_brand), 'small'))
        AND p_type = 'ECONOMY'""",
    "text_helpers": r"""SELECT page_id, string_split(url, '/')[-1] AS leaf, 'page ' || page_id || ' of {{site}}' AS filled,
        'a ' || page_id || ' b' AS collapsed FROM pages""",
    "pattern_helpers": """SELECT c_custkey, len('01' || c_custkey || '554433') BETWEEN 9 AND 11 AS valid,
        regexp_extract(c_name, '[1-9][0-9]*') AS number FROM customer""",
    "dates_in_formats": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
    "canonical_hash": """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS hash
        FROM nation""",
    "merged_objects": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'seen=yes' ELSE 'k=' || json_extract_string(props, '$.k') || ',seen=no' END AS merged
        FROM events""",
}
