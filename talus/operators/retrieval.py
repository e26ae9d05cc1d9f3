"""Lexical retrieval: an inverted index as a table, and the exact best k documents for each of many queries.

The weight of a token in a document is that of BM25 (Robertson and Zaragoza, 2009), in whole millionths, so that sums do not
depend on their order. Queries meet documents through tokens they share. The entries of asked tokens are dealt by document, so a
document's scores are summed where its entries lie (as long as Spark broadcasts the queries' tokens), and only the best of each task are
exchanged. A bound from the rarest tokens of a query keeps documents that cannot be among its best k from being sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.scratch import written
from talus.sources import table

K1, B, SCALE = 1.2, 0.75, 1_000_000
#: Postings in a block: a frequent token has many blocks, by hash of the document.
BLOCK = 1024
#: Postings of the rarest tokens of a query, for each of its k results, that give the bound.
SEED = 50
#: Words that are not looked for.
STOP = ("and", "for", "that", "the", "this", "was", "with")


def stem(word: Column) -> Column:
    """One plural ending off words of five letters or more (rules of Harman, 1991)."""
    ies, es = word.endswith("ies") & ~word.rlike("[ea]ies$"), word.endswith("es") & ~word.rlike("[aeo]es$")
    s = word.endswith("s") & ~word.rlike("[us]s$")
    n = F.length(word)
    cut = F.when(ies, F.concat(F.left(word, n - 3), F.lit("y"))).when(es | s, F.left(word, n - 1)).otherwise(word)
    return F.when(n >= 5, cut).otherwise(word)


def tokens(text: Column, stop: tuple[str, ...] = STOP, least: int = 3) -> Column:
    """Lower-case words of letters and digits in their order, without short and stop words, plurals cut."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)), stem)


@dataclass(frozen=True)
class Index:
    """rows: doc, words (in their order, a written table); number of documents and their mean length."""

    rows: DataFrame
    documents: int
    mean: float

    def of(self, asked: DataFrame | None = None) -> DataFrame:
        """doc, token, part of all tokens, or of those of ``asked`` (token). ``part`` is BM25's factor of a token's frequency in its
        document; that of its rarity comes with the query."""
        found = self.rows.select("doc", F.size("words").alias("length"), F.explode("words").alias("token"))
        if asked is not None:
            found = found.join(asked.select("token").distinct(), "token", "left_semi")
        counted = found.groupBy("doc", "length", "token").agg(F.count("*").alias("tf"))
        norm = K1 * (1 - B + B * F.col("length") / F.lit(self.mean))
        return counted.select("doc", "token", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))

    @property
    def words(self) -> DataFrame:
        return self.of()

    @property
    def blocks(self) -> DataFrame:
        """The index by token: token, block, n, most, postings (doc, part); a frequent token has many blocks."""
        often = self.words.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > BLOCK)
        dealt = self.words.join(often.select("token", F.ceil(F.col("df") / BLOCK).alias("blocks")), "token", "left")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))))
        return dealt.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("part").alias("most"), F.collect_list(F.struct("doc", "part")).alias("postings"))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of ``docs``; ids are not null and unique, and a null text has no tokens."""
    rows = written(docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("words")), "tokens")
    n, mean = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    return Index(rows, n, mean or 1.0)


def weight(part: Column) -> Column:
    return F.floor(F.lit(SCALE) * F.col("factor") * F.col("idf") * part + 0.5).cast("long")


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query", text: str = "text", aliases: DataFrame | None = None, least_overlap: int = 1) -> DataFrame:
    """query, doc, rank, score (millionths), overlap (tokens in common) of the best ``k`` documents of each query.

    ``aliases`` (token, alias, share) widens a query: an alias counts like its token times ``share``, and the best of several
    factors holds. Only documents with ``least_overlap`` tokens of the query count. Equal scores go by doc.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).withColumn("factor", F.lit(1.0))
    if aliases is not None:
        wider = asked.join(aliases, "token").select("query", F.col("alias").alias("token"), F.col("share").cast("double").alias("factor"))
        asked = asked.unionByName(wider).groupBy("query", "token").agg(F.max("factor").alias("factor"))
    asked = written(asked, "asked")
    words = written(index.of(asked), "asked-words")
    n = F.lit(index.documents)
    stats = words.groupBy("token").agg(F.count("*").alias("df"))
    asked = asked.join(stats, "token").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rare_first = Window.partitionBy("query").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one query's tokens
    asked = asked.withColumn("rare", (F.sum("df").over(rare_first) <= SEED * k) | (F.count("*").over(rare_first) == 1))
    asked = written(asked.select("query", "token", "factor", "idf", "rare"), "query-tokens")

    def scored(terms: DataFrame) -> DataFrame:
        """Sums over these tokens, by document, so that a frequent token is many tasks' and sums are made before rows are exchanged."""
        some = words.join(terms.select("token").distinct(), "token", "left_semi").repartition("doc")
        found = some.join(terms, "token").select("query", "doc", weight(F.col("part")).alias("score"))
        return found.groupBy("query", "doc").agg(F.sum("score").alias("score"), F.count("*").alias("overlap")).where(F.col("overlap") >= least_overlap)

    def best(found: DataFrame) -> DataFrame:
        """Spark keeps the first k of each query in every task before it exchanges rows."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = best(scored(asked.where("rare")))
    # the best k have at least the k-th score by the rarest tokens alone
    floor = written(first.where(F.col("rank") == k).select("query", F.col("score").alias("floor")), "floors")
    total = scored(asked).join(floor, "query", "left").where(F.col("score") >= F.coalesce("floor", F.lit(0)))
    return best(total).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score", "overlap")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = search(build(table(spark, d, "documents")), table(spark, d, "benchmark"), 10, query_id="item_id")
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score", "overlap")


def lexical_topk_widened(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the words of brands' most common types, with sizes' words as aliases: five for each brand, two words in common at least."""
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_brand", "p_type", "p_name")
    kinds = parts.groupBy("p_brand", "p_type").count()
    best = kinds.groupBy("p_brand").agg(F.max_by("p_type", F.struct("count", "p_type")).alias("p_type"))
    # the name of the first part of a type is a second way to ask for that type's first word
    first = parts.groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    asked = best.join(first, "p_type").select("p_brand", F.concat_ws(" ", "p_type", "p_name").alias("text"))
    words = parts.select(tokens(F.col("p_type")).alias("t"), tokens(F.col("p_name")).alias("a"))
    pairs = words.where("size(t) > 0 AND size(a) > 0").select(F.get("t", F.lit(0)).alias("token"), F.get("a", F.lit(0)).alias("alias")).distinct()
    aliases = pairs.groupBy("token").agg(F.min("alias").alias("alias")).withColumn("share", F.lit(0.5))
    found = search(build(parts, "p_partkey"), asked, 5, query_id="p_brand", aliases=aliases, least_overlap=2)
    return found.select(F.col("query").alias("p_brand"), F.col("doc").alias("p_partkey"), "rank", "score", "overlap")


def _token_sql(text: str) -> str:
    return f"""list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'),
      lambda w: length(w) >= 3 AND w NOT IN ('and', 'for', 'that', 'the', 'this', 'was', 'with')),
      lambda w: CASE WHEN length(w) < 5 THEN w
        WHEN w LIKE '%ies' AND NOT regexp_matches(w, '[ea]ies$') THEN left(w, length(w) - 3) || 'y'
        WHEN w LIKE '%es' AND NOT regexp_matches(w, '[aeo]es$') THEN left(w, length(w) - 1)
        WHEN w LIKE '%s' AND NOT regexp_matches(w, '[us]s$') THEN left(w, length(w) - 1) ELSE w END)"""


_RANKED = """
words AS (SELECT doc, len(t) AS length, unnest(t) AS token FROM docs),
counted AS (SELECT doc, length, token, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
idfs AS (SELECT token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counted, sizes GROUP BY token, n),
hits AS (
  SELECT query, doc, floor(1000000 * factor * idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) + 0.5)::BIGINT AS w
  FROM asked JOIN idfs USING (token) JOIN counted USING (token), sizes),
summed AS (SELECT query, doc, sum(w)::BIGINT AS score, count(*) AS overlap FROM hits GROUP BY query, doc HAVING count(*) >= {least}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM summed)
"""

QUERIES = {"lexical_topk": lexical_topk, "lexical_topk_widened": lexical_topk_widened}
SQL = {
    "lexical_topk": f"""
WITH docs AS (SELECT doc_id AS doc, {_token_sql("text")} AS t FROM documents),
asked AS (SELECT DISTINCT item_id AS query, unnest({_token_sql("text")}) AS token, 1.0::DOUBLE AS factor FROM benchmark),
{_RANKED.format(least=1)}
SELECT query AS item_id, doc AS doc_id, rank, score, overlap FROM ranked WHERE rank <= 10
""",
    "lexical_topk_widened": f"""
WITH docs AS (SELECT p_partkey AS doc, {_token_sql("p_name || ' ' || p_type")} AS t FROM part),
kinds AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL),
best AS (SELECT p_brand, arg_max(p_type, {{'c': c, 't': p_type}}) AS p_type FROM kinds GROUP BY p_brand),
firsts AS (SELECT p_type, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_type),
texts AS (SELECT p_brand AS query, p_type || ' ' || p_name AS text FROM best JOIN firsts USING (p_type)),
own AS (SELECT DISTINCT query, unnest({_token_sql("text")}) AS token FROM texts),
pairs AS (SELECT {_token_sql("p_type")}[1] AS token, {_token_sql("p_name")}[1] AS alias FROM part),
aliases AS (SELECT token, min(alias) AS alias FROM pairs WHERE token IS NOT NULL AND alias IS NOT NULL GROUP BY token),
asked AS (
  SELECT query, token, max(factor) AS factor FROM (
    SELECT query, token, 1.0::DOUBLE AS factor FROM own UNION ALL
    SELECT query, alias, 0.5::DOUBLE FROM own JOIN aliases USING (token)) GROUP BY query, token),
{_RANKED.format(least=2)}
SELECT query AS p_brand, doc AS p_partkey, rank, score, overlap FROM ranked WHERE rank <= 5
""",
}
