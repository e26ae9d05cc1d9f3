"""Many phrases at once: every place of every phrase of a table in every text, in one pass over the texts.

An automaton (Aho and Corasick, 1975) is built from the phrases in each Python worker and run once over each text,
whatever the number of phrases. Phrases travel to the workers in parts of a bounded size, by hash; a larger table of
phrases takes one pass a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources import table

#: Bytes of phrases in one broadcast, about.
PART_BYTES = 8 << 20

_built: dict[str, object] = {}


def automaton(key: str, phrases: list[str]):
    """The automaton of these phrases, kept for later batches and tasks of the same worker."""
    import ahocorasick

    if key not in _built:
        _built.clear()  # one part at a time
        made = ahocorasick.Automaton()
        for x in phrases:
            made.add_word(x, x)
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _inside_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isascii() and text[at].isalnum() or text[at] == "_")


def phrase_hits(texts: DataFrame, phrases: DataFrame, text_id: str, text: str = "text", phrase: str = "phrase", whole_words: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """text_id, phrase, place (code points before it): all places, overlapping ones included.

    Empty and null phrases and texts have none; equal phrases count once. With ``whole_words`` no letter or digit of ASCII and
    no underscore may stand beside a place.
    """
    spark = texts.sparkSession
    wanted = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    total = wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = -(-total // part_bytes)
    kind = texts.schema[text_id]
    rows = texts.select(F.col(text_id), F.col(text).alias("_text")).where(F.col("_text") != "")

    def one_part(k: int) -> DataFrame:
        mine = wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        shipped = spark.sparkContext.broadcast([r[0] for r in mine.collect()])  # about part_bytes
        key = uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(key, shipped.value)
            for batch in batches:
                for row, x in enumerate(batch.column(1).to_pylist()):
                    ids = batch.column(0).slice(row, 1)
                    places, names = [], []
                    for end, name in made.iter(x):
                        at = end + 1 - len(name)
                        if not (whole_words and (_inside_word(x, at - 1) or _inside_word(x, end + 1))):
                            places.append(at)
                            names.append(name)
                    for lo in range(0, len(places), 10_000):
                        n = len(places[lo : lo + 10_000])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([0] * n)), pa.array(names[lo : lo + n]), pa.array(places[lo : lo + n], pa.int64())], [text_id, "phrase", "place"])

        return rows.mapInArrow(find, f"`{text_id}` {kind.dataType.simpleString()}, phrase string, place long")

    if not parts:
        return rows.select(text_id, F.lit("").alias("phrase"), F.lit(0).cast("long").alias("place")).where(F.lit(False))
    return reduce(DataFrame.unionByName, map(one_part, range(parts)))


def windows(texts: DataFrame, text_id: str, text: str, width: int) -> DataFrame:
    """text_id, phrase: every ``width`` words in a row, with single spaces between them."""
    words = F.split(F.col(text), " ")
    rows = texts.select(text_id, words.alias("w")).where(F.size("w") >= width)
    phrase = F.array_join(F.slice("w", F.col("k") + 1, F.lit(width)), " ")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("w") - width))).select(text_id, phrase.alias("phrase")).where("phrase <> ''")


def phrase_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every four words of a benchmark item in the documents."""
    phrases = windows(table(spark, d, "benchmark"), "item_id", "text", 4)
    return phrase_hits(table(spark, d, "documents"), phrases, "doc_id")


def pattern_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents by weighted phrases of groups: the group of most weight, ties by more places, then by number; and the
    first group in order that has any.

    Groups are benchmark items. Their whole pairs of words weigh 1, longer ones of 14 characters or more 3; a pattern
    counts its weight once a document, and the number of its places breaks ties.
    """
    pairs = windows(table(spark, d, "benchmark"), "item_id", "text", 2).distinct()
    hits = phrase_hits(table(spark, d, "documents"), pairs, "doc_id", whole_words=True)
    counted = hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("places"))
    weighed = counted.join(pairs, "phrase").withColumn("weight", F.when(F.length("phrase") >= 14, 3).otherwise(1))
    scores = weighed.groupBy("doc_id", "item_id").agg(F.sum("weight").alias("score"), F.sum("places").alias("places"), F.count("*").alias("patterns"))
    best = F.max(F.struct("score", "places", (-F.col("item_id")).alias("o"), "patterns")).alias("b")
    return scores.groupBy("doc_id").agg(best, F.min("item_id").alias("first_group"), F.count("*").alias("groups")).select(
        "doc_id", (-F.col("b.o")).alias("best_group"), F.col("b.score").alias("score"), F.col("b.places").alias("places"), F.col("b.patterns").alias("patterns"), "first_group", "groups"
    )


_WINDOWS = """
split_words AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, array_to_string(w[k + 1:k + {n}], ' ') AS phrase
  FROM split_words, range(0, greatest(len(w) - {n} + 1, 0)) AS r(k)),
"""

QUERIES = {"phrase_places": phrase_places, "pattern_groups": pattern_groups}
SQL = {
    "phrase_places": f"""
WITH RECURSIVE {_WINDOWS.format(n=4)}
texts AS (SELECT DISTINCT phrase FROM phrases WHERE phrase <> ''),
hits AS (
  SELECT doc_id, phrase, strpos(text, phrase) - 1 AS place, text FROM documents JOIN texts ON contains(text, phrase)
  UNION ALL
  SELECT doc_id, phrase, place + strpos(substr(text, place + 2), phrase), text FROM hits WHERE strpos(substr(text, place + 2), phrase) > 0)
SELECT doc_id, phrase, place FROM hits
""",
    "pattern_groups": f"""
WITH RECURSIVE {_WINDOWS.format(n=2)}
texts AS (SELECT DISTINCT phrase FROM phrases WHERE phrase <> ''),
hits AS (
  SELECT doc_id, phrase, strpos(text, phrase) - 1 AS place, text FROM documents JOIN texts ON contains(text, phrase)
  UNION ALL
  SELECT doc_id, phrase, place + strpos(substr(text, place + 2), phrase), text FROM hits WHERE strpos(substr(text, place + 2), phrase) > 0),
counted AS (
  SELECT doc_id, phrase, count(*) AS places FROM hits
  WHERE NOT regexp_matches(CASE WHEN place = 0 THEN '' ELSE substr(text, place, 1) END, '[A-Za-z0-9_]')
    AND NOT regexp_matches(substr(text, place + length(phrase) + 1, 1), '[A-Za-z0-9_]') GROUP BY doc_id, phrase),
scores AS (
  SELECT doc_id, item_id, sum(CASE WHEN length(phrase) >= 14 THEN 3 ELSE 1 END) AS score, sum(places) AS places, count(*) AS patterns
  FROM counted JOIN phrases USING (phrase) WHERE places > 0 GROUP BY doc_id, item_id),
best AS (
  SELECT doc_id, max({{'score': score, 'places': places, 'o': -item_id, 'patterns': patterns}}) AS b, min(item_id) AS first_group, count(*) AS groups
  FROM scores GROUP BY doc_id)
SELECT doc_id, -b.o AS best_group, b.score::BIGINT AS score, b.places::BIGINT AS places, b.patterns AS patterns, first_group, groups FROM best
""",
}
