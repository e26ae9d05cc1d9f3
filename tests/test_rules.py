"""Rules as rows against the same rules in plain Python."""

from talus.operators import rules

RULES = "rule long, scope string, field string, operator string, value string"


def outcome(spark, entities, asked, known):
    got = rules.evaluated(
        spark.createDataFrame(entities, "entity long, scope string"),
        spark.createDataFrame(asked, RULES),
        spark.createDataFrame(known, "entity long, field string, fact string"),
    )
    return {r["entity"]: (r["asked"], r["passed"], [tuple(x) for x in r["failed"]]) for r in got.collect()}


def test_every_operator_and_reason(spark):
    asked = [
        (1, "job", "years", ">=", "3"), (2, "job", "notice", "<=", "30"), (3, "job", "city", "in", "Oslo, Bergen ,Bodø"), (4, "job", "skills", "words", "sql spark"),
        (5, "job", "since", "before", "2024-01-01"), (6, "job", "since", "from", "2020-05-05"), (7, "job", "name", "<>", " nobody"), (8, "job", "degree", "=", "BSc"),
        (9, "job", "years", "near", "3"), (10, "empty words", "skills", "words", "- -"), (11, "bad value", "years", ">=", "three"),
    ]
    good = {"years": "3.0", "notice": " 30 ", "city": " bergen", "skills": "Spark, SQL and more", "since": "2021-01-01 10:00:00", "name": "Ann", "degree": "bsc "}
    bad = {"years": "2.99", "notice": "soon", "city": "Bodo", "skills": "sql", "since": "later", "name": "NOBODY"}
    known = [(1, f, v) for f, v in good.items()] + [(2, f, v) for f, v in bad.items()] + [(4, "skills", "x"), (5, "years", "9")]
    got = outcome(spark, [(1, "job"), (2, "job"), (3, "job"), (4, "empty words"), (5, "bad value"), (6, "no rules")], asked, known)
    assert got[1] == (9, False, [(9, "years", "unknown operator")])
    assert got[2] == (9, False, [(1, "years", "unmet"), (2, "notice", "unreadable"), (3, "city", "unmet"), (4, "skills", "unmet"), (5, "since", "unreadable"), (6, "since", "unreadable"), (7, "name", "unmet"), (8, "degree", "missing"), (9, "years", "unknown operator")])
    assert [x[2] for x in got[3][2]] == ["missing"] * 8 + ["unknown operator"]
    assert got[4] == (1, False, [(10, "skills", "unmet")])
    assert got[5] == (1, False, [(11, "years", "unreadable")])
    assert got[6] == (0, True, [])


def test_one_of_many_facts_is_enough_for_a_hot_entity(spark):
    known = [(1, "tag", f"t{k}") for k in range(5000)] + [(1, "n", "no number"), (1, "n", "7"), (2, "n", "no number"), (2, "n", "3")]
    got = outcome(spark, [(1, "a"), (2, "a")], [(1, "a", "tag", "=", "t4999"), (2, "a", "n", ">=", "5")], known)
    assert got == {1: (2, True, []), 2: (2, False, [(1, "tag", "missing"), (2, "n", "unmet")])}


def test_facts_of_columns(spark):
    rows = spark.createDataFrame([(1, 2.5, None), (2, None, "x")], "id long, a double, b string")
    assert sorted(map(tuple, rules.facts(rows, "id", "a", "b").collect())) == [(1, "a", "2.5"), (2, "b", "x")]
