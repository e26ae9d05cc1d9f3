"""Line dedup against a plain version: white space, case, nulls, repeats, hot lines, clashing names."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from talus.llm import line_dedup

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def plain(rows, least):
    """rows: (doc_id, text)."""
    seen = defaultdict(set)
    for id_, text in rows:
        for line in (text or "").split("\n"):
            if key := line.strip(SPACE).translate(LOWER):
                seen[key].add(id_ if id_ is not None else text)
    gone = {k for k, v in seen.items() if len(v) >= least}
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if x.strip(SPACE).translate(LOWER) not in gone]
        out.append((id_, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def key(row):
    return tuple(str(x) for x in row)


CASES = {
    "white space and case": [(k, f" \tSame LINE{' ' * k}\nown {k}\n\n") for k in range(4)],
    "letters outside A-Z keep their case": [(1, "Été\nx"), (2, "été\nX"), (3, "Été\nK"), (4, "k\nK")],
    "a space that is not stripped": [(1, " a"), (2, "a"), (3, "a"), (4, " a")],
    "null and empty": [(1, None), (2, ""), (3, None), (4, "\n\n\n"), (5, " ")],
    "a line often in one document": [(1, "a\n" * 50), (2, "a\nb"), (3, "b\nc")],
    "repeated rows and null ids": [(1, "a\nb"), (1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (None, "a\nd"), (None, "c"), (None, None)],
    "one id, several texts": [(1, "a\nb"), (1, "a\nc"), (2, "a"), (3, "c\nc")],
    "line ends of other systems": [(k, f"x\r\ny{k}\r\n ") for k in range(3)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("least", [2, 3])
def test_equals_plain_version(spark, case, least):
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").withColumns({c: line_dedup.F.lit(7) for c in ("_k1", "n_lines", "_lines")})
    found = line_dedup.drop_common_lines(docs, least_docs=least)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(CASES[case], least), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_common_lines(docs).collect() == []


def test_hot_line_and_long_text(spark):
    rows = [(k, f"hot\nown {k}\nhot") for k in range(2000)] + [(9999, "\n".join(f"l{k % 500}" for k in range(60_000)) + "\nHOT ")]
    found = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows, 10), key=key)


def test_exchanged_where_dropped_lines_are_not_broadcast(spark):
    rows = [(k, f"a\nb{k % 5}\nc{k}") for k in range(60)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows, 10), key=key)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = line_dedup.op13_line_dedup(spark, data)
    wanted = con.sql(line_dedup.SQL).query("w", f"SELECT {', '.join(found.columns)} FROM w").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    brute = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in plain(texts.items(), 10)}
    assert set(map(tuple, found.collect())) == brute
