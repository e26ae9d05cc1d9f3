"""The Merkle manifest against a plain recursion: tree shapes, nulls, ties, hot sources, tampering."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from talus.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """Levels of a tree, from the leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, k):
    """(siblings before, siblings after) level by level."""
    for level in levels[:-1]:
        run = level[k - k % 16 : k - k % 16 + 16]
        yield run[: k % 16], run[k % 16 + 1 :]
        k //= 16


def brute(rows):
    """rows in the order of SCHEMA."""
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = []
    for s in sources:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown.append(climb([leaf(r) for r in trees[s]]))
    top = climb([g[-1][0] for g in grown])
    for at, (s, levels) in enumerate(zip(sources, grown)):
        for k, r in enumerate(trees[s]):
            steps = [*way(levels, k), *way(top, at)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            claim = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r)
            for a, b in steps:
                claim = sha("".join([*a, claim, *b]))
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[-1][0], root, sha("".join("".join(a + b) for a, b in steps)), claim, claim == root))
    return sorted(out, key=str)


def asked(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("_g", "_index", "root", "_kids")})
    docs.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle(spark, str(tmp_path)).collect()), key=str)


def docs(n, source, first=0):
    return [(first + k, source, "en", k, f"Text {k}\nÉ") for k in range(n)]


CASES = {
    "empty table": [],
    "one document": docs(1, "a"),
    "one source of one run": docs(16, "a"),
    "one more than a run": docs(17, "a"),
    "one more than two levels": docs(257, "a"),
    "lone leaves of many sources": [r for k in range(40) for r in docs(1, f"s{k}", k)],
    "sources in bytewise order, null first": [r for k, s in enumerate([None, "", "b", "B", "é", "z", "\U0001f600", "￿"]) for r in docs(3, s, 10 * k)],
    "nulls in any column": [(None, None, None, None, None), (None, "a", None, None, ""), (5, None, "en", None, "X"), (5, "a", "", 0, None), (0, "a", "-", -3, "A" * 100_000)],
    "ties and repeated rows": [(1, "a", "en", 1, "A")] * 20 + [(1, "a", "en", 1, f"A{k}") for k in range(20)] + [(None, "a", "en", 1, "A")] * 5,
    "a hot source": docs(900, "hot") + [r for k in range(20) for r in docs(k, f"s{k}", 1000 + 30 * k)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_tree(spark, tmp_path, case):
    assert asked(spark, CASES[case], tmp_path) == brute(CASES[case])


def test_many_levels_in_many_ranges(spark, tmp_path):
    rows = docs(4500, "hot") + [r for k in range(300) for r in docs(2, f"s{k:03}", 10_000 + 10 * k)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert asked(spark, rows, tmp_path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_proofs_lead_to_the_root(spark):
    table = spark.createDataFrame(docs(300, "a") + docs(1, "b", 900), SCHEMA)
    leaves = table.select("source", "doc_id", merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS]).alias("_digest"))
    found = merkle.proofs(leaves).collect()
    assert len(found) == 301
    for r in found:
        at = bytes(r["leaf"])
        for step in r["path"]:
            kids = bytes(step["kids"])
            assert kids[32 * step["place"] : 32 * step["place"] + 32] == at
            at = merkle.parent_digest(kids)
        assert at == bytes(r["root"])


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = merkle.op12_merkle(spark, data)
    wanted = con.sql(merkle.SQL).query("w", f"SELECT {', '.join(found.columns)} FROM w").fetchall()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(wanted) and {r[-1] for r in got} == {True, False}
    assert got == sorted(brute(con.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()))
