"""The pipeline's stages in order on the smallest tables, each against a plain reckoning of what it keeps."""

import pytest

import corpus_pipeline
from talus.llm import jaccard_join, mixing, quality, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DATA).cache()
        out.append((name, docs, found))
        docs = found
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "toxicity", "near duplicates", "mixing", "packing"]
    assert all(found.columns == docs.columns for _, docs, found in stages[:-1])


def test_quality_keeps_what_the_field_keeps(spark, stages):
    _, docs, found = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    field = quality.train(docs, labels)
    wanted = {r.doc_id for r in docs.collect() if quality.verdict(r.text, field)[-1]}
    assert {r.doc_id for r in found.collect()} == wanted


def test_toxicity_keeps_what_scores_low(spark, stages):
    _, docs, found = stages[1]
    scorer = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    wanted = {r.doc_id for r in docs.collect() if scorer.score(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in found.collect()} == wanted


def test_one_of_each_class_stays(stages):
    _, docs, found = stages[2]
    shingles = {r.doc_id: {tuple(r.text.split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for r in docs.collect()}
    root = {k: k for k in shingles}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = shingles[a], shingles[b]
            if len(x & y) * 10 >= 8 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    assert sorted(r.doc_id for r in found.collect()) == sorted({find(k) for k in ids})
    assert jaccard_join.THRESHOLD == 0.8


def test_mix_and_packing(stages):
    _, docs, found = stages[3]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    counts = {}
    for r in found.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: n for k, n in taken.items() if n}
    _, docs, found = stages[4]
    pieces = found.where("piece = 0").count()
    assert pieces == docs.count()


CLASHING = ["_row", "_n", "_id", "_times", "_text", "_hash", "key", "node", "label", "size", "_block", "_kept0", "root"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = lambda k: " ".join(f"{words[(k * 7 + i * (3 + k % 5)) % 19]}{(k + i * i) % 97}" for i in range(80))
    rows = [(k, text(k), "en", f"s{k % 3}", 80) for k in range(12)] + [(3, text(3), "en", "s0", 80)] * 2 + [(50, text(3), None, None, None)]
    rows += [(None, text(20), "en", "s1", None), (None, text(20), "en", "s1", None), (60, None, None, None, None), (61, "", "en", "s1", 0), (62, " \n", "en", "s1", 2)]
    rows += [(63, " ".join(f"word{k}" for k in range(50_000)), "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(None if k % 2 else f"v{k}" for k in range(len(CLASHING)))) for r in rows], schema).repartition(3).cache()


@pytest.mark.parametrize("number", range(5))
def test_hard_cases_of_every_stage(spark, hard, number):
    name, stage = corpus_pipeline.STAGES[number]
    found = stage(spark, hard, DATA)
    none = stage(spark, hard.limit(0), DATA)
    assert none.count() == 0 and none.schema == found.schema
    got = found.collect()
    ids = [r.doc_id for r in got]
    if number < 4:
        assert found.columns == hard.columns and all(r["_row"] == "v0" and r["_n"] is None and r["key"] == "v6" for r in got)
    if name == "quality":
        assert not {60, 61, 62} & set(ids) and ids.count(3) in (0, 3)
    if name == "toxicity":
        assert {60, 61, 62} <= set(ids)
    if name == "near duplicates":
        assert ids.count(3) == 1 and 50 not in ids and ids.count(None) == 1 and {60, 61, 62, 63} <= set(ids)
    if name == "mixing":
        taken = {(r.doc_id, r._h): r.n for r in mixing.mix(hard.selectExpr("doc_id", "text", "source", "xxhash64(text, source) AS _h"), keep=["_h"]).groupBy("doc_id", "_h").agg({"*": "count"}).toDF("doc_id", "_h", "n").collect()}
        assert taken and not {60, 61, 62} & set(ids) and ids.count(50) <= 2
        total = sum(r.taken for r in mixing.mix(hard).collect())
        assert sum(len(r.text.split()) for r in got) == total
    if name == "packing":
        assert sum(r.doc_id in (60, 61, 62) and r.length == 1 for r in got) == 3
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
