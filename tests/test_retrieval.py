"""The index and search against scores by hand: frequent tokens in blocks, bounds, ties, aliases, nulls."""

import math
import random
import re
from collections import Counter

import pytest

from talus.operators import retrieval


def stems(text):
    out = []
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        if len(w) < 3 or w in retrieval.STOP:
            continue
        if len(w) >= 5:
            if re.search("(?<![ea])ies$", w):
                w = w[:-3] + "y"
            elif re.search("(?<![aeo])es$", w) or re.search("(?<![us])s$", w):
                w = w[:-1]
        out.append(w)
    return out


def plain(docs, queries, k, aliases=(), least=1):
    words = {d: Counter(stems(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, text in queries:
        asked = dict.fromkeys(stems(text), 1.0)
        for token, alias, share in aliases:
            if token in stems(text):
                asked[alias] = max(asked.get(alias, 0), share)
        scores = []
        for d, c in words.items():
            norm = retrieval.K1 * (1 - retrieval.B + retrieval.B * sum(c.values()) / mean)
            parts = [
                math.floor(retrieval.SCALE * f * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * (retrieval.K1 + 1) / (c[w] + norm)) + 0.5)
                for w, f in asked.items()
                if w in c
            ]
            if len(parts) >= least:
                scores.append((-sum(parts), d, len(parts)))
        out += [(q, d, r + 1, -s, n) for r, (s, d, n) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def drawn(n, seed=3):
    """Words by Zipf's rule, one of them in every document."""
    rng = random.Random(seed)
    vocab = [f"word{k}x" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(d, "common " + " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60)))) for d in range(n)]


def searched(spark, docs, queries, k, **more):
    index = retrieval.build(spark.createDataFrame(docs, "doc_id long, text string"))
    found = retrieval.search(index, spark.createDataFrame(queries, "query long, text string"), k, **more)
    return index, sorted(tuple(r) for r in found.select("query", "doc", "rank", "score", "overlap").collect())


@pytest.mark.parametrize("least", [1, 3])
def test_equals_scores_by_hand_with_tokens_in_many_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(retrieval, "BLOCK", 32)
    monkeypatch.setattr(retrieval, "SEED", 4)
    docs = drawn(800)
    rng = random.Random(4)
    queries = [(q, "common " + " ".join(rng.sample([w for _, t in docs[:50] for w in t.split()], 6))) for q in range(15)] + [(99, "common"), (98, "absent words"), (97, None)]
    index, found = searched(spark, docs, queries, 7, least_overlap=least)
    assert found == plain(docs, queries, 7, least=least)
    assert index.blocks.where("token = 'common'").count() == 800 / 32
    assert max(r["n"] for r in index.blocks.select("n").collect()) < 3 * 32


def test_ties_nulls_aliases_and_endings(spark):
    docs = [(k, "ponies boxes glass status cats") for k in range(30)] + [(40, None), (41, ""), (42, "the and for"), (43, "Pony, BOX; cat"), (44, "dog " * 200)]
    queries = [(1, "pony box cat"), (2, "statuses"), (3, "hound"), (4, "glass glass glass")]
    aliases = [("hound", "dog", 0.25), ("pony", "cat", 0.5)]
    _, found = searched(spark, docs, queries, 5, aliases=spark.createDataFrame(aliases, "token string, alias string, share double"))
    assert found == plain(docs, queries, 5, aliases)
    assert [r[:3] for r in found if r[0] == 3] == [(3, 44, 1)]


def test_no_documents(spark):
    assert searched(spark, [], [(1, "word")], 3)[1] == []


def test_no_product_of_queries_and_documents(spark):
    index = retrieval.build(spark.createDataFrame(drawn(50), "doc_id long, text string"))
    found = retrieval.search(index, spark.createDataFrame([(1, "common word1x")], "query long, text string"), 3)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan  # the first k are kept before the exchange


def test_scores_are_summed_where_a_document_lies(spark, monkeypatch):
    """No entry that a query and a document share is exchanged: only asked tokens by document, and each task's best."""
    docs = drawn(300)
    index = retrieval.build(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = [(q, f"common word{q}x word1x word2x") for q in range(12)]
    found = retrieval.search(index, spark.createDataFrame(queries, "query long, text string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc#" in plan
    assert not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)
    assert sorted(tuple(r) for r in found.select("query", "doc", "rank", "score", "overlap").collect()) == plain(docs, queries, 3)


def test_coverage_exchanges_no_shared_entries(spark):
    from talus.operators import evidence

    plan = evidence.items_covered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)
