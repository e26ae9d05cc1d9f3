"""Phrases by automaton against a search phrase by phrase."""

import random

import pytest

from talus.operators import patterns


def plain(texts, phrases, whole=False):
    def inside(x, at):
        return 0 <= at < len(x) and (x[at].isascii() and x[at].isalnum() or x[at] == "_")

    out = []
    for i, x in texts:
        for p in {p for p in phrases if p}:
            for at in range(len(x or "")):
                if x.startswith(p, at) and not (whole and (inside(x, at - 1) or inside(x, at + len(p)))):
                    out.append((i, p, at))
    return sorted(out, key=str)


def found(spark, texts, phrases, **more):
    got = patterns.phrase_hits(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), "id", **more)
    assert got.columns == ["id", "phrase", "place"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_equals_plain_search(spark, whole, part_bytes):
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice("ab é\U0001f600_") for _ in range(n))
    phrases = [draw(rng.randint(1, 5)) for _ in range(60)] + ["aa", "aaa", "a", "", None, "a", "aa"]
    texts = [(str(k), draw(rng.randint(0, 40))) for k in range(60)] + [("n", None), (None, "aaaa"), ("e", "")]
    assert found(spark, texts, phrases, whole_words=whole, part_bytes=part_bytes) == plain(texts, phrases, whole)


def test_long_text_and_hot_phrase(spark):
    texts = [("long", "ab" * 30_000)] + [(str(k), "the ab the") for k in range(200)]
    got = found(spark, texts, ["ab", "abab", "the"])
    assert len(got) == 30_000 + 29_999 + 200 * 3


def test_nothing_to_look_for(spark):
    assert found(spark, [("1", "text")], [None, ""]) == []
    assert found(spark, [("1", None)], ["text"]) == []
