"""Capped shares, differences of snapshots, references and measures of sets against plain versions."""

import random
from fractions import Fraction

import pytest

from talus.operators import evidence, shares, snapshots


def plain_shares(rows, total, cap):
    """Water filling by rounds: cap what is above, deal the rest anew, until nothing is."""
    out = {}
    for group in {g for g, _, _ in rows}:
        mine = [(i, max(w or 0, 0)) for g, i, w in rows if g == group]
        weights = {i: w for i, w in mine}
        if not any(weights.values()):
            weights = dict.fromkeys(weights, 1)
        top = max(cap, -(-total // len(mine)))
        capped = set()
        while True:
            rest = sum(w for i, w in weights.items() if i not in capped)
            left = total - top * len(capped)
            exact = {i: Fraction(w * left, rest) if rest else Fraction(0) for i, w in weights.items() if i not in capped}
            if not (over := {i for i, x in exact.items() if x > top}):
                break
            capped |= over
        share = dict.fromkeys(capped, top) | {i: int(x) for i, x in exact.items()}
        spare = total - sum(share.values())
        for i in sorted((i for i in exact if exact[i] % 1), key=lambda i: (-(exact[i] % 1), i))[:spare]:
            share[i] += 1
        out |= {(group, i): (i in capped, share[i]) for i in weights}
    return out


@pytest.mark.parametrize("total,cap", [(100, 35), (10_000, 7), (7, 3), (100, 100)])
def test_capped_shares(spark, total, cap):
    rng = random.Random(total + cap)
    rows = [(g, i, rng.choice([0, 1, 2, 3, 50, 1000, 10**9, None, -4])) for g in range(25) for i in range(rng.randint(1, 14))]
    rows += [(99, i, rng.choice([1, 1, 5, 10**6])) for i in range(400)] + [(98, 1, 0), (98, 2, None)] + [(None, 1, 3), (None, 2, 4)]
    found = shares.capped_shares(spark.createDataFrame(rows, "g long, i long, w long"), "g", "i", "w", total, cap).collect()
    assert {(r["group"], r["item"]): (r["capped"], r["share"]) for r in found} == plain_shares(rows, total, cap)


def test_differences_and_lives(spark):
    rng = random.Random(2)
    rows = [(k, s, rng.choice(["a", "b", None])) for k in range(60) for s in range(1, 9) if rng.random() < 0.5]
    life = snapshots.lives(spark.createDataFrame(rows, "key long, stage long, value string"), "key", "stage", "value")
    state = {}
    for k, s, v in rows:
        state.setdefault(k, {})[s] = v
    wanted = []
    for k, seen in state.items():
        for s in range(2, 9):
            if s in seen and s - 1 not in seen:
                wanted.append((k, s, "added", None, seen[s]))
            elif s not in seen and s - 1 in seen:
                wanted.append((k, s, "removed", seen[s - 1], None))
            elif s in seen and seen[s] != seen[s - 1]:
                wanted.append((k, s, "changed", seen[s - 1], seen[s]))
    assert sorted(map(str, map(tuple, snapshots.differences(life, 1, 8).collect()))) == sorted(map(str, wanted))
    for r in snapshots.lifecycle(life).collect():
        stages = sorted(state[r["key"]])
        pairs = list(zip(stages, stages[1:]))
        assert (r["first"], r["last"], r["stages"]) == (stages[0], stages[-1], len(stages))
        assert r["returns"] == sum(b > a + 1 for a, b in pairs)
        assert r["changes"] == sum(b == a + 1 and state[r["key"]][a] != state[r["key"]][b] for a, b in pairs)


def test_first_reference_wins_and_orphans_go(spark):
    owners = spark.createDataFrame([(1, [7, 5, None, 5], [5, 9, 8]), (2, None, []), (3, [], [6, 6])], "id long, a array<long>, b array<long>")
    known = spark.createDataFrame([(5,), (9,), (6,), (6,)], "ref long")
    got = evidence.referenced(owners, "id", ["a", "b"], known)
    assert sorted(map(tuple, got.collect())) == [(1, 5, "a", 1), (1, 9, "b", 1), (3, 6, "b", 0)]


def test_stored_entries_where_rows_are_missing(spark):
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    stored = spark.createDataFrame([(1, '[{"v":"no"}]'), (2, '[{"v":"y"},null,{"v":null}]'), (3, "broken"), (4, None), (5, "[]")], "k long, j string")
    got = evidence.with_stored(rows, stored, "k", "j", "v string")
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'x', 'rows')", "(2, 'y', 'stored')", "(2, None, 'stored')"]


def test_measures_of_sets_with_a_hot_key(spark):
    found = [("hot", k) for k in range(3000)] + [("a", 1), ("a", 1), ("a", 2), ("only found", 1)]
    wanted = [("hot", k) for k in range(1000, 4000)] + [("a", 2), ("only wanted", 1)]
    make = lambda rows: spark.createDataFrame(rows, "k string, i long").repartition(7)
    got = {r["key"]: r for r in evidence.set_measures(make(found), make(wanted), "k", "i").collect()}
    assert (got["hot"]["precision"], got["hot"]["recall"]) == (2 / 3, 2 / 3)
    assert (got["a"]["found"], got["a"]["precision"], got["a"]["recall"]) == (2, 0.5, 1.0)
    assert (got["only found"]["precision"], got["only wanted"]["f1"]) == (0.0, 0.0)
    assert got["micro"]["precision"] == 2001 / 3003 and abs(got["macro"]["precision"] - (2 / 3 + 0.5) / 4) < 1e-12
    none = evidence.set_measures(make([]).where("false"), make([]), "k", "i").collect()
    assert {r["key"]: r["f1"] for r in none} == {"micro": 0.0, "macro": 0.0}


def test_sources_that_cover_together(spark):
    items = spark.createDataFrame([(1, t) for t in "abcd"] + [(2, "a")], "item long, token string")
    sources = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 11, "b"), (1, 12, "c"), (1, 12, "z"), (3, 1, "a")], "item long, source long, token string")
    got = {r["item"]: tuple(r)[1:] for r in evidence.covered(items, sources).collect()}
    assert got == {1: (4, 3, 3, 2, False), 2: (1, 0, 0, 0, False)}
