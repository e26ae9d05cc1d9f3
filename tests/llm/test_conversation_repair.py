"""Repair of conversations against a search over all edits and a plain string program, over cut ranges, hot and hard cases."""

import hashlib
import itertools
import random
import sys
import zlib
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from talus.llm import conversation_repair as repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}
sys.setrecursionlimit(20_000)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(repair.SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def allowed(state, initial):
    return initial == "s" and state == "" or initial in "ua" and initial and NEXT[state] == initial


def cheapest(rows):
    """(cost, audit, repaired) by a program that keeps whole strings."""
    marks = faults(rows)

    @cache
    def best(k, state, inserts):
        out = []
        if inserts < 3:
            q = NEXT[state]
            cost, audit, made = best(k, q, inserts + 1) if k < len(rows) or inserts < 2 else (99, "", ())
            out.append((cost + 2, "I" + audit, (f"{NAME[q]}:", *made)))
        if k == len(rows):
            if state in ("", "a"):
                out.append((0, "", ()))
            return min(out) if out else (10**6, "", ())
        _, role, text = rows[k]
        cost, audit, made = best(k + 1, state, 0)
        out.append((cost + 3, "D" + audit, made))
        if marks[k] in ("", "truncated"):
            more = marks[k] == "truncated"
            if allowed(state, role[:1]):
                cost, audit, made = best(k + 1, role[:1], 0)
                out.append((cost + more, "K" + audit, (f"{role}:{text}", *made)))
            q = NEXT[state]
            cost, audit, made = best(k + 1, q, 0)
            out.append((cost + 2 + more, "R" + audit, (f"{NAME[q]}:{text}", *made)))
        return min(out)

    return best(0, "", 0)


def searched(rows, most):
    """(cost, audit) over all strings of edits up to a cost."""
    import re

    marks, found = faults(rows), []
    for codes in itertools.product(["".join(c) for n in range(3) for c in itertools.product(["Iu", "Ia"], repeat=n)], repeat=len(rows) + 1):
        for turns in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for k, ins in enumerate(codes):
                audit += ins.replace("u", "").replace("a", "")
                roles += ins.replace("I", "")
                cost += len(ins)
                if k < len(rows):
                    e = turns[k]
                    if e != "D" and marks[k] in ("blank", "duplicate"):
                        break
                    cost += {"K": 0, "D": 3}.get(e, 2) + (e != "D" and marks[k] == "truncated")
                    audit += e if e in "KD" else "R"
                    roles += "" if e == "D" else rows[k][1][:1] if e == "K" else e
                    if e == "K" and rows[k][1][:1] not in tuple("sua"):
                        break
            else:
                if cost <= most and re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
    return min(found)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """rows of (conv_id, turn, role, text) as they are repaired: {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)}."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        marks, numbers = faults(mine), [t for t, _, _ in mine if t is not None]
        cost, audit, made = cheapest(tuple(mine))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_part", "edit", "cost")})
    steps, totals = repair.repair(turns.repartition(4))
    wide = totals.join(repair.audited(steps).withColumnRenamed("conv_id", "_c"), F.expr("conv_id <=> _c"))
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in wide.collect()}


def drawn(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["yes.", "no!", "why?", "cut off", "", " \t", "more. ", "end of it.\n", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", "", None, "s"]
    return [
        (conv, rng.choice([k, k, k, k + 3, k // 2, None]), rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice([*texts, f"own {conv} {k}.", f"own {k}.", None]))
        for conv in range(convs)
        for k in range(rng.randint(1, longest))
    ]


def test_plain_program_is_the_search():
    rng = random.Random(5)
    for _ in range(25):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "cut", ""])) for k in range(rng.randint(0, 2))]
        cost, audit, _ = cheapest(tuple(rows))
        assert searched(rows, cost) == (cost, audit)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_program(spark, seed):
    rows = drawn(seed, 120, 9)
    assert found(spark, rows) == brute(rows)


def test_conversation_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(7, k // 2 if k % 9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", "cut", "", f"own {k}.", f"own {k}"])) for k in range(250)]
    rows += [(k, 0, "user", "alone.") for k in range(100, 130)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hard_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, 5, "user", "a."), (1, 5, "user", "a."), (1, 5, "user", "a."), (2, None, "system", "only."), (3, 0, "user", "é" * 50_000 + ".")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(4, k, "user", "") for k in range(5)])[4][5:7] == (15, "DDDDD")
    assert found(spark, []) == {}


def hurt(conv, turn, role, text):
    def show(x):
        return " " if x is None else str(x)

    k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    if k == 0:
        return []
    text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
    return [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def test_query_equals_sql_and_plain_program(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    asked = repair.op11_conversation_repair(spark, data)
    got = sorted(map(tuple, asked.collect()))
    assert got == sorted(con.sql(repair.SQL).query("w", f"SELECT {', '.join(asked.columns)} FROM w").fetchall())
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    plain = brute([x for r in rows for x in hurt(*r)])
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == sorted((c, *plain.get(c, nothing)) for c in {r[0] for r in rows})
    # ids whose every turn is dropped, null ids and null turns
    hard = [(c, None, "user", "hi.") for c in range(60)] + [(None, 1, None, None), (None, None, "user", "b")]
    spark.createDataFrame(hard, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    plain = brute([x for r in hard for x in hurt(*r)])
    assert {tuple(r) for r in got} == {(c, *plain.get(c, nothing)) for c in {r[0] for r in hard}} and len(got) == 61
    con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in got} == set(con.sql(repair.SQL).query("w", f"SELECT {', '.join(asked.columns)} FROM w").fetchall())
