"""Operator 11: repair the structure of conversations by the cheapest edits.

A repaired conversation has at most one system turn, then pairs of user and assistant. Edits are keep (K), change the role
(R), delete (D) and insert an empty turn (I). One macro edit is a run of inserts and the edit of the next turn, such as
``IIK``: no macro begins another one, so strings of edits compare as their lists of macros do. The dynamic program over
turns therefore keeps, for each state of the pattern, its cost and the *rank* of its string among those of the same layer,
with a pointer to the state before; strings are put together once, from the pointers. A run of three inserts ends in a state
that one insert reaches from the same place, so macros have two inserts at most.

Conversations are dealt by a range sort, so that one of any length lies in many ranges. A range gives each conversation
in it a table of cost and rank from each state to each; tables of one conversation, a row for each range, are put one after
another, and every range then follows the pointers between its own two states.

Defined cases: a null role or text is one space; rows of a null conv_id are one conversation; turns go by number, nulls
first, equal ones by the SHA-256 of role and text, and equal rows are repeats of each other; a role counts by its first
character, in its case; empty and blank texts are blank; an empty table gives an empty table; other columns are not read,
whatever their names. The digest of a conversation is one sequence of bytes: its rows stream through one task, which
holds a batch of them and the string of edits at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import materialize, partitions

SPACE, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAULTS = ("", "truncated", "blank", "duplicate")
#: States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after the one turn of user or assistant that may come next.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: By the initial of a role (s, u, a, other): the state after it, from each state that allows it.
ALLOWED = ({EMPTY: SYSTEM}, {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
CODES = sorted("I" * k + e for k in range(3) for e in "KRD")
#: The run of inserts that ends a conversation from each state.
LAST = (0, 2, 1, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple  # by state (cost, rank), or None where it is out of reach


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = NEXT[state]
    return state


@cache
def moves(kind: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(state before, state after) to the least (cost, code) for a turn of this kind (initial and fault)."""
    fault, initial = FAULTS[kind // 4], kind % 4
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for p in STATES:
        for k in range(3):
            at, edits = inserted(p, k), []
            edits.append(("D", DELETE, at))
            if fault in ("", "truncated"):
                more = TRUNCATED if fault else 0
                edits.append(("R", REROLE + more, NEXT[at]))
                if at in ALLOWED[initial]:
                    edits.append(("K", KEEP + more, ALLOWED[initial][at]))
            for edit, cost, q in edits:
                new = (INSERT * k + cost, CODES.index("I" * k + edit))
                found[p, q] = min(new, found.get((p, q), new))
    return found


def ranked(best: dict[int, tuple[int, tuple[int, int], int]]) -> tuple[Vector, int, tuple]:
    """From state to (cost, (rank before, rank of the part), state before): costs above the least, that least, pointers."""
    least = min(x[0] for x in best.values())
    order = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][1]))}
    vector = tuple((best[q][0] - least, order[q]) if q in best else None for q in STATES)
    return vector, least, tuple((best[q][2], best[q][1][1]) if q in best else None for q in STATES)


@cache
def step(vector: Vector, kind: int) -> tuple[Vector, int, tuple]:
    """One layer: costs stay relative to the least, so few vectors exist and most layers are looked up."""
    best: dict[int, tuple[int, tuple[int, int], int]] = {}
    for (p, q), (cost, code) in moves(kind).items():
        if vector[p] is not None:
            new = (vector[p][0] + cost, (vector[p][1], code), p)
            best[q] = min(new, best.get(q, new))
    return ranked(best)


def start(state: int) -> Vector:
    return tuple((0, 0) if q == state else None for q in STATES)


def joined(vector: Vector, table: list[int]) -> tuple[Vector, int, tuple]:
    """A table of costs and ranks (-1: out of reach) after ``vector``."""
    best: dict[int, tuple[int, tuple[int, int], int]] = {}
    for p in STATES:
        for q in STATES:
            cost, rank = table[8 * p + 2 * q : 8 * p + 2 * q + 2]
            if vector[p] is not None and cost >= 0:
                new = (vector[p][0] + cost, (vector[p][1], rank), p)
                best[q] = min(new, best.get(q, new))
    return ranked(best)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of one conversation in one range, from rows in order."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: (r["conv_id"], r["_part"]))


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
TABLE = "conv_id long, _part int, " + ", ".join(f"{c} long" for c in COUNTS) + ", first int, last int, first_turn long, last_turn long, turns long, costs array<long>"


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a range: counts, what stands at both ends, cost and rank from each state to each."""

    def each() -> Iterator[dict]:
        for (conv, part), rows in segments(batches):
            at, base = [start(p) for p in STATES], [0] * 4
            out = dict.fromkeys(COUNTS, 0) | {"conv_id": conv, "_part": part, "first": None, "first_turn": None, "last_turn": None, "turns": 0}
            for row in rows:
                kind, turn = row["_kind"], row["turn"]
                if fault := FAULTS[kind // 4]:
                    out[fault] += 1
                if out["first"] is None:
                    out["first"] = kind % 4
                elif (out["last"], kind % 4) not in LEGAL:
                    out["illegal"] += 1
                out["last"] = kind % 4
                if turn is not None and turn != out["last_turn"]:
                    out["turns"] += 1
                    out["last_turn"] = turn
                    out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
                for p in STATES:
                    at[p], more, _ = step(at[p], kind)
                    base[p] += more
            yield out | {"costs": [x for p in STATES for v in at[p] for x in ((base[p] + v[0], v[1]) if v else (-1, -1))]}

    return in_batches(each(), arrow(TABLE))


ROUTE = "conv_id long, _part int, enter int, leave int, inserts int, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long"


def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of a conversation, in order, to the states at which it enters and leaves each range; totals at the last one."""

    def each() -> Iterator[dict]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, parts in groupby(rows, key=lambda r: r["conv_id"]):
            parts = list(parts)  # a small row for each range that the conversation lies in
            vector, cost, back = start(EMPTY), 0, []
            for row in parts:
                vector, more, pointers = joined(vector, row["costs"])
                cost += more
                back.append(pointers)
            end = min((v[0] + INSERT * LAST[q], v[1], q) for q, v in enumerate(vector) if v)
            leave, out = end[2], []
            for row, pointers in zip(reversed(parts), reversed(back)):
                enter = pointers[leave][0]
                out.append({"conv_id": conv, "_part": row["_part"], "enter": enter, "leave": leave, "inserts": 0})
                leave = enter
            turned = [r for r in parts if r["turns"]]
            distinct = sum(r["turns"] for r in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
            out[0] |= {c: sum(r[c] for r in parts) for c in COUNTS} | {"inserts": LAST[end[2]], "cost": cost + end[0]}
            out[0]["illegal"] += sum((a["last"], b["first"]) not in LEGAL for a, b in zip(parts, parts[1:]))
            out[0]["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0
            yield from out

    return in_batches(each(), arrow(ROUTE))


EDIT = "conv_id long, _part int, _step long, edit string, turn long, role string, text string"


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a range with the turns that they leave (none for D)."""

    def each() -> Iterator[dict]:
        for (conv, part), rows in segments(batches):
            rows = list(rows)
            vector, back = start(rows[0]["enter"]), []
            for row in rows:
                vector, _, pointers = step(vector, row["_kind"])
                back.append(pointers)
            state, codes = rows[0]["leave"], []
            for pointers in reversed(back):
                state, code = pointers[state]
                codes.append(CODES[code])
            n = 0
            for row, code in zip(rows + [None], [*reversed(codes), "I" * rows[-1]["inserts"]]):
                for edit in code:
                    out = {"conv_id": conv, "_part": part, "_step": n, "edit": edit}
                    n += 1
                    if edit == "K":
                        state = ALLOWED[row["_kind"] % 4][state]
                        out |= {c: row[c] for c in ("turn", "role", "text")}
                    elif edit != "D":
                        state = NEXT[state]
                        out |= {"role": ROLE[state]} | ({"text": ""} if edit == "I" else {c: row[c] for c in ("turn", "text")})
                    yield out

    return in_batches(each(), arrow(EDIT))


def kind(role: Column, text: Column, repeated: Column) -> Column:
    """What the program has to know of a turn: the initial of its role, and its first fault."""
    end = F.rtrim(text, F.lit(SPACE))
    fault = F.when(end == "", 2).when(repeated, 3).when(~F.right(end, F.lit(1)).isin(*ENDS), 1).otherwise(0)
    initial = F.left(role, F.lit(1))
    return 4 * fault + F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows of conv_id, turn, role and text: the edits in order of conv_id, _part and _step with the turns that
    they leave, and per conversation gaps, blank, duplicate, truncated, illegal and cost."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    same = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), same.alias("_same"), F.monotonically_increasing_id().alias("_id"))
    rows = materialize(rows, "turns")
    # the first of equal turns of a conversation is found by partial minima, and only what repeats is joined back
    first = rows.groupBy("conv_id", "_same").agg(F.count("*").alias("_times"), F.min(F.struct(F.col("turn").isNotNull(), "turn", "_id")).alias("_first"))
    first = first.where("_times > 1").select(F.col("conv_id").alias("_conv"), F.col("_same").alias("_as"), F.col("_first._id").alias("_first"))
    rows = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["_same"] == first["_as"]), "left")
    repeated = F.coalesce(F.col("_first") != F.col("_id"), F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "text", "_same", "_id", kind(F.col("role"), F.col("text"), repeated).alias("_kind"))
    by = ["conv_id", "turn", "_same", "_id"]
    rows = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop("_same", "_id")
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ranged-turns")
    rows = rows.withColumn("_part", F.shiftright("_at", 33).cast("int"))

    def by_range(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(spark), "_part").sortWithinPartitions("_at")

    found = by_range(rows.select("conv_id", "_part", "_at", "turn", "_kind")).mapInArrow(tables, TABLE)
    found = found.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "_part").mapInArrow(routes, ROUTE)
    found = materialize(found, "routes")
    route = found.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), "enter", "leave", "inserts")
    routed = rows.join(route, rows["conv_id"].eqNullSafe(route["_conv"]) & (rows["_part"] == route["_of"])).drop("_conv", "_of")
    return by_range(routed).mapInArrow(edits, EDIT), found.where("cost IS NOT NULL").select("conv_id", "gaps", *COUNTS, "cost")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, steps in groupby(rows, key=lambda r: r["conv_id"]):
            audit, sha, between = [], hashlib.sha256(), b""
            for row in steps:
                audit.append(row["edit"])
                if row["role"] is not None:
                    sha.update(between + f"{row['role']}:{row['text']}".encode())
                    between = b"\n"
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    return in_batches(each(), pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]), 100)


def audited(steps: DataFrame) -> DataFrame:
    """Per conversation: audit and repaired_sha256."""
    steps = steps.select("conv_id", "_part", "_step", "edit", "role", "text").repartition(partitions(steps.sparkSession), "conv_id")
    return steps.sortWithinPartitions("conv_id", "_part", "_step").mapInArrow(digests, "conv_id long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage of the contract."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    hit = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(spaced[3], "".join(ENDS), "")).otherwise(spaced[3])
    rows = conversations.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(spaced[2]).alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    steps, totals = repair(damaged(conversations))
    found = totals.join(audited(steps).withColumnRenamed("conv_id", "_of"), F.expr("conv_id <=> _of")).drop("_of")
    every = conversations.select(F.col("conv_id").alias("_every")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return every.join(found, F.expr("_every <=> conv_id"), "left").select(
        F.col("_every").alias("conv_id"),
        *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


SQL = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0),
marked AS (
  SELECT *, sha256(strlen(role) || ':' || role || text) AS same,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM damaged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same) AS i FROM marked),
turns AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, i,
    CASE WHEN t = '' THEN 'blank' WHEN min(i) OVER (PARTITION BY conv_id, same) < i THEN 'duplicate'
      WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered),
pairs AS (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM turns),
illegal AS (
  SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM turns GROUP BY conv_id),
inserts(p, q, ins, put) AS (VALUES
  ('e', 'e', '', ''), ('e', 'u', 'I', 'user:|'), ('e', 'a', 'II', 'user:|assistant:|'),
  ('s', 's', '', ''), ('s', 'u', 'I', 'user:|'), ('s', 'a', 'II', 'user:|assistant:|'),
  ('u', 'u', '', ''), ('u', 'a', 'I', 'assistant:|'), ('u', 'u', 'II', 'assistant:|user:|'),
  ('a', 'a', '', ''), ('a', 'u', 'I', 'user:|'), ('a', 'a', 'II', 'user:|assistant:|')),
nexts(q, initial, r) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
choices AS (
  SELECT p, r, initial, 'K' AS edit, ins || 'K' AS code, 2 * length(ins) AS cost, replace(put, '|', chr(10)) AS put
  FROM inserts JOIN nexts USING (q)
  UNION ALL
  SELECT p, r, NULL, 'R', ins || 'R', 2 * length(ins) + 2, replace(put, '|', chr(10)) FROM inserts JOIN nexts USING (q)
  WHERE initial <> 's'
  UNION ALL
  SELECT p, q, NULL, 'D', ins || 'D', 2 * length(ins) + 3, replace(put, '|', chr(10)) FROM inserts),
layers AS (
  SELECT conv_id, 0::BIGINT AS i, 'e' AS state, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM counted
  UNION ALL
  SELECT l.conv_id, l.i + 1, c.r, min({
    'cost': l.best.cost + c.cost + CASE WHEN t.fault = 'truncated' AND c.edit <> 'D' THEN 1 ELSE 0 END,
    'audit': l.best.audit || c.code,
    'made': l.best.made || c.put || CASE c.edit WHEN 'D' THEN '' WHEN 'K' THEN t.role || ':' || t.text || chr(10)
      ELSE CASE c.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text || chr(10) END})
  FROM layers l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1
  JOIN choices c ON c.p = l.state AND (c.edit <> 'K' OR c.initial = t.initial)
    AND (c.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
  GROUP BY l.conv_id, l.i, c.r),
ended AS (
  SELECT l.conv_id, min({'cost': best.cost + 2 * length(ins), 'audit': best.audit || ins, 'made': best.made || replace(put, '|', chr(10))}) AS best
  FROM layers l JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.n = l.i
  JOIN inserts ON p = state AND q IN ('e', 'a') GROUP BY l.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(left(e.best.made, greatest(length(e.best.made) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN illegal g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
