"""The status machine over any cut of its input, a queue with the oldest first, receivers from a table."""

import random
from datetime import datetime, timedelta

import pytest

from talus.streaming import timers

ALLOWED = {"pending": {"running", "dropped"}, "running": {"done", "failed"}, "failed": {"pending"}}
T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, cuts, name, forget=None):
    schema = "id long, ts timestamp, status string"
    (tmp_path / name).mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    found = timers.follow_in_order(stream, ALLOWED, "pending", {"running"}, 60_000, "30 minutes", forget)
    query = None
    for rows in [*cuts, [(-1, T0 + timedelta(days=9), "x")], [(-2, T0 + timedelta(days=9), "x")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        query = query or found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        query.processAllAvailable()
    query.stop()
    return sorted((r.id, (r.at - T0).total_seconds(), r.status, r.cause) for r in spark.table(name).collect() if r.id >= 0)


def drawn(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(4), T0 + timedelta(seconds=rng.randrange(900), microseconds=rng.choice([0, 1, 999_999])), rng.choice(["running", "done", "failed", "pending"])) for _ in range(n)]


def walked(rows):
    out = []
    for key in {r[0] for r in rows}:
        moves = [(round((t - T0).total_seconds() * 1_000_000), s) for k, t, s in rows if k == key]
        out += [(key, at / 1e6, s, c) for at, s, c in timers.walk("pending", 0, moves, 10**15, ALLOWED, "pending", {"running"}, 60_000_000)]
    return sorted(out)


def test_walk():
    got = list(timers.walk("pending", 0, [(5, "running"), (70, "done"), (71, "running")], 200, ALLOWED, "pending", {"running"}, 60))
    assert got == [(5, "running", "moved"), (65, "pending", "timeout"), (70, "pending", "refused"), (71, "running", "moved"), (131, "pending", "timeout")]


def test_one_batch_and_late_batches_give_the_same(rocks, tmp_path):
    rows = drawn(1, 40)
    whole = run(rocks, tmp_path, [rows], "whole")
    assert whole == walked(rows)
    mixed = rows[:]
    random.Random(2).shuffle(mixed)  # everything is at most 15 minutes late
    assert run(rocks, tmp_path, [mixed[:9], mixed[9:30], mixed[30:]], "parted") == whole


def test_a_key_is_forgotten(rocks, tmp_path):
    cuts = [[(1, T0, "running"), (1, T0 + timedelta(seconds=1), "done")], [(2, T0 + timedelta(hours=5), "running")], [(2, T0 + timedelta(hours=6), "x")], [(1, T0 + timedelta(hours=7), "running")]]
    got = run(rocks, tmp_path, cuts, "forgets", forget=3_600_000)
    assert [x[2:] for x in got if x[0] == 1] == [("running", "moved"), ("done", "moved"), ("running", "moved"), ("pending", "timeout")]


def test_oldest_rows_each_trigger_and_a_trigger_that_runs_again(spark, tmp_path):
    folder, taken = str(tmp_path / "queue"), {}
    fail = [1]

    def handle(rows, number):
        taken[number] = sorted(r.n for r in rows.collect())
        if number == 1 and fail:
            fail.pop()
            raise RuntimeError("lost")

    step = timers.oldest_each_trigger(3, ["n"], handle, folder)
    make = lambda *ns: spark.createDataFrame([(n, None) for n in ns], "n long, x string")
    step(make(9, 2, 2, 2, 5), 0)
    with pytest.raises(RuntimeError):
        step(make(1, 2), 1)
    step(make(1, 2), 1)
    step(make().where("false"), 2)
    step(make(0), 3)
    assert taken == {0: [2, 2, 2], 1: [1, 2, 5], 2: [9], 3: [0]}


def test_receivers_come_from_a_table(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b")], "user long, team string")
    messages = spark.createDataFrame([("m", "a"), ("n", "b"), ("o", "none")], "text string, team string")
    messages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    query = timers.fan_out_to(stream, users, "user", ["team"]).writeStream.format("memory").queryName("fanned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.text, r.user) for r in spark.table("fanned").collect()) == [("m", 1), ("m", 2), ("n", 3)]
