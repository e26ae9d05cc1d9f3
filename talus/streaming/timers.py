"""Streams with state and event-time timers: a status machine whose result does not depend on how its input is cut into
triggers, and a queue of which each trigger takes the oldest rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of a millisecond, the unit of timers.
MS = 1000


def walk(status: str, since: int, moves: Iterable[tuple[int, str]], until: int, allowed: dict[str, set[str]], start: str, waiting: set[str], timeout: int) -> Iterator[tuple[int, str, str]]:
    """(time, status, cause) for each move in order and each time that a waiting status runs out, up to ``until``.

    A cause is moved, refused (the status stays) or timeout. What runs out at the time of a move runs out first. Times are
    microseconds.
    """
    for at, to in [*sorted(moves), (until, None)]:
        if status in waiting and since + timeout <= at:
            status, since = start, since + timeout
            yield since, status, "timeout"
        if to is None:
            continue
        if to in allowed.get(status, ()):
            status, since = to, at
            yield at, status, "moved"
        else:
            yield at, status, "refused"


class StatusMachine(StatefulProcessor):
    """Moves of a key wait in a list until the watermark has passed them; timers of event time then take them in order."""

    def __init__(self, allowed: dict[str, set[str]], start: str, waiting: set[str], timeout_ms: int, forget_ms: int | None):
        self.rules = (allowed, start, waiting, timeout_ms * MS)
        self.start, self.waiting, self.forget = start, waiting, forget_ms and forget_ms * MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moves = handle.getListState("moves", "at long, status string")
        self.now = handle.getValueState("now", "status string, since long, seen long")

    def timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // MS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["_at"], r["status"]) for r in rows]
        self.moves.appendList(new)
        for at in {at for at, _ in new}:
            self.timer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() * MS
        held = [tuple(x) for x in self.moves.get()]
        due = [x for x in held if x[0] <= until]
        status, since, seen = self.now.get() if self.now.exists() else (self.start, 0, 0)
        out = []
        for at, to, cause in walk(status, since, due, until, *self.rules):
            since = since if cause == "refused" else at
            status, seen = to, max(seen, at)
            out.append(Row(id=key[0], at=at, status=status, cause=cause))
        rest = [x for x in held if x[0] > until]
        if due:
            self.moves.clear()
            if rest:
                self.moves.appendList(rest)
        if self.forget and status not in self.waiting and not rest and seen + self.forget <= until:
            self.now.clear()
        elif out:
            self.now.update((status, since, seen))
            if status in self.waiting:
                self.timer(since + self.rules[3])
            elif self.forget:
                self.timer(seen + self.forget)
        return iter(out)


def follow_in_order(events: DataFrame, allowed: dict[str, set[str]], start: str, waiting: set[str], timeout_ms: int, late: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """(id, ts, status) to id, at, status, cause: every move and timeout of a key in order of event time.

    ``allowed`` holds the statuses that may follow each one, the first is ``start``. Rows come out when the watermark has
    passed them, so any cut of the input into triggers, and any order in which rows are at most ``late``, gives the same. A key that
    does not wait is forgotten ``forget_ms`` after its last move, and begins anew. The session's state store must be that of
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.withWatermark("ts", late).withColumn("_at", F.unix_micros("ts"))
    machine = StatusMachine(allowed, start, waiting, timeout_ms, forget_ms)
    found = rows.groupBy("id").transformWithState(machine, "id long, at long, status string, cause string", "Append", "EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def oldest_each_trigger(most: int, order: list[str], handle: Callable[[DataFrame, int], None], folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each trigger takes the ``most`` oldest of what waits and what came in, and keeps the rest in ``folder``.

    What waits after a trigger is a folder of its number, written whole before the next one begins; a trigger that is run again reads
    the folder before it and writes its own anew, so no row is lost or taken twice. ``handle`` gets the rows and the number of the
    trigger, by which it can tell that it runs again. Folders older than the last two are deleted.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _last_before(spark, folder, number)
        waiting = batch if before is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/{before}"))
        waiting = waiting.withColumn("_tie", F.xxhash64(*batch.columns))
        waiting.write.mode("overwrite").parquet(f"{folder}/all-{number}")
        waiting = spark.read.schema(waiting.schema).parquet(f"{folder}/all-{number}")
        # equal rows stand for each other: the number that is taken of each is what the limit leaves
        first = waiting.orderBy(*order, "_tie").limit(most)
        handle(first.drop("_tie"), number)
        waiting.drop("_tie").exceptAll(first.drop("_tie")).write.mode("overwrite").parquet(f"{folder}/{number}")
        for old in range(max(0, number - 5), number - 1):
            _delete(spark, f"{folder}/{old}")
        _delete(spark, f"{folder}/all-{number}")

    return run


def _last_before(spark: SparkSession, folder: str, number: int) -> int | None:
    """The last trigger before ``number`` that has left a whole folder."""
    for k in range(number - 1, max(-1, number - 6), -1):
        if _fs(spark, f"{folder}/{k}/_SUCCESS", lambda fs, path: fs.exists(path)):
            return k
    return None


def _fs(spark: SparkSession, path: str, act: Callable):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return act(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where)


def _delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path, lambda fs, where: fs.delete(where, True))


def fan_out_to(messages: DataFrame, users: DataFrame, receiver: str, on: list[str]) -> DataFrame:
    """A row for each message and each user of its group: ``users`` is a table, read anew in each trigger of a stream.

    ``on`` names the columns that a message and its receivers share (a role, a team); a message without a receiver has no row.
    """
    return messages.join(users.select(receiver, *on).distinct(), on)
