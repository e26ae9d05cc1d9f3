"""Structured Streaming: idempotent intake, windowed counts, a status machine with timeouts, and the upkeep of a queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def once_each(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: a request that comes twice is taken once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def follow_status(events: DataFrame, allowed: dict[str, set[str]], start: str, waiting: set[str], timeout_ms: int) -> DataFrame:
    """(id, ts, status) to the statuses taken: one row for each event or timeout.

    ``allowed`` holds the statuses that may follow each one, the first is ``start``. A key that stays in one of ``waiting``
    for ``timeout_ms`` goes back to ``start``. All rows that a key has in one trigger are taken in the order of time, so the
    trigger's intake bounds what a key holds in memory.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((start,))
            yield pd.DataFrame({"id": [key[0]], "status": [start], "valid": [True]})
            return
        now = state.get[0] if state.exists else start
        rows = pd.concat([b[["ts", "status"]] for b in batches]).sort_values(["ts", "status"], kind="stable")
        taken = []
        for status in rows["status"]:
            valid = status in allowed.get(now, set())
            now = status if valid else now
            taken.append((key[0], now, valid))
        state.update((now,))
        if now in waiting:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(taken, columns=["id", "status", "valid"])

    return events.groupBy("id").applyInPandasWithState(
        step, "id long, status string, valid boolean", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def oldest_first(pending: DataFrame, most: int, *order: str) -> DataFrame:
    """What one trigger takes up: the oldest runnable rows."""
    return pending.orderBy(*order).limit(most)


def requeued(rows: DataFrame, where: Column, status: str, start: str, reset: list[str]) -> DataFrame:
    """Rows that ``where`` picks go back to ``start``, and what was derived for them is emptied."""
    hit = F.coalesce(where, F.lit(False))
    empty = {c: F.when(~hit, F.col(c)) for c in reset}
    return rows.withColumns({status: F.when(hit, F.lit(start)).otherwise(F.col(status))} | empty)


def stale(ts: str, as_of: Column, seconds: int) -> Column:
    """Whether a row has not moved for longer than ``seconds``."""
    return F.unix_timestamp(as_of) - F.unix_timestamp(ts) > seconds


def half_queued(requests: DataFrame, jobs: DataFrame, key: str, ts: str, as_of: Column, seconds: int) -> DataFrame:
    """Requests that are older than ``seconds`` and have no job: what a recovery queues again."""
    return requests.where(stale(ts, as_of, seconds)).join(jobs.select(key), key, "left_anti")


def with_retries(failures: DataFrame, code: str, tries: str, transient: list[int], most: int = 1) -> DataFrame:
    """Whether a failed row is tried again: only for transient codes and server errors, and at most ``most`` times."""
    again = (F.col(code).isin(transient) | F.col(code).between(500, 599)) & (F.coalesce(F.col(tries), F.lit(0)) < most)
    return failures.withColumn("retry", F.coalesce(again, F.lit(False)))


def unexpired(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """What a deletion by age leaves."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))))


def derived_events(changes: DataFrame, status: str, names: dict[str, str], default: str = "updated") -> DataFrame:
    """A log of what status changes mean, one row for each change to another status."""
    kinds = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    changed = changes.where(~F.col(status).eqNullSafe(F.col(f"old_{status}")))
    return changed.withColumn("action", F.coalesce(kinds[F.col(status)], F.lit(default)))


def archived(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """All rows, with ``current`` true for the last of each key; the others are its archive."""
    latest = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
    joined = rows.join(latest, key)
    return joined.withColumn("current", F.struct(*order) == F.col("_last")).drop("_last")


def fan_out(messages: DataFrame, users: list[str]) -> DataFrame:
    """A row for each message and each of a given list of receivers."""
    return messages.withColumn("receiver", F.explode(F.array(*map(F.lit, users))))
