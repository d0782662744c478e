"""A guard over call logs: per key, calls are admitted until a budget is spent or too many fail in a row.

State of any shape is kept by key with ``transformWithStateInPandas``: money spent,
errors in a row, why the key stopped, and the calls that wait. Calls may come
out of order within the watermark: they wait in state, a timer in event time is set, and
when it fires those that can't be overtaken any more are judged in order of
time. State is in the state store's checkpoint, so a restart goes on with the
call after the last one judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key long, call_id long, at timestamp, spent long, errors int, reason string"


class Guard(StatefulProcessor):
    """Judges each key's calls (call_id, at, cost, failed) in order of (at, call_id)."""

    def __init__(self, budget: int, errors: int):
        self.budget, self.errors = budget, errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "spent long, errors int, reason string")
        self.waiting = handle.getListState("waiting", "call_id long, micros long, cost long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            calls = list(zip(batch["call_id"].tolist(), micros.tolist(), batch["cost"].tolist(), batch["failed"].tolist(), strict=True))
            self.waiting.appendList(calls)
            latest = max([latest, *(c[1] for c in calls)])
        # Fires once the watermark has passed the latest of them, in whole milliseconds.
        self.handle.registerTimer(latest // 1000 + 1)
        yield pd.DataFrame(columns=["key", "call_id", "at", "spent", "errors", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ripe = timerValues.getCurrentWatermarkInMs() * 1000
        calls = sorted(self.waiting.get(), key=lambda c: (c[1], c[0])) if self.waiting.exists() else []
        now, later = [c for c in calls if c[1] < ripe], [tuple(c) for c in calls if c[1] >= ripe]
        spent, errors, reason = self.seen.get() if self.seen.exists() else (0, 0, None)
        out = []
        for call_id, micros, cost, failed in now:
            reason = reason or ("errors" if errors >= self.errors else "budget" if spent >= self.budget else None)
            if reason is None:
                spent, errors = (spent, errors + 1) if failed else (spent + cost, 0)
            out.append((key[0], call_id, pd.Timestamp(micros, unit="us"), spent, errors, reason))
        if now:
            self.seen.update((spent, errors, reason))
        if later:
            self.waiting.put(later)
        elif calls:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "call_id", "at", "spent", "errors", "reason"])

    def close(self) -> None:
        pass


def guarded(calls: DataFrame, budget: int, errors: int, late: str = "1 hour") -> DataFrame:
    """Every call of calls(key, call_id, at timestamp, cost in cents, failed) once it is judged: what is spent, errors in a row, and ``reason``, null if it was admitted.

    The session's state store must be ``STORE``, which holds state of several variables and timers.
    """
    timed = calls.select("key", "call_id", "at", "cost", "failed").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Guard(budget, errors), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def flush_row(calls: DataFrame, days: int = 2) -> DataFrame:
    """One more call, by key -1, long after all others: it moves the watermark past them, which ends a log."""
    after = calls.agg((F.max("at") + F.make_interval(days=F.lit(days))).alias("at"))
    return after.select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("call_id"), "at", F.lit(0).cast("long").alias("cost"), F.lit(False).alias("failed"))
