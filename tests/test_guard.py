"""The guard over call logs against a plain loop, out of order and across a restart."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from granary.streaming import calls, guard

SCHEMA = "key long, call_id long, at timestamp, cost long, failed boolean"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, guard.STORE)
    yield
    spark.conf.set(name, before)


def plain(rows, budget, errors):
    out, state = {}, {}
    for key, call, _, cost, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        spent, run, why = state.get(key, (0, 0, None))
        why = why or ("errors" if run >= errors else "budget" if spent >= budget else None)
        if why is None:
            spent, run = (spent, run + 1) if failed else (spent + cost, 0)
        state[key] = spent, run, why
        out[key, call] = spent, run, why
    return out


def test_out_of_order_and_restart(spark, store, tmp_path):
    rng = np.random.default_rng(4)
    start = datetime(2024, 1, 1)
    rows = [(int(rng.integers(5)), i, start + timedelta(minutes=int(i + rng.integers(-20, 20))), int(rng.integers(1, 50)), bool(rng.random() < 0.45)) for i in range(400)]
    rows += [(9, 1000 + i, start + timedelta(minutes=i), 1, i % 2 == 0 or i > 100) for i in range(150)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2] + timedelta(minutes=int(rng.integers(0, 30))), i))
    parts, log = [order[:180], order[180:330], order[330:]], f"file://{tmp_path}/log"
    spark.createDataFrame([], SCHEMA).write.parquet(log)
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(log)
        if k == 2:
            guard.flush_row(spark.createDataFrame(rows, SCHEMA)).write.mode("append").parquet(log)
        # Each run is a restart: a query of its own that goes on from the checkpoint.
        judged = calls.run_once(guard.guarded(calls.event_stream(spark, log, SCHEMA), 900, 5), "guard", mode="append", path=f"file://{tmp_path}/run")
    got = {(r["key"], r["call_id"]): (r["spent"], r["errors"], r["reason"]) for r in judged.where("key >= 0").collect()}
    want = plain(rows, 900, 5)
    assert got == want and judged.where("key >= 0").count() == len(rows)
    assert {w for *_, w in want.values()} == {None, "budget", "errors"}
