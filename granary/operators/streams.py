"""Streaming queries: their results must equal those of the batch query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.catalog import Catalog, Tables
from granary.sources.scratch import scratch_path
from granary.streaming import calls, guard

CATALOG = Catalog()


def _log(spark: SparkSession, sf_dir: str, files: int = 4) -> tuple[str, DataFrame]:
    """The events as a log of several files in event-time order, and their frame."""
    events, path = Tables(spark, sf_dir).events, scratch_path(spark, "log")
    events.repartitionByRange(files, "ts").write.parquet(path)
    return path, events


@CATALOG.query("SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS spend FROM events GROUP BY ALL")
def hourly_spend_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows with a watermark over a file stream; the log is in time order across files, so nothing is late."""
    path, events = _log(spark, sf_dir)
    stream = calls.event_stream(spark, path, events.schema, files_per_batch=4)
    updates = calls.run_once(calls.hourly_spend(stream), "hourly")
    return calls.latest(updates, ["hour_start", "event_type"]).select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "event_type", "n", F.round("spend", 4).alias("spend"))


@CATALOG.query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def user_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals per user across micro-batches."""
    path, events = _log(spark, sf_dir)
    stream = calls.event_stream(spark, path, events.schema, files_per_batch=2)
    totals = stream.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return calls.latest(calls.run_once(totals, "users"), ["user_id"])


@CATALOG.query()
def budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend at which a budgeted stream stopped, and after how many batches."""
    path, events = _log(spark, sf_dir)
    spent, n = calls.budget_stop(spark, calls.event_stream(spark, path, events.schema), 0.4 * events.agg(F.sum("value")).first()[0])
    return spark.createDataFrame([(round(spent, 4), n)], "spent double, batches int")


@CATALOG.query("SELECT event_id, user_id, value FROM events")
def sharded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a table, written apart, merged to the original order."""
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", "value")
    path = scratch_path(spark, "shards")
    e.withColumn("shard", F.pmod("event_id", F.lit(4))).write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).drop("shard").orderBy("event_id")


@CATALOG.query(
    """
    WITH e AS (SELECT user_id AS key, event_id AS call_id, event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS cost,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
    r AS (SELECT *, CASE WHEN failed THEN row_number() OVER (PARTITION BY key, failed, island ORDER BY k) ELSE 0 END AS run, sum(cost) OVER (PARTITION BY key ORDER BY k) AS total FROM e),
    s AS (SELECT *, coalesce(max(run) OVER w, 0) >= 3 AS by_errors, coalesce(max(total) OVER w, 0) >= 100000 AS by_budget FROM r WINDOW w AS (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT key, min(CASE WHEN by_errors THEN k END) AS ke, min(CASE WHEN by_budget THEN k END) AS kb FROM s GROUP BY key),
    m AS (SELECT s.*, CASE WHEN k >= ke AND ke <= coalesce(kb, ke) THEN 'errors' WHEN k >= kb AND kb < coalesce(ke, kb + 1) THEN 'budget' END AS reason FROM s JOIN f USING (key))
    SELECT key, call_id, CAST(max(CASE WHEN reason IS NULL THEN total END) OVER w AS BIGINT) AS spent, reason FROM m WINDOW w AS (PARTITION BY key ORDER BY k)
    """
)
def guarded_calls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user until 1,000.00 are spent or three in a row fail; later ones carry the reason why they are not admitted."""
    e = Tables(spark, sf_dir).events
    failed = F.col("event_type") == "error"
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("at"), F.when(failed, 0).otherwise(F.round(F.col("value") * 100)).cast("long").alias("cost"), failed.alias("failed"))
    path = scratch_path(spark, "guard")
    log.repartitionByRange(3, "at").sortWithinPartitions("at").write.parquet(f"{path}/log")
    guard.flush_row(log).write.mode("append").parquet(f"{path}/log")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", guard.STORE)
    try:
        judged = calls.run_once(guard.guarded(calls.event_stream(spark, f"{path}/log", log.schema, files_per_batch=2), 100000, 3), "guarded", mode="append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return judged.where("key >= 0").select("key", "call_id", "spent", "reason")
