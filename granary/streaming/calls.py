"""The call-log lane: event-time spend, a running budget, and resuming from checkpoints."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.sources.scratch import scratch_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_spend(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and spend per hour of event time and type; state of hours past the watermark is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("spend")).select(F.col("w.start").alias("hour_start"), "event_type", "n", "spend")


def run_once(stream: DataFrame, name: str, mode: str = "update", path: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its last result per batch, written as a table by batch number.

    Batches are written by number, overwriting what a failed attempt left, so a
    restart from the checkpoint gives each batch once. Results and checkpoint
    stand under ``path`` (a fresh folder if none is given); a later run with the
    same path goes on where this one ended.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    out, state = f"{path}/out", f"{path}/state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def budget_stop(spark: SparkSession, calls: DataFrame, budget: float, path: str | None = None) -> tuple[float, int]:
    """Adds up spend batch by batch and stops the stream once it reaches ``budget``; (spent, batches).

    Under ``path`` (a fresh folder if none is given) stand the stream's own
    checkpoint and each batch's spend, written by batch number: a batch that is
    run again replaces its figure, and a restart goes on from what was spent.
    """
    path = path or scratch_path(spark, "budget")
    over = threading.Event()

    def spent_before(number: int) -> tuple[float, int]:
        if not number:
            return 0.0, 0
        r = spark.read.schema("spend double, batch long").parquet(f"{path}/spent").where(F.col("batch") < number).agg(F.coalesce(F.sum("spend"), F.lit(0.0)), F.count("*")).first()
        return r[0], r[1]

    def add(batch: DataFrame, number: int) -> None:
        before = spent_before(number)[0]
        if before >= budget:
            over.set()
            return
        batch.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("spend")).write.mode("overwrite").parquet(f"{path}/spent/batch={number}")
        if spent_before(number + 1)[0] >= budget:
            over.set()

    query = calls.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(0.2) and not over.is_set():
            pass
    finally:
        query.stop()
    if query.exception() is not None and not over.is_set():
        raise query.exception()
    return spent_before(1 << 60)
