"""Activity sessions of users: the same plan over a batch table and over a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import micros

BEAT = "heartbeat"  # a column that marks rows which only move the watermark


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "user_id", time: str = "ts", event_id: str = "event_id", value: str = "value") -> DataFrame:
    """(key, started, ended, n, total): runs of a user's events in which each comes within ``gap`` of the one before; ``ended`` is the last event's time.

    Over a stream, an event that arrives more than ``delay`` behind the newest is dropped, an event id that arrives again within ``delay`` counts once, and a session comes out when the
    watermark has passed its end. Over a batch every event counts and repeated ids count once. Events without a time are left out; those without a key are sessions of their own key.
    Rows whose ``heartbeat`` is true (if there is such a column) move the watermark and are in no session.
    """
    x = events.where(F.col(time).isNotNull())
    beat = F.coalesce(F.col(BEAT), F.lit(False)) if BEAT in events.columns else F.lit(False)
    x = x.select(F.col(event_id).alias("id"), F.col(time).cast("timestamp").alias("at"), F.col(key).alias("key"), F.col(value).alias("value"), beat.alias("beat"))
    x = x.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else x.dropDuplicates(["id"])
    run = x.groupBy(F.session_window("at", gap).alias("w"), "key", "beat").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return run.where("NOT beat").select(F.col("key").alias(key), "started", "ended", "n", "total")


def start(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, files_a_batch: int = 2, **options):
    """A stream from the files of ``landing`` to Parquet at ``out`` that takes what is there and stops; started again on its checkpoint it goes on from there."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(landing)
    return sessions(source, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def close(spark: SparkSession, landing: str, schema, time: str = "ts", days: int = 2) -> None:
    """Append a heartbeat ``days`` after the newest event of ``landing``, so that the next start lets every open session out."""
    rows = spark.read.schema(schema).parquet(landing)
    last = rows.agg((F.max(time) + F.make_dt_interval(F.lit(days))).alias(time)).withColumn(BEAT, F.lit(True))
    columns = [F.col(f.name) if f.name in last.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    last.select(*columns).coalesce(1).write.mode("append").parquet(landing)


def streamed(events: DataFrame, folder: str, slices: int = 5, **options) -> DataFrame:
    """Sessions of a table fed to the stream in ``slices`` of time, with a start after some of them and one after closing."""
    spark = events.sparkSession
    events = events.withColumn(BEAT, F.lit(False))
    landing, out, checkpoint = (f"{folder}/{n}" for n in ("landing", "sessions", "checkpoint"))
    low, high = events.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    if low is None:
        return sessions(events, **options)
    width = (high - low) // slices + 1
    for k in range(slices):  # one after another, as files are taken in the order of their times
        part = events.where((micros("ts") >= low + k * width) & (micros("ts") < low + (k + 1) * width))
        part.coalesce(1 if slices > 1 else 8).write.mode("append").parquet(landing)
        if k % 2:
            start(spark, landing, events.schema, out, checkpoint, **options).awaitTermination()
    close(spark, landing, events.schema)
    start(spark, landing, events.schema, out, checkpoint, **options).awaitTermination()
    return spark.read.parquet(out)


__all__ = ["close", "sessions", "start", "streamed"]
