"""Structured Streaming operators: window aggregates, beat verification, beat gaps, growing windows and triage.

Each has a batch twin: the same function works on a bounded DataFrame (a watermark is then without effect), so tests
hold the stream's output against the batch result up to the final watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream: record_id, channel, ts, x."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    return as_events(rows)


def as_events(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.col("user_id").alias("record_id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


def stream_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Tumbling windows per record and channel: count, mean, span. Rows behind the watermark are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "record_id", "channel")
    return g.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("span")).select("record_id", "channel", F.col("window.start").alias("start"), "n", "mean", "span")


def stream_growing(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """The tail window of each record, evaluated anew at every step as samples arrive."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "record_id")
    return g.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).select("record_id", F.col("window.end").alias("end"), "n", "mean")


def stream_verify(events: DataFrame, beat: str, pulse: str, low: str, high: str, late: str, how: str = "leftOuter") -> DataFrame:
    """Beats with the pulses that follow within [low, high]; the outer form flags beats that none confirmed."""
    beats = events.where(F.col("channel") == beat).select("record_id", F.col("event_id").alias("beat"), F.col("ts").alias("t")).withWatermark("t", late)
    pulses = events.where(F.col("channel") == pulse).select(F.col("record_id").alias("r2"), F.col("event_id").alias("pulse"), F.col("ts").alias("t2")).withWatermark("t2", late)
    on = (F.col("record_id") == F.col("r2")) & (F.col("t2") >= F.col("t") + F.expr(f"interval {low}")) & (F.col("t2") <= F.col("t") + F.expr(f"interval {high}"))
    return beats.join(pulses, on, how).select("record_id", "beat", "t", "pulse", "t2")


def stream_beat_gap(events: DataFrame, beat: str, gap: str, late: str) -> DataFrame:
    """Sessions of beats; a silence of more than the gap closes one."""
    g = events.where(F.col("channel") == beat).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "record_id")
    return g.agg(F.count("*").alias("beats")).select("record_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "beats")


def stream_triage(events: DataFrame, thresholds: DataFrame, prob) -> DataFrame:
    """Stateless: every event is scored and banded against a static threshold table (channel, t_low)."""
    rows = events.withColumn("prob", prob).join(F.broadcast(thresholds), "channel", "left")
    band = F.when(F.col("t_low").isNull(), "high").when(F.col("prob") < F.col("t_low"), "suppress").when(F.col("prob") >= F.greatest(F.lit(0.5), "t_low"), "high").otherwise("defer")
    return rows.select("event_id", "record_id", "channel", "prob", band.alias("band"))
