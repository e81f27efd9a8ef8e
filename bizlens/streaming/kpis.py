"""Structured Streaming operators W2-W4.

Sources are file streams over the driver's Parquet tables (``pathGlobFilter``
picks one table out of a folder), sinks are Parquet tables with their own
checkpoint location in the shared checkpoint folder, so a restarted query
resumes where it stopped. ``run_available`` drives a query with the
``availableNow`` trigger (everything present, then stop) and reads the
sink back as a batch DataFrame.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.session import checkpoint_dir, utc_session

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, *,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``<folder>/<name>.parquet`` (and later files of that name pattern)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def event_stream(spark: SparkSession, folder: str, **kw) -> DataFrame:
    """Events with ``ts`` as a ``timestamp`` (watermarks need it). Build it inside
    ``session.utc_session`` to read the stored wall-clock times as UTC."""
    s = table_stream(spark, folder, "events", EVENTS_SCHEMA, **kw)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _scratch(spark: SparkSession, kind: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", f"{kind}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def run_available(df: DataFrame, *, kind: str, mode: str = "append", out: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to a Parquet sink with the availableNow trigger; return the sink."""
    spark = df.sparkSession
    o, c = _scratch(spark, kind)
    out, checkpoint = out or o, checkpoint or c
    with utc_session(spark):
        q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
    return spark.read.parquet(out)


def windowed_kpis(events: DataFrame, *, window: str = "1 day", slide: str | None = None,
                  watermark: str = "1 day", by: Sequence[str] = ("event_type",),
                  session_gap: str | None = None) -> DataFrame:
    """Event count and value sum per tumbling / sliding / session window.

    Append mode emits a window once the watermark (max event time seen minus
    ``watermark``) passes its end, so every emitted row is final.
    """
    w = F.session_window("ts", session_gap) if session_gap else (
        F.window("ts", window, slide) if slide else F.window("ts", window))
    g = (events.withWatermark("ts", watermark).groupBy(w.alias("w"), *[F.col(b) for b in by])
         .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum")))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[F.col(b) for b in by],
                    "events", "value_sum")


def stream_anomalies(events: DataFrame, baseline: DataFrame, *, key: str = "event_type",
                     value: str = "value", threshold: float = 2.0) -> DataFrame:
    """Z-score of every streamed value against a static per-key baseline
    (mean, sample deviation; one row per key)."""
    stats = baseline.groupBy(key).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    j = events.join(stats, key)
    z = (F.col(value) - F.col("_mu")) / F.col("_sd")
    return j.filter((F.col("_sd") > 0) & (F.abs(z) > threshold)).select(
        "event_id", key, F.col("ts").cast("timestamp_ntz").alias("ts"), value, F.round(z, 4).alias("z_score"))


def drift_per_batch(events: DataFrame, baseline: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (),
                    out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """For each micro-batch, drift (G1) against the baseline, written to the batch's own
    partition of a Parquet table, so a replayed batch replaces its rows.

    The baseline's values and counts are stored once, range-partitioned; a batch merges its
    own counts with them and does not read the baseline again."""
    from bizlens.operators.drift import drift_from_baseline, store_baseline
    spark = events.sparkSession
    o, c = _scratch(spark, "drift")
    out, checkpoint = out or o, checkpoint or c
    stored = f"{checkpoint}-baseline"
    with utc_session(spark):
        store_baseline(baseline, columns, stored, by=by)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        drift_from_baseline(stored, batch, columns, by=by).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with utc_session(spark):
        q = (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)
