"""Windowed means and snapshots over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorlake.operators.alerts import score_breaches
from sensorlake.sources.ledger import Ledger

KEYS = ["node", "metric"]


def _timed(readings: DataFrame, late: str) -> DataFrame:
    # Watermarks need an instant, not a zone-less label.
    return readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_means(readings: DataFrame, width: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean per channel and window; a window is emitted once the watermark has passed it."""
    return (
        _timed(readings, late)
        .groupBy(F.window("ts", width).alias("w"), *KEYS)
        .agg(F.avg("value").alias("value"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("ts"), *KEYS, "value")
    )


def means_table(spark: SparkSession, path: str) -> Ledger:
    """The table that ``amend_means`` keeps: ``ts, node, metric, value, n``."""
    return Ledger(spark, path, ["ts", *KEYS])


def amend_means(
    readings: DataFrame,
    table: str,
    checkpoint: str,
    width: str = "30 minutes",
    late: str = "1 day",
) -> StreamingQuery:
    """Means per channel and window that are there at once and follow late readings.

    A micro-batch emits the windows it changed, and the table takes them over its earlier rows. A
    reading up to ``late`` behind the newest one changes its window's mean; a window's sums are held
    that long. Replayed batches are committed once. Windows without a known value have a null mean.
    """
    means = (
        _timed(readings, late)
        .groupBy(F.window("ts", width).alias("w"), *KEYS)
        .agg(F.avg("value").alias("value"), F.count("value").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("ts"), *KEYS, "value", "n")
    )

    def amend(batch: DataFrame, batch_id: int) -> None:
        ledger = means_table(batch.sparkSession, table)
        ledger.upsert(batch, checkpoint, batch_id)
        ledger.compact()

    writer = means.writeStream.outputMode("update").foreachBatch(amend)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_snapshots(readings: DataFrame, thresholds: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Last reading of each channel per hour, with its breach direction."""
    last = (
        _timed(readings.filter(F.col("value").isNotNull()), late)
        .groupBy(F.window("ts", "1 hour").alias("w"), *KEYS)
        .agg(F.max_by("value", "ts").alias("value"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), *KEYS, "value")
    )
    return score_breaches(last, thresholds).select("hour", *KEYS, "value", "direction")
