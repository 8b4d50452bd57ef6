"""Streaming sources, telemetry ingest and heartbeats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorlake.sources.ledger import Ledger
from sensorlake.sources.telemetry import parse_messages

# Fixed value: the flush interval of the ingest.
FLUSH_INTERVAL = "30 seconds"


def stream_table(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """File stream over a Parquet table that is one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    first = spark.read.parquet(path).inputFiles()[0]
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if first.rstrip("/").endswith("/" + os.path.basename(path.rstrip("/"))):
        # A single file: stream its folder, restricted to that name.
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path)


def _start(writer, available_now: bool, interval: str) -> StreamingQuery:
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


# Equal keys of one batch that arrived together differ in content only; the greatest stays, whole.
RECORD_KEYS, RECORD_ORDER = ["ts", "node_id"], ["temp", "humidity", "co2", "tvoc"]


def telemetry_table(spark: SparkSession, path: str) -> Ledger:
    """The table that ``ingest_telemetry`` fills."""
    return Ledger(spark, path, RECORD_KEYS, RECORD_ORDER)


def ingest_telemetry(
    messages: DataFrame,
    devices: DataFrame,
    table: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
    heartbeat_table: str | None = None,
    stream: str | None = None,
) -> StreamingQuery:
    """Parses device messages and upserts them by ``(ts, node_id)`` into the ledger at ``table``.

    A batch costs what it holds: it becomes one delta. A batch that is replayed after a failure, at
    whatever point, is committed once: batches are known by ``stream``, the checkpoint if not given.
    Deltas are merged as they become many.
    With ``heartbeat_table`` every batch leaves its heartbeat after the upsert.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        records = parse_messages(batch, devices)
        ledger = telemetry_table(batch.sparkSession, table)
        ledger.upsert(records, stream or checkpoint, batch_id)
        ledger.compact()
        if heartbeat_table:
            write_heartbeat(records, batch_id, heartbeat_table)

    writer = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, interval)


def write_heartbeat(batch: DataFrame, batch_id: int, table: str, ts: str = "ts") -> None:
    """Appends one row for the micro-batch to the table ``batch_id, n_rows, last_us, status``.

    A batch's row has a folder of its own, so a replayed batch replaces its row. Batches without
    rows leave none.
    """
    batch.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("last_us"),
        F.lit("ok").alias("status"),
    ).filter("n_rows > 0").coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def log_heartbeats(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    ts: str = "ts",
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Stream that records every micro-batch of ``rows`` in the heartbeat table."""
    writer = rows.writeStream.foreachBatch(
        lambda batch, batch_id: write_heartbeat(batch, batch_id, table, ts)
    ).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, interval)


def heartbeats(spark: SparkSession, table: str) -> DataFrame:
    """One row per micro-batch that had data, however many there were."""
    schema = "n_rows bigint, last_us bigint, status string, batch_id bigint"
    return spark.read.schema(schema).parquet(table).select("batch_id", "n_rows", "last_us", "status")
