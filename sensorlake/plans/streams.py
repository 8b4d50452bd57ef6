"""Streaming jobs over the event table, run until all of it is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.plans.base import (
    EVENT_TYPES,
    METRIC_CASE,
    NODE_CASE,
    NOTICES,
    READINGS,
    VALUE_CASE,
    query,
    scored_sql,
)
from sensorlake.plans.ingest import RECORDS, messages
from sensorlake.session import work_dir
from sensorlake.streaming import alerts, ingest, windows

KEYS = ["node", "metric"]


def events(spark, d):
    return ingest.stream_table(spark, f"{d}/events.parquet")


def live_readings(spark, d):
    return events(spark, d).filter(F.col("event_type").isin(EVENT_TYPES)).select(
        "ts",
        F.expr(NODE_CASE).alias("node"),
        F.expr(METRIC_CASE).alias("metric"),
        F.expr(VALUE_CASE).alias("value"),
    )


def drained(spark, stream):
    """Runs a stream over what there is now, into a table."""
    path = work_dir(spark)
    query_ = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", work_dir(spark))
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query_


@query(
    "h01_stream_telemetry_upsert",
    f"""WITH {RECORDS}
    SELECT epoch_us(ts) AS ts_us, node_id, round(temp, 6) AS temp, round(humidity, 6) AS humidity,
      co2, tvoc FROM records""",
)
def _(spark, d):
    path = work_dir(spark)
    stream = ingest.ingest_telemetry(
        messages(events(spark, d)), schema.devices(spark), path, work_dir(spark), available_now=True
    )
    stream.awaitTermination()
    return ingest.telemetry_table(spark, path).read()


@query(
    "h02_stream_notifications",
    f"""WITH RECURSIVE {NOTICES}
    SELECT node, metric, at_us, round(value, 6) AS value, round(severity, 6) AS severity,
      direction, reason, kind FROM notices
    WHERE at_us <= (SELECT epoch_ms(max(ts)) * 1000 FROM readings) - 10 * 60 * 1000000""",
)
def _(spark, d):
    notices = alerts.stream_notifications(live_readings(spark, d), schema.thresholds(spark))
    return drained(spark, notices)[0]


CLOSED = "<= (SELECT max(ts) FROM {source}) - INTERVAL 10 MINUTE"


@query(
    "h06_stream_half_hour_means",
    f"""WITH {READINGS}
    SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) AS ts_us, node, metric,
      round(avg(value), 6) AS value FROM readings
    WHERE time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE {CLOSED.format(source="readings")}
    GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return drained(spark, windows.windowed_means(live_readings(spark, d)))[0]


@query(
    "h06_stream_amended_means",
    f"""WITH {READINGS}
    SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) AS ts_us, node, metric,
      round(avg(value), 6) AS value, count(value) AS n FROM readings GROUP BY 1, 2, 3""",
)
def _(spark, d):
    table = work_dir(spark)
    windows.amend_means(live_readings(spark, d), table, work_dir(spark)).awaitTermination()
    return windows.means_table(spark, table).read()


@query(
    "h06_stream_hourly_snapshots",
    f"""WITH {READINGS}, known AS (SELECT * FROM readings WHERE value IS NOT NULL), last AS (
      SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, node, metric, arg_max(value, ts) AS value
      FROM known GROUP BY 1, 2, 3
      HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR {CLOSED.format(source="known")}),
    {scored_sql("last")}
    SELECT epoch_us(hour) AS hour_us, node, metric, round(value, 6) AS value, direction FROM breach""",
)
def _(spark, d):
    snapshots = windows.windowed_snapshots(live_readings(spark, d), schema.thresholds(spark))
    return drained(spark, snapshots)[0]


@query(
    "h07_heartbeats",
    f"""WITH {READINGS}
    SELECT CAST(sum(1) AS BIGINT) AS n_rows, epoch_us(max(ts)) AS last_us, 'ok' AS status
    FROM readings""",
)
def _(spark, d):
    table = work_dir(spark)
    ingest.log_heartbeats(
        live_readings(spark, d), table, work_dir(spark), available_now=True
    ).awaitTermination()
    return ingest.heartbeats(spark, table).groupBy("status").agg(
        F.sum("n_rows").alias("n_rows"), F.max("last_us").alias("last_us")
    )
