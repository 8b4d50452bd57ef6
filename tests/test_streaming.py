import datetime as dt
import random

import pytest
from conftest import at, make_readings

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.operators import alerts, series
from sensorlake.streaming import alerts as stream_alerts
from sensorlake.streaming import ingest, windows

KEYS = ["node", "metric"]


@pytest.fixture
def landed(spark, tmp_path):
    """Writes batches of readings as separate files, oldest first, and streams them one by one."""

    def land(batches):
        for i, rows in enumerate(batches):
            make_readings(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        schema_ = make_readings(spark, batches[0][:1]).schema
        return (
            spark.readStream.schema(schema_).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        )

    return land


def drain(spark, stream, tmp_path, name="out"):
    out = str(tmp_path / name)
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def alert_rows():
    values = ([25.0, 34.0] * 10 + [34.0] * 60 + [None] + [34.0] * 5) * 3
    rows = [(at(13 * i), "M1", "Temp", v) for i, v in enumerate(values)]
    rows += [(at(13 * i, 1), "M4", "TVOC", 290.0 if i % 7 else 400.0) for i in range(len(values))]
    return sorted(rows)


def batch_notices(spark, rows, upto):
    state = alerts.breach_state(make_readings(spark, rows), schema.thresholds(spark))
    notices = alerts.notifications(state).filter(F.col("ts") <= F.lit(upto))
    return sorted(notices.select(*KEYS, "at_us", "kind").collect())


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_stream_notices_equal_batch_in_any_order(spark, landed, tmp_path, order):
    rows = alert_rows()
    late = 10
    parts = [rows]
    if order == "shuffled":
        # Rows change places by up to four hours, across batches.
        rng, late = random.Random(1), 240
        arrival = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.uniform(0, late)))
        cut = len(arrival) // 5
        parts = [arrival[i * cut : (i + 1) * cut if i < 4 else None] for i in range(5)]
    else:
        third = len(rows) // 3
        parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    stream = stream_alerts.stream_notifications(landed(parts), schema.thresholds(spark), late=f"{late} minutes")
    got, _ = drain(spark, stream, tmp_path)
    upto = max(r[0] for r in rows) - dt.timedelta(minutes=late)
    assert sorted(got.select(*KEYS, "at_us", "kind").collect()) == batch_notices(spark, rows, upto)
    assert {r.kind for r in got.select("kind").distinct().collect()} == {"new", "suppressed", "reminder"}


def test_readings_beyond_the_allowed_lateness_are_counted(spark, landed, tmp_path):
    hit, ok = 34.0, 25.0
    first = [(at(0), "M1", "Temp", ok), (at(100), "M1", "Temp", hit)]
    second = [(at(200), "M1", "Temp", ok), (at(95), "M1", "Temp", hit)]
    third = [(at(5), "M1", "Temp", hit), (at(300), "M1", "Temp", ok)]
    stream = stream_alerts.stream_notifications(landed([first, second, third]), schema.thresholds(spark))
    got, query = drain(spark, stream, tmp_path)
    # The reading at minute 95 came late, but in time; the one at minute 5 did not.
    start = int(at().replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert [((r.at_us - start) / 60e6, r.kind) for r in got.collect()] == [(95.0, "new")]
    dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 1


def test_late_rows_are_dropped_and_open_windows_wait(spark, landed, tmp_path):
    first = [(at(m), "M1", "Temp", float(m)) for m in (0, 10, 40, 95)]
    second = [(at(80), "M1", "Temp", 80.0), (at(150), "M1", "Temp", 1.0)]
    # Late rows are judged by the watermark the batch before used, so it takes a third file.
    late = [(at(5), "M1", "Temp", 500.0)]
    got, _ = drain(spark, windows.windowed_means(landed([first, second, late])), tmp_path)
    rows = {r.ts: r.value for r in got.collect()}
    # 90-120 closes with the second file; 150-180 is still open.
    assert rows == {at(0): 5.0, at(30): 40.0, at(60): 80.0, at(90): 95.0}


def test_hourly_snapshots_equal_batch_for_closed_hours(spark, landed, tmp_path):
    rows = [(at(17 * i), "M1", "Temp", 20.0 + i) for i in range(30)]
    got, _ = drain(spark, windows.windowed_snapshots(landed([rows]), schema.thresholds(spark)), tmp_path)
    per_hour = {r.hour: 1 if r.direction else 0 for r in got.collect()}
    batch = series.hourly_snapshots(make_readings(spark, rows), schema.thresholds(spark)).collect()
    want = {r.hour: r.n_breaches for r in batch}
    assert per_hour == {h: n for h, n in want.items() if h in per_hour}
    assert len(per_hour) == len(want) - 1


def test_heartbeats(spark, landed, tmp_path):
    stream = landed([[(at(0), "M1", "Temp", 1.0)], [(at(3), "M1", "Temp", 1.0), (at(6), "M1", "Temp", 1.0)]])
    table = str(tmp_path / "beats")
    ingest.log_heartbeats(stream, table, str(tmp_path / "beats-cp"), available_now=True).awaitTermination()
    beats = ingest.heartbeats(spark, table).orderBy("batch_id").collect()
    assert [r.n_rows for r in beats] == [1, 2] and all(r.status == "ok" for r in beats)


def test_heartbeats_of_more_batches_than_the_progress_log_holds(spark, tmp_path):
    table = str(tmp_path / "beats")
    rows = make_readings(spark, [(at(0), "M1", "Temp", 1.0), (at(3), "M1", "Temp", 2.0)])
    for batch_id in [*range(105), 104]:  # the last one is replayed
        ingest.write_heartbeat(rows, batch_id, table)
    ingest.write_heartbeat(rows.limit(0), 105, table)
    beats = ingest.heartbeats(spark, table).orderBy("batch_id").collect()
    assert [r.batch_id for r in beats] == list(range(105))
    assert sum(r.n_rows for r in beats) == 210


def test_telemetry_ingest_upserts(spark, tmp_path):
    def message(minute, device, t1):
        return (f"esp/{device}", f'{{"t1": {t1}, "co2": 400}}', at(minute))

    kind = "topic string, payload string, arrival_ts timestamp_ntz"
    batches = [[message(0, "esp01", 20), message(3, "esp01", 21)], [message(0, "esp01", 22), message(0, "esp99", 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = (
        spark.readStream.schema(kind).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    table = str(tmp_path / "table")
    ingest.ingest_telemetry(
        stream, schema.devices(spark), table, str(tmp_path / "cp"), available_now=True,
        heartbeat_table=str(tmp_path / "beats"),
    ).awaitTermination()
    beats = ingest.heartbeats(spark, str(tmp_path / "beats"))
    assert sorted(r.n_rows for r in beats.collect()) == [1, 2]
    got = ingest.telemetry_table(spark, table).read().orderBy("ts").collect()
    assert [(r.ts, r.node_id, r.temp, r.co2) for r in got] == [(at(0), "M1", 22.0, 400), (at(3), "M1", 21.0, 400)]
