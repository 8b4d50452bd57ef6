import csv
import datetime as dt
import io

import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.functions.text import channel_name_col, fixed_text, short_hash, to_bool, to_number
from sensorlake.sources import prediction_log, readings, tables, telemetry, weather

NAMES = {
    "M1 Temp": "M1_Temp",
    "m10 - Humidity (%)": "M10_Humid",
    "M4_CO2": "M4_CO2",
    "M9 TVOC": "M9_TVOC",
    "Hum_M11": "M11_Humid",
    "Battery": None,
    "M12 Temp": None,
    "M2 Temp": None,
    "M1": None,
}


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_channel_names_agree(spark):
    assert column(spark, NAMES, channel_name_col) == list(NAMES.values())
    assert column(spark, ["M12 Temp"], lambda c: channel_name_col(c, strict=False)) == ["M1_Temp"]
    found = readings.channel_columns(spark, ["Battery", "m4 co2", "M1 Temp", "M4_CO2"])
    assert list(found.items()) == [("M4_CO2", "m4 co2"), ("M1_Temp", "M1 Temp")]
    assert readings.channel_columns(spark, []) == {}


def test_times_with_offsets_epochs_and_words(spark):
    local = dt.datetime(2024, 3, 1, 7, 30)
    same = [
        "2024-03-01 07:30:00", "2024-03-01T07:30:00+07:00", "2024-03-01T00:30:00Z", "2024-03-01 00:30:00 UTC",
        "2024-02-29T19:30:00-0500", "2024-03-01 00:30:00+00", "1709253000", "1709253000000", "Mar 1, 2024 7:30",
        "March 1, 2024 07:30:00", "1 Mar 2024 7:30", "3/1/2024 7:30", "3.1.2024 07:30", "3/1/2024 7:30 AM", " 2024/3/1 7:30 ",
    ]
    assert column(spark, same, readings.parse_time) == [local] * len(same)
    days = ["2024-03-01", "Mar 1, 2024", "3.1.2024", "31.12.2023", "31/12/2023", "12", "tomorrow", "", None, "99999999999999"]
    got = column(spark, days, readings.parse_time)
    assert got[:5] == [dt.datetime(2024, 3, 1)] * 3 + [dt.datetime(2023, 12, 31)] * 2
    assert got[6:] == [None] * 4


def test_numbers(spark):
    cells = ["28,7", " 5 ", "unknown", "nan", "1.234.5", "5d", "", None, "-3.5e1", "NaN", "+.5", "1,2,3"]
    want = [28.7, 5.0, None, None, None, None, None, None, -35.0, None, 0.5, None]
    assert column(spark, cells, to_number) == want


def test_booleans_hash_and_text(spark):
    words = ["True", " yes", "1", "T", "y", "no", "", None, "2"]
    assert column(spark, words, to_bool) == [True] * 5 + [False] * 4
    assert column(spark, ["user1"], short_hash) == ["0a041b9462caa4a3"]
    numbers = ["0.125", "2.675", "1234.5", "-0.004"]
    texts = column(spark, numbers, lambda c: fixed_text(c.cast("double")))
    assert texts[:3] == ["0.12", "2.67", "1234.50"]


def test_wide_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Created,ThoiGian,M1 Temp,m10 - Humidity (%),M4_CO2,M1_TEMP,Battery,M12 Temp\n"
        "x,2024-03-01 00:03:00,\"28,7\",60,unknown,1,9,9\n"
        "2024-03-01,2024-03-01 00:00:00,20, 5 ,1.234.5,1,9,9\n"
        "x,2024-03-01 00:03:00,30,nan,412,1,9,9\n"
        "x,not a time,30,1,2,1,9,9\n"
    )
    raw = readings.scan_csv(spark, str(tmp_path))
    assert readings.choose_time_column(raw) == "ThoiGian"
    rows = readings.read_readings(spark, str(tmp_path)).collect()
    got = {(r.ts, r.node, r.metric): r.value for r in rows}
    assert got == {
        (at(0), "M1", "Temp"): 20.0, (at(0), "M10", "Humid"): 5.0, (at(0), "M4", "CO2"): None,
        (at(3), "M1", "Temp"): 30.0, (at(3), "M10", "Humid"): None, (at(3), "M4", "CO2"): 412.0,
    }


def test_source_errors(spark, tmp_path):
    df = spark.createDataFrame([("x", "1")], "Time string, Battery string")
    with pytest.raises(readings.SourceError):
        readings.choose_time_column(df)
    with pytest.raises(readings.SourceError):
        readings.choose_time_column(df.drop("Time"))
    with pytest.raises(readings.SourceError):
        readings.select_channels(df, keep=["Time"])
    (tmp_path / "e.csv").write_text("Time,M1 Temp\n")
    with pytest.raises(readings.SourceError):
        readings.scan_csv(spark, str(tmp_path))


def test_messages(spark):
    good = '{"t1": 30.2, "h1": 66.5, "co2": 400, "tvoc": 0}'
    rows = [
        ("esp/esp01", good), ("a/b/esp10", '{"co2": "412.9", "tvoc": "inf", "t1": "x"}'),
        ("esp/esp99", good), ("esp/esp01", ""), ("esp/esp01", "{bad"), ("esp/esp01", "[1]"),
        ("esp/esp04", '{"tvoc": -3.7, "h1": null}'), ("esp/esp06", '"text"'), ("esp/esp07", "{}"),
        ("esp/esp08", None), ("esp/esp09", good + " x"), ("esp/esp11", "\n{} \n"),
    ]
    df = spark.createDataFrame([(t, p, at(0)) for t, p in rows], "topic string, payload string, arrival_ts timestamp_ntz")
    got = {r.node_id: (r.temp, r.humidity, r.co2, r.tvoc) for r in telemetry.parse_messages(df, schema.devices(spark)).collect()}
    assert got == {
        "M1": (30.2, 66.5, 400, 0), "M10": (None, None, 412, None), "M4": (None, None, None, -3),
        "M7": (None, None, None, None), "M11": (None, None, None, None),
    }
    assert telemetry.to_readings(telemetry.parse_messages(df, schema.devices(spark))).count() == 20


def test_weather_payload(spark):
    payload = (
        '{"current": {"temperature_2m": 31.5, "relative_humidity_2m": 70, "wind_speed_10m": 3.2, "weather_code": 7},'
        ' "hourly": {"time": ["2024-03-01T00:00", "2024-03-01T01:00"], "temperature_2m": [30.0, 29.5],'
        ' "relative_humidity_2m": [70, 71], "wind_speed_10m": [3, 4], "weather_code": [3, 95]}}'
    )
    df = spark.createDataFrame([(1, payload), (2, '{"current": {"temperature_2m": 1}}')], "id int, payload string")
    codes = schema.weather_codes(spark)
    now = weather.current_weather(df, codes, ["id"]).collect()
    assert [(r.id, r.temperature_c, r.description) for r in now] == [(1, 31.5, "Code 7")]
    hours = weather.hourly_forecast(df, codes, ["id"]).orderBy("ts").collect()
    assert [(r.ts, r.humidity_pct, r.description) for r in hours] == [
        (at(0), 70.0, "Overcast"), (at(60), 71.0, "Thunderstorm"),
    ]


def test_log_times_append_and_rewrite(spark, tmp_path):
    log = spark.createDataFrame(
        [(at(0), at(3), 1.0, at(0)), (at(3), at(6), 2.0, at(3)), (at(6), None, 3.0, at(6)), (at(9), at(19), 4.0, at(9))],
        "issue_ts timestamp_ntz, target_ts timestamp_ntz, pred double, logged_at timestamp_ntz",
    )
    fixed = prediction_log.repair_times(log)
    assert [r.target_ts for r in fixed.orderBy("issue_ts").collect()] == [at(3), at(6), at(9), at(19)]
    bare = log.withColumn("target_ts", F.lit(None).cast("timestamp_ntz"))
    assert prediction_log.repair_times(bare).orderBy("issue_ts").first().target_ts == at(3)
    new = spark.createDataFrame(
        [(at(0), at(3), 9.0, at(50), True)],
        "issue_ts timestamp_ntz, target_ts timestamp_ntz, pred double, logged_at timestamp_ntz, matched boolean",
    )
    both = prediction_log.append(fixed, new, ["issue_ts", "target_ts"]).orderBy("issue_ts")
    first = both.first()
    assert both.count() == 4 and first.pred == 9.0 and first.matched
    newest = prediction_log.newest(both, ["target_ts"], 2).collect()
    assert [r.issue_ts for r in newest] == [at(9), at(6)]
    path = str(tmp_path / "log")
    stored = prediction_log.rewrite(both, path)
    again = prediction_log.rewrite(stored.filter("pred > 3"), path)
    assert [r.pred for r in again.orderBy("pred").collect()] == [4.0, 9.0]


def test_ragged_lines_and_headings(spark):
    header = ["logged_at_utc", "forecast_issue_time", "forecast_target_time", "M1_Temp"]
    lines = ["a,b,c,1", "a,b", "a,b,c,True,2", "a,b,c,3,4", 'a,"b,b",c,5', ""]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    out = prediction_log.upgrade_headings(prediction_log.parse_ragged(df, header, ["i"])).orderBy("i").collect()
    assert [(r.forecast_issue_time, r.ground_truth_matched, r.pred_M1_Temp) for r in out] == [
        ("b", "", "1"), ("b", "", ""), ("b", "True", "2"), ("b", "", "3"), ("b,b", "", "5"),
    ]
    wide = spark.createDataFrame([(at(0), at(3), "1.5")], "issue_ts timestamp_ntz, target_ts timestamp_ntz, pred_M1_Temp string")
    long = prediction_log.to_long(wide, ["M1_Temp", "M4_CO2"]).first()
    assert (long.node, long.metric, long.pred) == ("M1", "Temp", 1.5)


def test_records_hold_quoted_line_breaks_across_splits(spark, tmp_path):
    records = [["h1", "h2"]] + [[str(i), 'a, "b"\n\n' * (i % 4) + f"end {i}"] for i in range(300)]
    for name, part in (("a.csv", records), ("b.csv", records[:1] + records[5:90]), ("empty.csv", [])):
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows(part)
            out.write("\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        read = prediction_log.read_records(spark, str(tmp_path))
        found = read.withColumn("file", F.element_at(F.split("file", "/"), -1)).orderBy("file", "record").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, part in (("a.csv", records), ("b.csv", records[:1] + records[5:90])):
        mine = [r for r in found if r.file == name]
        assert [r.record for r in mine] == list(range(len(part)))
        assert [next(csv.reader(io.StringIO(r.line, newline=""))) for r in mine] == part
    assert not [r for r in found if r.file == "empty.csv"]


def test_log_of_mixed_headers_is_one_path(spark, tmp_path):
    (tmp_path / "1.csv").write_text("logged_at_utc,forecast_issue_time,forecast_target_time,M1_Temp\n"
                                    "2024-03-01T00:00:00,2024-03-01T00:00:00,2024-03-01T00:03:00,1.5\n"
                                    "2024-03-01T00:01:00,2024-03-01T00:01:00,2024-03-01T00:04:00,True,2.5\n")
    (tmp_path / "2.csv").write_text('logged_at_utc,forecast_issue_time,forecast_target_time,note,pred_M4_CO2\n'
                                    '2024-03-01T00:02:00,2024-03-01T00:02:00,,"x\ny ""z""",400\n'
                                    "2024-03-01T00:03:00\n")
    (tmp_path / "3.csv").write_text("logged_at_utc,forecast_issue_time,forecast_target_time,ground_truth_matched\n")
    log = prediction_log.load_log(spark, str(tmp_path)).orderBy("logged_at").collect()
    assert [(r.issue_ts, r.target_ts, r.ground_truth_matched, r.pred_M1_Temp, r.note, r.pred_M4_CO2) for r in log] == [
        (at(0), at(3), False, 1.5, "", None),
        (at(1), at(4), True, 2.5, "", None),
        (at(2), at(5), False, None, 'x\ny "z"', 400.0),
        (None, None, False, None, "", None),
    ]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "blank.csv").write_text("\n\n")
    with pytest.raises(readings.SourceError):
        prediction_log.load_log(spark, str(tmp_path / "none"))


def test_retention(spark, tmp_path):
    df = spark.createDataFrame([(at(0),), (at(60 * 24),), (at(60 * 96),)], "ts timestamp_ntz")
    assert tables.retained(df, 3).count() == 2
    path = str(tmp_path / "t")
    tables.append_rows(df, path)
    tables.append_rows(df, path)
    assert spark.read.parquet(path).count() == 6
    tables.prune_days(spark, path, 3, "2024-03-05")
    assert spark.read.parquet(path).count() == 4


def test_dimension_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"nodes": {\n"M7": {"type": "outdoor", "sanity_thresholds": {"Temp": 5.0}}, "M1": {"sanity_thresholds": {"Humid": 20}}}}')
    got = {(r.node, r.node_type, r.metric, r.max_dev) for r in tables.load_outdoor(spark, str(tmp_path / "o.json")).collect()}
    assert got == {("M7", "outdoor", "Temp", 5.0), ("M1", "outdoor", "Humid", 20.0)}
    (tmp_path / "p.json").write_text('{\n"M1": [2704, 1535],\n"M4": [1, 2]}')
    got = {(r.node, r.px, r.py) for r in tables.load_positions(spark, str(tmp_path / "p.json")).collect()}
    assert got == {("M1", 2704.0, 1535.0), ("M4", 1.0, 2.0)}
