"""Sources, cleaning of raw text, logs and tables.

Raw exports, device messages, weather payloads and log lines are made from the event rows, so that
their parsers work on as much text as there are events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.functions.text import channel_name_col, to_bool, to_number
from sensorlake.functions.times import floor_to
from sensorlake.operators.clean import latest_per_timestamp
from sensorlake.plans.base import (
    EVENT_TYPES,
    NODE_CASE,
    READINGS,
    frame,
    query,
    readings,
    table,
    GRID,
)
from sensorlake.session import work_dir
from sensorlake.sources import prediction_log, tables, telemetry, weather
from sensorlake.sources.ledger import Ledger
from sensorlake.sources import readings as exports

KEYS = ["node", "metric"]

# --- wide exports ------------------------------------------------------------------

HEADING = (
    "CASE metric WHEN 'Temp' THEN concat(node, ' Temp') WHEN 'Humid' THEN"
    " concat(lower(node), ' - Humidity (%)') WHEN 'CO2' THEN concat(node, '_CO2')"
    " ELSE concat(node, ' TVOC') END"
)


def heading(node: str, metric: str) -> str:
    return {
        "Temp": f"{node} Temp",
        "Humid": f"{node.lower()} - Humidity (%)",
        "CO2": f"{node}_CO2",
        "TVOC": f"{node} TVOC",
    }[metric]


def raw_export(spark, d):
    """Wide text frame as a spreadsheet export has it: one row per hour, messy headings."""
    hourly = readings(spark, d).groupBy(
        floor_to("ts", "1 hour").alias("hour"), F.concat_ws("_", *KEYS).alias("channel")
    ).agg(F.max("value").cast("string").alias("cell"))
    names = [f"{n}_{m}" for n, m in schema.CHANNELS]
    wide = hourly.groupBy("hour").pivot("channel", names).agg(F.first("cell"))
    stamp = F.date_format("hour", "yyyy-MM-dd HH:mm:ss")
    return wide.select(
        F.when(F.hour("hour") % 2 == 0, stamp).otherwise("n/a").alias("created"),
        stamp.alias("ThoiGian"),
        *[F.col(f"{n}_{m}").alias(heading(n, m)) for n, m in schema.CHANNELS],
        F.lit("99").alias("M1_TEMP"),
        F.lit("98").alias("M12 Temp"),
        F.lit("97").alias("Battery"),
    )


def landed_export(spark, d):
    path = work_dir(spark)
    raw_export(spark, d).write.option("header", True).csv(path)
    return exports.scan_csv(spark, path)


HOURLY_MAX = f"""{READINGS}, hourly_max AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, node, metric, max(value) AS value
  FROM readings GROUP BY 1, 2, 3)"""


@query(
    "a01_wide_csv_scan",
    f"""WITH {HOURLY_MAX}
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS stamp, {HEADING} AS heading,
      CAST(value AS VARCHAR) AS cell FROM hourly_max WHERE value IS NOT NULL""",
)
def _(spark, d):
    raw = landed_export(spark, d)
    cells = [heading(n, m) for n, m in schema.CHANNELS]
    return raw.unpivot("ThoiGian", cells, "heading", "cell").filter("cell IS NOT NULL").select(
        F.col("ThoiGian").alias("stamp"), "heading", "cell"
    )


@query(
    "a02_timestamp_column_choice",
    f"""WITH {READINGS}, hours AS (
      SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM readings)
    SELECT 0 AS ord, 'created' AS name,
      round(avg(CASE WHEN hour(hour) % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS score,
      CAST(avg(CASE WHEN hour(hour) % 2 = 0 THEN 1.0 ELSE 0.0 END) >= 1 AS INT) AS chosen FROM hours
    UNION ALL
    SELECT 1, 'ThoiGian', 1.0,
      CAST(avg(CASE WHEN hour(hour) % 2 = 0 THEN 1.0 ELSE 0.0 END) < 1 AS INT) FROM hours""",
)
def _(spark, d):
    raw = landed_export(spark, d)
    chosen = exports.choose_time_column(raw)
    return exports.time_scores(raw).withColumn("chosen", F.col("name") == chosen)


@query(
    "a03_drop_bad_timestamps",
    f"""WITH {READINGS}
    SELECT event_id, epoch_us(ts) AS ts_us FROM readings WHERE event_id % 11 <> 0""",
)
def _(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = table(spark, d, "events").filter(F.col("event_type").isin(EVENT_TYPES)).select(
        "event_id", F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(stamp).alias("time")
    )
    return exports.drop_bad_times(raw, "time").select("event_id", "ts")


@query(
    "a04_latest_row_per_timestamp",
    f"""WITH {READINGS}
    SELECT epoch_us(hour) AS ts_us, node, metric, event_id, round(value, 6) AS value FROM (
      SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS hour, row_number() OVER (PARTITION BY
        time_bucket(INTERVAL 1 HOUR, ts), node, metric ORDER BY event_id DESC) AS k FROM readings)
    WHERE k = 1""",
)
def _(spark, d):
    rows = readings(spark, d, ["event_id"]).withColumn("ts", floor_to("ts", "1 hour"))
    return latest_per_timestamp(rows, ["ts", *KEYS], "event_id")


@query(
    "a05_channel_names",
    f"""WITH {READINGS}
    SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL
      ELSE concat(node, '_', metric) END AS channel FROM readings""",
)
def _(spark, d):
    rows = readings(spark, d, ["event_id"])
    node, upper = F.col("node"), F.upper("metric")
    raw = (
        F.when(F.col("event_id") % 6 == 0, F.concat(node, F.lit(" "), "metric"))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lower(node), F.lit(" - "), upper, F.lit(" (x)")))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit("["), node, F.lit("].."), F.lower("metric")))
        .when(F.col("event_id") % 6 == 3, F.concat(upper, F.lit(" @ "), node))
        .when(F.col("event_id") % 6 == 4, F.concat(F.lit("M12 "), "metric"))
        .otherwise(F.concat(node, F.lit(" Battery")))
    )
    return rows.select("event_id", channel_name_col(raw).alias("channel"))


@query(
    "a06_channel_selection",
    f"""WITH {HOURLY_MAX}
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS stamp, concat(node, '_', metric) AS channel,
      CAST(value AS VARCHAR) AS cell FROM hourly_max WHERE value IS NOT NULL""",
)
def _(spark, d):
    kept = exports.select_channels(landed_export(spark, d), keep=["ThoiGian"])
    channels = [c for c in kept.columns if c != "ThoiGian"]
    return kept.unpivot("ThoiGian", channels, "channel", "cell").filter("cell IS NOT NULL").select(
        F.col("ThoiGian").alias("stamp"), "channel", "cell"
    )


@query(
    "a07_numeric_text",
    """SELECT event_id, CASE event_id % 8 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL
      WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE round(value, 6) END AS number FROM events""",
)
def _(spark, d):
    kind, text = F.col("event_id") % 8, F.col("value").cast("string")
    raw = (
        F.when(kind == 0, F.replace(text, F.lit("."), F.lit(",")))
        .when(kind == 1, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(kind == 2, "unknown")
        .when(kind == 3, "nan")
        .when(kind == 4, F.concat(F.lit("1."), text, F.lit(".5")))
        .when(kind == 5, "5d")
        .when(kind == 6, "")
        .otherwise(text)
    )
    return table(spark, d, "events").select("event_id", to_number(raw).alias("number"))


@query(
    "a08_wide_to_long",
    f"""WITH {GRID}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(value, 6) AS value FROM grid WHERE value IS NOT NULL""",
)
def _(spark, d):
    names = [f"{n}_{m}" for n, m in schema.CHANNELS]
    wide = (
        frame(spark, d)
        .withColumn("channel", F.concat_ws("_", *KEYS))
        .groupBy("ts")
        .pivot("channel", names)
        .agg(F.first("value", True))
    )
    return exports.to_long(wide).filter("value IS NOT NULL")


# --- device messages ---------------------------------------------------------------


def messages(events):
    """Device messages of event rows, some of them broken in the ways the parser must survive."""
    kind = F.col("event_id") % 12
    v = F.col("value").cast("string")
    device = F.concat(F.lit("esp"), F.lpad(F.substring(F.expr(NODE_CASE), 2, 2), 2, "0"))

    def obj(t1, h1, co2, tvoc):
        return F.concat(
            F.lit('{"t1": '), t1, F.lit(', "h1": '), h1, F.lit(', "co2": '), co2,
            F.lit(', "tvoc": '), tvoc, F.lit("}"),
        )

    payload = (
        F.when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit('{"t1": '), v))
        .when(kind == 3, F.concat(F.lit("["), v, F.lit("]")))
        .when(kind == 4, F.concat(F.lit('{"h1": '), v, F.lit("}")))
        .when(kind == 5, obj(v, v, F.concat(F.lit('"'), v, F.lit('9"')), v))
        .when(kind == 6, obj(F.lit('"bad"'), v, F.lit('"inf"'), F.lit("null")))
        .otherwise(obj(v, v, v, F.concat(F.lit("-"), v)))
    )
    return events.select(
        "event_id",
        F.concat(F.lit("esp/"), F.when(kind == 0, "esp99").otherwise(device)).alias("topic"),
        payload.alias("payload"),
        F.col("ts").alias("arrival_ts"),
    )


RECORDS = f"""records AS (
  SELECT event_id, ts, {NODE_CASE} AS node_id,
    CASE WHEN event_id % 12 IN (4, 6) THEN NULL ELSE value END AS temp, value AS humidity,
    CASE WHEN event_id % 12 IN (4, 6) THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS co2,
    CASE WHEN event_id % 12 IN (4, 6) THEN NULL WHEN event_id % 12 = 5 THEN CAST(trunc(value) AS BIGINT)
      ELSE CAST(trunc(-value) AS BIGINT) END AS tvoc
  FROM events WHERE event_id % 12 NOT IN (0, 1, 2, 3))"""


@query(
    "a09_telemetry_parse",
    f"""WITH {RECORDS}
    SELECT epoch_us(ts) AS ts_us, node_id, round(temp, 6) AS temp, round(humidity, 6) AS humidity,
      co2, tvoc FROM records""",
)
def _(spark, d):
    return telemetry.parse_messages(messages(table(spark, d, "events")), schema.devices(spark))


@query(
    "c03_device_lookup",
    f"""SELECT event_id, concat('esp', lpad(substr({NODE_CASE}, 2), 2, '0')) AS device,
      {NODE_CASE} AS node FROM events WHERE event_id % 12 <> 0""",
)
def _(spark, d):
    sent = messages(table(spark, d, "events"))
    return telemetry.of_known_devices(sent, schema.devices(spark)).select("event_id", "device", "node")


@query(
    "a10_keyed_upsert",
    f"""WITH {RECORDS}
    SELECT epoch_us(hour) AS ts_us, node_id, event_id, round(temp, 6) AS temp,
      round(humidity, 6) AS humidity, co2, tvoc FROM (
      SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS hour, row_number() OVER (PARTITION BY
        time_bucket(INTERVAL 1 HOUR, ts), node_id ORDER BY CASE event_id % 3 WHEN 1 THEN 2
        WHEN 2 THEN 1 ELSE 0 END DESC, event_id DESC) AS k
      FROM records) WHERE k = 1""",
)
def _(spark, d):
    records = telemetry.parse_messages(
        messages(table(spark, d, "events")), schema.devices(spark), ["event_id"]
    ).withColumn("ts", floor_to("ts", "1 hour"))
    table_ = Ledger(spark, work_dir(spark), ["ts", "node_id"], ["event_id"])
    # Three batches, the second one sent twice.
    for batch, part in ((0, 0), (1, 2), (1, 2)):
        table_.upsert(records.filter(F.col("event_id") % 3 == part), "events", batch)
    table_.compact(fan_in=2)
    table_.upsert(records.filter("event_id % 3 = 1"), "events", 2)
    return table_.read().select("ts", "node_id", "event_id", "temp", "humidity", "co2", "tvoc")


# --- weather -----------------------------------------------------------------------


def landed_weather(spark, d):
    """One weather payload per day, its 24 hours made from the events of that hour."""
    hourly = table(spark, d, "events").groupBy(floor_to("ts", "1 hour").alias("hour")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")
    )
    entry = F.struct(
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"),
        (F.lit(20.0) + F.col("low") / 10).alias("temperature_2m"),
        (F.lit(50.0) + F.col("high") / 10).alias("relative_humidity_2m"),
        (F.col("high") / 20).alias("wind_speed_10m"),
        (F.col("n") % 100).cast("int").alias("weather_code"),
    )
    days = hourly.groupBy(F.to_date("hour").alias("day")).agg(
        F.array_sort(F.collect_list(entry)).alias("h")
    )
    fields = ["time", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "weather_code"]
    current = F.element_at("h", -1)
    return days.select(
        "day",
        F.to_json(
            F.struct(
                F.struct(*[current[f].alias(f) for f in fields[1:]]).alias("current"),
                F.struct(*[F.col("h")[f].alias(f) for f in fields]).alias("hourly"),
            )
        ).alias("payload"),
    )


WEATHER = f"""codes AS ({schema.WEATHER_CODES_SQL}), hourly AS (
  SELECT w.*, coalesce(c.description, concat('Code ', w.code)) AS description FROM (
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, 20 + min(value) / 10 AS temperature_c,
      50 + max(value) / 10 AS humidity_pct, max(value) / 20 AS wind_speed_kmh,
      CAST(count(*) % 100 AS INT) AS code
    FROM events GROUP BY 1) w LEFT JOIN codes c ON c.code = w.code)"""
WEATHER_COLUMNS = """code, round(temperature_c, 6) AS temperature_c, round(humidity_pct, 6) AS
  humidity_pct, round(wind_speed_kmh, 6) AS wind_speed_kmh, description"""


@query(
    "a11_current_weather",
    f"""WITH {WEATHER}
    SELECT CAST(ts AS DATE)::VARCHAR AS day, {WEATHER_COLUMNS} FROM (SELECT *, row_number() OVER (
      PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC) AS k FROM hourly) WHERE k = 1""",
)
def _(spark, d):
    return weather.current_weather(landed_weather(spark, d), schema.weather_codes(spark), ["day"])


@query(
    "a12_hourly_forecast",
    f"""WITH {WEATHER}
    SELECT CAST(ts AS DATE)::VARCHAR AS day, epoch_us(ts) AS ts_us, {WEATHER_COLUMNS} FROM hourly""",
)
def _(spark, d):
    return weather.hourly_forecast(landed_weather(spark, d), schema.weather_codes(spark), ["day"])


@query(
    "a13_weather_codes",
    f"""WITH codes AS ({schema.WEATHER_CODES_SQL})
    SELECT e.event_id, CAST(floor(e.value) AS INT) AS code,
      coalesce(c.description, concat('Code ', CAST(floor(e.value) AS INT))) AS description
    FROM events e LEFT JOIN codes c ON c.code = CAST(floor(e.value) AS INT)""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.floor("value").cast("int").alias("code"))
    return weather.with_description(rows, schema.weather_codes(spark))


# --- prediction log ----------------------------------------------------------------

LOG_HEADER = [
    "logged_at_utc", "forecast_issue_time", "forecast_target_time", "pred_M1_Temp", "gt_M1_Temp",
]


@query(
    "a14_ragged_log_lines",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS logged_at_utc, 'i' AS forecast_issue_time,
      CASE WHEN event_id % 5 = 1 THEN '' ELSE 't,"x' END AS forecast_target_time,
      CASE WHEN event_id % 5 = 2 THEN 'True' ELSE '' END AS ground_truth_matched,
      CASE WHEN event_id % 5 IN (1, 4) THEN '' ELSE CAST(value AS VARCHAR) END AS "pred_M1_Temp",
      CASE WHEN event_id % 5 IN (1, 4) THEN '' ELSE 'g' END AS "gt_M1_Temp" FROM events""",
)
def _(spark, d):
    v, kind = F.col("value").cast("string"), F.col("event_id") % 5
    tail = (
        F.when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit(',"t,\\"x",True,'), v, F.lit(",g")))
        .when(kind == 3, F.concat(F.lit(',"t,\\"x",'), v, F.lit(",g,more,and,more")))
        .when(kind == 4, F.lit(',"t,\\"x"'))
        .otherwise(F.concat(F.lit(',"t,\\"x",'), v, F.lit(",g")))
    )
    lines = table(spark, d, "events").select(
        "event_id", F.concat(F.col("event_id").cast("string"), F.lit(",i"), tail).alias("line")
    )
    return prediction_log.parse_ragged(lines, LOG_HEADER, ["event_id"])


LOG_FILES = {
    "current": "logged_at_utc,forecast_issue_time,forecast_target_time,ground_truth_matched,pred_M1_Temp,gt_M1_Temp",
    "older": "logged_at_utc,forecast_issue_time,forecast_target_time,M1_Temp,gt_M1_Temp",
    "noted": "logged_at_utc,forecast_issue_time,forecast_target_time,ground_truth_matched,note,pred_M4_CO2",
}


def written_log(spark, d):
    """A log of a file for each day and release of its writer, each with its own header. The older writer
    adds a flag its header lacks to some lines; notes hold line breaks, commas and quotes."""
    number = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.col("ts") + F.make_interval(secs=F.lit(180).cast("decimal(18,6)"))
    target = F.when(number % 7 == 0, "").otherwise(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    value = F.col("value").cast("string")
    note = F.when(number % 2 == 0, F.concat(F.lit('"line ""1"",\n\nline 2 of '), number, F.lit('"')))
    flag = F.when(number % 2 == 0, "True").otherwise("False")
    fields = {
        "current": [flag, value, F.lit("")],
        "older": [F.when(number % 4 == 2, F.concat(flag, F.lit(","), value)).otherwise(value), value],
        "noted": [flag, F.coalesce(note, F.lit("plain")), value],
    }
    release = F.element_at(F.array(*map(F.lit, LOG_FILES)), (number % 3 + 1).cast("int"))
    rows = table(spark, d, "events").withColumn("release", release).withColumn("day", F.to_date("ts"))
    line = F.coalesce(*[
        F.when(F.col("release") == name, F.concat_ws(",", stamp, stamp, target, *cells))
        for name, cells in fields.items()
    ])
    lines = rows.select("day", "release", F.lit(1).alias("_part"), "ts", line.alias("value"))
    header = F.element_at(F.create_map(*[F.lit(x) for kv in LOG_FILES.items() for x in kv]), F.col("release"))
    heads = rows.select("day", "release").distinct().select(
        "day", "release", F.lit(0).alias("_part"), F.lit(None).cast("timestamp_ntz").alias("ts"), header.alias("value")
    )
    path = work_dir(spark)
    files = lines.unionByName(heads).repartition("day", "release")
    ordered = files.sortWithinPartitions("day", "release", "_part", "ts")
    ordered.select("day", "release", "value").write.partitionBy("day", "release").text(path)
    return path


@query(
    "a14_log_load",
    """WITH log AS (SELECT *, epoch_us(ts) AS i, CASE WHEN event_id % 7 <> 0
        THEN epoch_us(ts) + 180000000 END AS t, event_id % 3 AS kind, event_id % 2 = 0 AS even FROM events)
    SELECT i AS logged_at_us, i AS issue_ts_us, coalesce(t, CAST(trunc(i + (
        SELECT quantile_cont(t - i, 0.5) FROM log WHERE t >= i)) AS BIGINT)) AS target_ts_us,
      CAST(even AND (kind <> 1 OR event_id % 4 = 2) AS INT) AS ground_truth_matched,
      round(CASE WHEN kind < 2 THEN value END, 6) AS "pred_M1_Temp",
      round(CASE WHEN kind = 1 THEN value END, 6) AS "gt_M1_Temp",
      round(CASE WHEN kind = 2 THEN value END, 6) AS "pred_M4_CO2",
      CASE WHEN kind <> 2 THEN '' WHEN even
        THEN concat('line "1",', chr(10), chr(10), 'line 2 of ', event_id) ELSE 'plain' END AS note
    FROM log""",
)
def _(spark, d):
    return prediction_log.load_log(spark, written_log(spark, d))


@query(
    "a15_legacy_headings",
    """SELECT event_id, value AS "pred_M1_Temp", value AS "pred_M4_CO2", 0 AS "M4_CO2",
      1 AS "M12_Temp" FROM events""",
)
def _(spark, d):
    log = table(spark, d, "events").select(
        "event_id",
        F.col("value").alias("M1_Temp"),
        F.col("value").alias("pred_M4_CO2"),
        F.lit(0).alias("M4_CO2"),
        F.lit(1).alias("M12_Temp"),
    )
    return prediction_log.upgrade_headings(log)


@query(
    "a16_boolean_text",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS flag FROM events""",
)
def _(spark, d):
    words = F.array(*[F.lit(w) for w in ["True", " YES ", "1", "t", "False", "maybe"]], F.lit(None))
    raw = F.get(words, (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", to_bool(raw).alias("flag"))


def log_with_gaps(spark, d):
    late = F.make_interval(secs=(F.lit(180) + F.col("event_id") % 60).cast("decimal(18,6)"))
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").alias("issue_ts"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts") + late).alias("target_ts"),
    )


@query(
    "a17_log_time_repair",
    """WITH log AS (SELECT event_id, epoch_us(ts) AS i, CASE WHEN event_id % 7 <> 0
      THEN epoch_us(ts) + (180 + event_id % 60) * 1000000 END AS t FROM events)
    SELECT event_id, i AS issue_ts_us, coalesce(t, CAST(trunc(i + (
      SELECT quantile_cont(t - i, 0.5) FROM log WHERE t >= i)) AS BIGINT)) AS target_ts_us FROM log""",
)
def _(spark, d):
    return prediction_log.repair_times(log_with_gaps(spark, d))


LOG_KEYS = ["issue_ts", "target_ts", "node", "metric"]
APPENDED = f"""{READINGS}, appended AS (SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS issue_ts,
    time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3 MINUTE AS target_ts, node, metric, value AS pred,
    ts AS logged_at, CASE WHEN event_id % 2 = 1 THEN 'new' END AS origin,
    row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts), node, metric
      ORDER BY event_id % 2 DESC, ts DESC) AS k FROM readings) WHERE k = 1)"""


def appended_log(spark, d):
    log = readings(spark, d, ["event_id"]).select(
        "event_id",
        floor_to("ts", "1 hour").alias("issue_ts"),
        (floor_to("ts", "1 hour") + F.expr("INTERVAL 3 MINUTES")).alias("target_ts"),
        *KEYS,
        F.col("value").alias("pred"),
        F.col("ts").alias("logged_at"),
    )
    old = log.filter("event_id % 2 = 0").drop("event_id")
    new = log.filter("event_id % 2 = 1").drop("event_id").withColumn("origin", F.lit("new"))
    return prediction_log.append(old, new, LOG_KEYS)


APPENDED_COLUMNS = """epoch_us(issue_ts) AS issue_ts_us, epoch_us(target_ts) AS target_ts_us, node,
  metric, round(pred, 6) AS pred, epoch_us(logged_at) AS logged_at_us, origin"""


@query("a18_log_append", f"WITH {APPENDED} SELECT {APPENDED_COLUMNS} FROM appended")
def _(spark, d):
    return appended_log(spark, d)


@query(
    "g04_union_missing_columns",
    f"""WITH {READINGS}
    SELECT epoch_us(ts) AS ts_us, node, metric, CASE WHEN event_id % 2 = 0 THEN round(value, 6) END
      AS pred, CASE WHEN event_id % 2 = 1 THEN round(value, 6) END AS gt FROM readings""",
)
def _(spark, d):
    rows = readings(spark, d, ["event_id"])
    a = rows.filter("event_id % 2 = 0").select("ts", *KEYS, F.col("value").alias("pred"))
    b = rows.filter("event_id % 2 = 1").select(*KEYS, "ts", F.col("value").alias("gt"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "f05_newest_log_rows",
    f"""WITH {APPENDED} SELECT {APPENDED_COLUMNS} FROM appended
    ORDER BY issue_ts DESC, target_ts, node, metric LIMIT 50""",
)
def _(spark, d):
    return prediction_log.newest(appended_log(spark, d), ["target_ts", *KEYS], 50)


@query("a19_log_rewrite", f"WITH {APPENDED} SELECT {APPENDED_COLUMNS} FROM appended")
def _(spark, d):
    # The log as it stands, then its new content read from itself: one commit swaps them.
    log = Ledger(spark, work_dir(spark), ["issue_ts", "target_ts", *KEYS], ts="issue_ts")
    log.replace(appended_log(spark, d))
    log.replace(log.read())
    return prediction_log.rewrite(log.read(), work_dir(spark), "csv")


# --- append tables -----------------------------------------------------------------


@query(
    "a20_append_table",
    """SELECT event_id, epoch_us(ts) AS ts_us, event_type AS command,
      substr(sha256(concat('user', user_id)), 1, 16) AS username_hash,
      CAST(ts AS DATE)::VARCHAR AS day FROM events""",
)
def _(spark, d):
    log = table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("command"),
        F.concat(F.lit("user"), "user_id").alias("username"),
    )
    path = work_dir(spark)
    tables.append_rows(tables.anonymise(log), path)
    return spark.read.parquet(path)


@query(
    "a21_retention",
    """SELECT event_id, epoch_us(ts) AS ts_us FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return tables.retained(rows, tables.HEARTBEAT_DAYS)


OUTDOOR_DOC = """{"campus_latlon": {"lat": 10.78, "lon": 106.68}, "nodes": {%s}}"""


@query(
    "a22_dimension_load",
    f"""WITH {READINGS}, outdoor AS ({schema.OUTDOOR_SQL})
    SELECT node, metric, node_type, round(max_dev, 6) AS max_dev, count(value) AS n_readings
    FROM outdoor JOIN readings USING (node, metric) GROUP BY ALL""",
)
def _(spark, d):
    parts = {}
    for node, kind, metric, limit in schema.OUTDOOR:
        parts.setdefault((node, kind), []).append(f'"{metric}": {limit}')
    doc = OUTDOOR_DOC % ", ".join(
        f'"{node}": {{"type": "{kind}", "sanity_thresholds": {{{", ".join(limits)}}}}}'
        for (node, kind), limits in parts.items()
    )
    path = work_dir(spark)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    return (
        tables.load_outdoor(spark, path)
        .join(readings(spark, d), KEYS)
        .groupBy(*KEYS, "node_type", "max_dev")
        .agg(F.count("value").alias("n_readings"))
    )
