"""Landed weather payloads: current conditions and hourly forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CURRENT_TYPE = (
    "current struct<temperature_2m: double, relative_humidity_2m: double,"
    " wind_speed_10m: double, weather_code: int>"
)
HOURLY_TYPE = (
    "hourly struct<time: array<string>, temperature_2m: array<double>,"
    " relative_humidity_2m: array<double>, wind_speed_10m: array<double>, weather_code: array<int>>"
)


def with_description(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds the text of a weather code, ``Code N`` when it is not known."""
    return rows.join(codes, "code", "left").withColumn(
        "description", F.coalesce("description", F.concat(F.lit("Code "), F.col("code")))
    )


def current_weather(payloads: DataFrame, codes: DataFrame, keep: list[str]) -> DataFrame:
    """Current conditions per payload; a payload without all numbers is dropped."""
    now = F.from_json("payload", CURRENT_TYPE)["current"]
    rows = payloads.select(
        *keep,
        now["temperature_2m"].alias("temperature_c"),
        now["relative_humidity_2m"].alias("humidity_pct"),
        now["wind_speed_10m"].alias("wind_speed_kmh"),
        F.coalesce(now["weather_code"], F.lit(0)).alias("code"),
    ).dropna(subset=["temperature_c", "humidity_pct", "wind_speed_kmh"])
    return with_description(rows, codes)


def hourly_forecast(payloads: DataFrame, codes: DataFrame, keep: list[str]) -> DataFrame:
    """One row per forecast hour from the payload's parallel arrays."""
    hourly = F.from_json("payload", HOURLY_TYPE)["hourly"]
    fields = ["time", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "weather_code"]
    zipped = F.arrays_zip(*[hourly[f].alias(f) for f in fields])
    rows = payloads.select(*keep, F.explode(zipped).alias("h")).select(
        *keep,
        F.col("h.time").try_cast("timestamp_ntz").alias("ts"),
        F.col("h.temperature_2m").alias("temperature_c"),
        F.col("h.relative_humidity_2m").alias("humidity_pct"),
        F.col("h.wind_speed_10m").alias("wind_speed_kmh"),
        F.col("h.weather_code").alias("code"),
    )
    return with_description(rows, codes)


def weather_readings(hourly: DataFrame) -> DataFrame:
    """``(ts, metric, value)`` for the comparison with outdoor sensors."""
    return hourly.select(
        "ts", F.col("temperature_c").alias("Temp"), F.col("humidity_pct").alias("Humid")
    ).unpivot("ts", ["Temp", "Humid"], "metric", "value")
