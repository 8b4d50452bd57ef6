"""Device messages: topic plus JSON payload to environment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorlake.functions.text import NUMBER_PATTERN

PAYLOAD_TYPE = "map<string,string>"
# Nothing but an object: the parser alone would take an array, or text after the closing brace.
OBJECT_PATTERN = r"^\s*\{[\s\S]*\}\s*$"


def _number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def of_known_devices(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Messages with ``device``, the last part of the topic, and its node; other devices' are dropped."""
    return messages.withColumn("device", F.element_at(F.split("topic", "/"), -1)).join(devices, "device")


def parse_messages(messages: DataFrame, devices: DataFrame, keep: list[str] = []) -> DataFrame:
    """``(ts, node_id, temp, humidity, co2, tvoc)`` of ``(topic, payload, arrival_ts)``.

    Unknown devices, empty payloads and anything but a JSON object are dropped. Whole-number
    fields are cut toward zero; a value that is no number is null.
    """
    data = F.from_json("payload", PAYLOAD_TYPE)
    shaped = messages.filter(F.col("payload").rlike(OBJECT_PATTERN))
    known = of_known_devices(shaped, devices).withColumn("_data", data)
    # A broken object parses to null.
    valid = known.filter(F.col("_data").isNotNull())

    def whole(name):
        return _number(F.col("_data")[name]).try_cast("bigint")

    return valid.select(
        *keep,
        F.col("arrival_ts").alias("ts"),
        F.col("node").alias("node_id"),
        _number(F.col("_data")["t1"]).alias("temp"),
        _number(F.col("_data")["h1"]).alias("humidity"),
        whole("co2").alias("co2"),
        whole("tvoc").alias("tvoc"),
    )


def to_readings(records: DataFrame) -> DataFrame:
    """Long readings of parsed records."""
    names = {"temp": "Temp", "humidity": "Humid", "co2": "CO2", "tvoc": "TVOC"}
    wide = records.select(
        "ts", F.col("node_id").alias("node"),
        *[F.col(c).cast("double").alias(m) for c, m in names.items()],
    )
    return wide.unpivot(["ts", "node"], list(names.values()), "metric", "value")
