"""Fixed values of the sensor fleet and the small dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
# Nodes in display order, with their names.
NODES = [
    ("M1", "Canteen Garden"),
    ("M4", "Studio ISCM"),
    ("M6", "ISCM Staircase"),
    ("M7", "Sky Garden"),
    ("M8", "ISCM Balcony"),
    ("M9", "Hotel Kitchen"),
    ("M10", "Hotel Corridor"),
    ("M11", "Hotel Balcony"),
]
NODE_IDS = [node for node, _ in NODES]

# Telemetry device -> node.
DEVICES = [
    ("esp01", "M1"),
    ("esp04", "M4"),
    ("esp06", "M6"),
    ("esp07", "M7"),
    ("esp08", "M8"),
    ("esp09", "M9"),
    ("esp10", "M10"),
    ("esp11", "M11"),
]

# Metric, unit, colour range (low, high).
METRICS = [
    ("Temp", "°C", 25.0, 34.0),
    ("Humid", "%", 40.0, 80.0),
    ("CO2", "ppm", 400.0, 1200.0),
    ("TVOC", "ppb", 0.0, 300.0),
]
METRIC_IDS = [m[0] for m in METRICS]

# Metric, lower bound, upper bound, hysteresis margin, reason below, reason above.
THRESHOLDS = [
    ("Temp", 18.0, 33.0, 0.5, "Threshold dropped < 18.0 °C", "Threshold exceeded > 33.0 °C"),
    ("Humid", 30.0, 75.0, 2.0, "Severely dry < 30 %", "Hyper-humid > 75 %"),
    ("CO2", None, 1200.0, 50.0, "", "Toxic levels > 1200 ppm"),
    ("TVOC", None, 300.0, 20.0, "", "Hazardous TVOC detected"),
]

# Node positions: view, node, x, y.
POSITIONS = [
    ("grid", "M1", 1.0, 5.5),
    ("grid", "M4", 4.5, 5.5),
    ("grid", "M6", 1.0, 3.0),
    ("grid", "M7", 3.0, 3.0),
    ("grid", "M8", 5.5, 3.0),
    ("grid", "M9", 1.0, 0.8),
    ("grid", "M10", 3.5, 0.8),
    ("grid", "M11", 6.5, 0.8),
    ("v0", "M4", 2191.0, 977.0),
    ("v0", "M6", 2671.0, 1026.0),
    ("v0", "M7", 3320.0, 1162.0),
    ("v0", "M8", 2530.0, 1298.0),
    ("v0", "M9", 2250.0, 581.0),
    ("v0", "M10", 1400.0, 1311.0),
    ("v0", "M11", 1988.0, 1101.0),
    ("v1", "M1", 2704.0, 1535.0),
    ("v1", "M4", 2652.0, 1029.0),
    ("v1", "M6", 2453.0, 1325.0),
    ("v1", "M7", 2781.0, 1938.0),
    ("v1", "M8", 1949.0, 1343.0),
    ("v1", "M9", 2770.0, 755.0),
    ("v1", "M10", 1465.0, 773.0),
    ("v1", "M11", 2123.0, 931.0),
]

# Extent of the default floor grid.
GRID_WIDTH, GRID_HEIGHT = 7.5, 6.8

# Outdoor nodes: node, type, metric, allowed deviation from the weather.
OUTDOOR = [
    ("M7", "outdoor", "Temp", 5.0),
    ("M7", "outdoor", "Humid", 15.0),
    ("M1", "semi_outdoor", "Temp", 8.0),
    ("M1", "semi_outdoor", "Humid", 20.0),
    ("M6", "semi_outdoor", "Temp", 8.0),
    ("M6", "semi_outdoor", "Humid", 20.0),
    ("M8", "semi_outdoor", "Temp", 8.0),
    ("M8", "semi_outdoor", "Humid", 20.0),
    ("M11", "semi_outdoor", "Temp", 8.0),
    ("M11", "semi_outdoor", "Humid", 20.0),
]

# Weather interpretation codes.
WEATHER_CODES = [
    (0, "Clear sky"),
    (1, "Mainly clear"),
    (2, "Partly cloudy"),
    (3, "Overcast"),
    (45, "Fog"),
    (48, "Icy fog"),
    (51, "Light drizzle"),
    (53, "Drizzle"),
    (55, "Heavy drizzle"),
    (61, "Light rain"),
    (63, "Rain"),
    (65, "Heavy rain"),
    (71, "Light snow"),
    (73, "Snow"),
    (75, "Heavy snow"),
    (80, "Light showers"),
    (81, "Showers"),
    (82, "Heavy showers"),
    (95, "Thunderstorm"),
    (96, "Thunderstorm with hail"),
    (99, "Thunderstorm with heavy hail"),
]

# Row counts that stand for time at the 3-minute cadence.
HOUR_ROWS, DAY_ROWS, WEEK_ROWS = 20, 480, 3360
FROZEN_ROWS, COMPARE_ROWS, TRAIN_ROWS, MIN_ROWS = 40, 60, 1200, 40
DEFAULT_STEP_US = 3 * 60 * 1_000_000

# Alert timing in seconds.
ALERT_COOLDOWN_S = 3600
REMINDER_S = 43200
BATCH_WINDOW_S = 120
DRIFT_COOLDOWN_S = 14400
ANOMALY_COOLDOWN_S = 3600
# --- end of fixed values ----------------------------------------------------

CHANNELS = [(node, metric) for node in NODE_IDS for metric in METRIC_IDS]


def _literal(value, sql_type: str) -> str:
    if value is None:
        return f"CAST(NULL AS {sql_type})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {sql_type})"


def values_sql(rows, columns) -> str:
    """``SELECT * FROM (VALUES ...) AS t(...)`` text, valid in Spark and in ANSI SQL."""
    lines = ", ".join(
        "(" + ", ".join(_literal(v, t) for v, (_, t) in zip(row, columns)) + ")" for row in rows
    )
    names = ", ".join(name for name, _ in columns)
    return f"SELECT * FROM (VALUES {lines}) AS t({names})"


NODES_SQL = values_sql(
    [(n, name, i) for i, (n, name) in enumerate(NODES)],
    [("node", "STRING"), ("name", "STRING"), ("ord", "INT")],
)
DEVICES_SQL = values_sql(DEVICES, [("device", "STRING"), ("node", "STRING")])
METRICS_SQL = values_sql(
    METRICS, [("metric", "STRING"), ("unit", "STRING"), ("vmin", "DOUBLE"), ("vmax", "DOUBLE")]
)
THRESHOLDS_SQL = values_sql(
    THRESHOLDS,
    [
        ("metric", "STRING"),
        ("lo", "DOUBLE"),
        ("hi", "DOUBLE"),
        ("margin", "DOUBLE"),
        ("lo_reason", "STRING"),
        ("hi_reason", "STRING"),
    ],
)
POSITIONS_SQL = values_sql(
    POSITIONS, [("view", "STRING"), ("node", "STRING"), ("px", "DOUBLE"), ("py", "DOUBLE")]
)
OUTDOOR_SQL = values_sql(
    OUTDOOR,
    [("node", "STRING"), ("node_type", "STRING"), ("metric", "STRING"), ("max_dev", "DOUBLE")],
)
WEATHER_CODES_SQL = values_sql(WEATHER_CODES, [("code", "INT"), ("description", "STRING")])


def nodes(spark: SparkSession) -> DataFrame:
    return spark.sql(NODES_SQL)


def devices(spark: SparkSession) -> DataFrame:
    return spark.sql(DEVICES_SQL)


def metrics(spark: SparkSession) -> DataFrame:
    return spark.sql(METRICS_SQL)


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.sql(THRESHOLDS_SQL)


def positions(spark: SparkSession, view: str | None = None) -> DataFrame:
    df = spark.sql(POSITIONS_SQL)
    return df if view is None else df.filter(df["view"] == view).drop("view")


def outdoor(spark: SparkSession) -> DataFrame:
    return spark.sql(OUTDOOR_SQL)


def weather_codes(spark: SparkSession) -> DataFrame:
    return spark.sql(WEATHER_CODES_SQL)
