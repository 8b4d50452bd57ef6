"""The cleaning gate, step by step, on the frame of means."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.operators import clean
from sensorlake.operators.clean import KEYS
from sensorlake.plans.base import (
    CLEAN,
    FLAGGED,
    FRAME,
    READINGS,
    clean_frame,
    frame,
    neighbours_sql,
    query,
    readings,
    rounded,
)


# A frame with faults: M8's thermometer stands still for sixty rows, M10's CO2 sensor never answered.
PLANTED = """planted AS (SELECT ts, pos, node, metric,
  CASE WHEN node = 'M10' AND metric = 'CO2' THEN NULL
    WHEN node = 'M8' AND metric = 'Temp' AND pos BETWEEN 100 AND 159 THEN 21.5
    ELSE value END AS value FROM frame)"""
PLANTED_FLAGGED = FLAGGED.replace(FRAME, f"{FRAME}, {PLANTED}").replace("  FROM frame\n  WINDOW", "  FROM planted\n  WINDOW")


def planted(spark, d):
    silent = (F.col("node") == "M10") & (F.col("metric") == "CO2")
    still = (F.col("node") == "M8") & (F.col("metric") == "Temp") & F.col("pos").between(100, 159)
    value = F.when(~silent, F.when(still, 21.5).otherwise(F.col("value")))
    return frame(spark, d).withColumn("value", value)


@query(
    "e01_flatline_mask",
    f"""WITH {PLANTED_FLAGGED}
    SELECT epoch_us(ts) AS ts_us, node, metric, roll_n, round(roll_var + 1.7e-6, 3) AS roll_var,
      CAST(is_flat AS INT) AS is_flat FROM unflat""",
)
def _(spark, d):
    # Variances of ten or twenty short decimals are multiples of 2.5e-7, and so is the usual nudge.
    off_edge = F.col("roll_var") + 1.7e-6
    return clean.flatlines(planted(spark, d)).select(
        "ts", *KEYS, "roll_n", rounded(off_edge, 3).alias("roll_var"), "is_flat"
    )


@query(
    "d01_zscore_outliers",
    f"""WITH {FLAGGED}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(zscore, 6) AS zscore,
      CAST(is_outlier AS INT) AS is_outlier FROM flagged""",
)
def _(spark, d):
    return clean.flagged(frame(spark, d)).select("ts", *KEYS, "zscore", "is_outlier")


@query(
    "d02_quality_report",
    f"""WITH {PLANTED_FLAGGED}, {neighbours_sql("flagged", "kept")}, filled AS (
      SELECT *, coalesce(kept, v0, v1) IS NOT NULL AS there FROM near)
    SELECT node, metric, count(*) AS n_rows, count(value) AS n_in,
      count(*) FILTER (WHERE is_flat) AS n_flat, count(*) FILTER (WHERE is_outlier) AS n_outlier,
      count(kept) AS n_kept, CAST(count(kept) = 0 AS INT) AS dropped,
      CASE WHEN count(kept) = 0 THEN 0 ELSE count(*) FILTER (WHERE there) - count(kept) END AS n_filled,
      CASE WHEN count(kept) = 0 THEN 0 ELSE count(*) - count(*) FILTER (WHERE there) END
        AS n_missing_after, CAST(count(*) >= 40 AS INT) AS enough_rows
    FROM filled GROUP BY node, metric""",
)
def _(spark, d):
    return clean.quality_report(planted(spark, d))


@query(
    "clean_gate_with_faults",
    f"""WITH {PLANTED_FLAGGED}, {neighbours_sql("flagged", "kept")}
    SELECT epoch_us(ts) AS ts_us, pos, node, metric,
      round(coalesce(kept, v0 + (v1 - v0) / (p1 - p0) * (pos - p0), v0, v1), 6) AS value
    FROM near WHERE coalesce(v0, v1) IS NOT NULL""",
)
def _(spark, d):
    return clean.gated_clean(planted(spark, d))


# Node M11 stands for a node whose humidity sensor never answered.
SILENCED = """silenced AS (SELECT ts, pos, node, metric,
  CASE WHEN NOT (node = 'M11' AND metric = 'Humid') THEN value END AS value FROM frame)"""


@query(
    "d03_drop_dead_channels",
    f"""WITH {FRAME}, {SILENCED}
    SELECT epoch_us(ts) AS ts_us, pos, node, metric, round(value, 6) AS value FROM silenced
    WHERE (node, metric) IN (SELECT (node, metric) FROM silenced GROUP BY node, metric
      HAVING count(value) > 0)""",
)
def _(spark, d):
    dead = (F.col("node") == "M11") & (F.col("metric") == "Humid")
    rows = frame(spark, d).withColumn("value", F.when(~dead, F.col("value")))
    return clean.drop_dead_channels(rows)


@query(
    "d04_minimum_rows",
    f"""WITH {READINGS}
    SELECT count(DISTINCT ts) AS n_rows, CAST(count(DISTINCT ts) >= 40 AS INT) AS enough_rows
    FROM readings""",
)
def _(spark, d):
    return clean.row_gate(readings(spark, d))


@query(
    "d04_minimum_rows_by_export",
    f"""WITH {READINGS}
    SELECT CAST(ts AS DATE)::VARCHAR AS day, node, count(DISTINCT ts) AS n_rows,
      CAST(count(DISTINCT ts) >= 40 AS INT) AS enough_rows
    FROM readings GROUP BY ALL""",
)
def _(spark, d):
    """An export for each node and day, some of them too short."""
    exported = readings(spark, d).withColumn("day", F.to_date("ts"))
    return clean.row_gate(exported, by=["day", "node"])


@query(
    "e02_linear_interpolation",
    f"""WITH {FRAME}, {neighbours_sql("frame", "value")}
    SELECT epoch_us(ts) AS ts_us, node, metric,
      round(coalesce(value, v0 + (v1 - v0) / (p1 - p0) * (pos - p0), v0, v1), 6) AS filled
    FROM near""",
)
def _(spark, d):
    return clean.interpolate(frame(spark, d)).select("ts", *KEYS, "filled")


@query(
    "e03_forward_backward_fill",
    f"""WITH {FRAME}, {neighbours_sql("frame", "value")}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(coalesce(value, v0, v1), 6) AS filled
    FROM near""",
)
def _(spark, d):
    return clean.fill_forward_backward(frame(spark, d)).select("ts", *KEYS, "filled")


@query(
    "clean_gate",
    f"""WITH {CLEAN}
    SELECT epoch_us(ts) AS ts_us, pos, node, metric, round(value, 6) AS value FROM cleaned""",
)
def _(spark, d):
    return clean_frame(spark, d)
