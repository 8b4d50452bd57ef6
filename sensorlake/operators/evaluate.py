"""Forecast evaluation: alignment, reconciliation, rolling errors, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sensorlake.functions.times import MINUTE_US, from_micros
from sensorlake.operators.asof import match_times
from sensorlake.operators.blocks import BLOCK_ROWS, rows_frame, with_position

KEYS = ["node", "metric"]


def tolerance_us(step_us: float) -> int:
    """How far a reading may lie from the forecast target: half a step, a minute at least."""
    return max(MINUTE_US, int(step_us // 2))


def reconcile(log: DataFrame, readings: DataFrame, tolerance: int) -> DataFrame:
    """Fills forecasts with the readings at the frame time nearest to their target.

    The frame time is chosen once per target, then every channel takes its value at that time.
    ``ground_truth_matched`` holds when all channels of the (issue, target) pair have one.
    """
    targets = log.select(F.col("target_ts").alias("ts")).filter(F.col("ts").isNotNull())
    near = match_times(
        targets, readings.select("ts"), direction="nearest", tolerance_us=tolerance
    ).select(from_micros("at_us").alias("target_ts"), from_micros("match_us").alias("gt_ts"))
    truth = readings.select(
        F.col("ts").alias("_at"), *KEYS, F.col("value").alias("gt")
    ).filter(F.col("gt").isNotNull())
    # Targets without a frame time join on their own time, so that they do not all meet in the
    # partition of the null key; whatever they hit is blanked.
    filled = (
        log.join(near, "target_ts", "left")
        .withColumn("_at", F.coalesce("gt_ts", "target_ts"))
        .join(truth, ["_at", *KEYS], "left")
        .withColumn(
            "gt", F.when(F.col("pred").isNotNull() & F.col("gt_ts").isNotNull(), F.col("gt"))
        )
        .withColumn("residual", F.col("gt") - F.col("pred"))
        .withColumn("abs_error", F.abs("residual"))
        .withColumn("matched", F.col("residual").isNotNull())
    )
    # One shuffle by the pair, whose rows are as many as the fleet has channels. Rows without an issue
    # or target time stay unresolved; they are spread by channel, not gathered under the null pair.
    whole = F.col("issue_ts").isNotNull() & F.col("target_ts").isNotNull()
    pair = Window.partitionBy("issue_ts", "target_ts", *[F.when(~whole, F.col(k)) for k in KEYS])
    joined = filled.withColumn("ground_truth_matched", whole & F.bool_and("matched").over(pair))
    return joined.select(
        "issue_ts", "target_ts", *KEYS, "pred", "gt_ts", "gt", "matched", "residual", "abs_error",
        "ground_truth_matched",
    )


def align(truth: DataFrame, mean: DataFrame, std: DataFrame) -> DataFrame:
    """Truth, prediction and spread on their common times, with the residual."""
    keys = ["ts", *KEYS]
    return (
        truth.select(*keys, F.col("value").alias("truth"))
        .join(mean.select(*keys, F.col("value").alias("mean")), keys)
        .join(std.select(*keys, F.col("value").alias("std")), keys)
        .withColumn("residual", F.col("truth") - F.col("mean"))
    )


def common_times(truth: DataFrame, mean: DataFrame, std: DataFrame) -> DataFrame:
    return truth.select("ts").intersect(mean.select("ts")).intersect(std.select("ts"))


def rolling_errors(
    evaluation: DataFrame, window_rows: int = 30, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Trailing MAE and RMSE of the error averaged over all channels of a timestamp."""
    per_ts = evaluation.groupBy("ts").agg(
        F.avg(F.abs("residual")).alias("mae"),
        F.avg(F.col("residual") * F.col("residual")).alias("mse"),
    )
    return _rolling(with_position(per_ts, []), [], window_rows, block_rows)


def rolling_errors_per_channel(
    evaluation: DataFrame, window_rows: int = 20, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    rows = with_position(evaluation, KEYS).withColumn("mae", F.abs("residual")).withColumn(
        "mse", F.col("residual") * F.col("residual")
    )
    return _rolling(rows, KEYS, window_rows, block_rows)


def _rolling(rows, keys, window_rows, block_rows):
    def over(w):
        return w.rowsBetween(1 - window_rows, 0)

    return rows_frame(
        rows,
        keys,
        {
            "rolling_mae": lambda w: F.avg("mae").over(over(w)),
            "rolling_rmse": lambda w: F.sqrt(F.avg("mse").over(over(w))),
        },
        before=window_rows - 1,
        after=0,
        block_rows=block_rows,
    ).select("ts", *keys, "rolling_mae", "rolling_rmse")


def with_interval(evaluation: DataFrame, z: float = 1.96) -> DataFrame:
    """Adds ``lower``, ``upper`` and whether the truth lies between them."""
    radius = F.col("std") * z
    return (
        evaluation.withColumn("lower", F.col("mean") - radius)
        .withColumn("upper", F.col("mean") + radius)
        .withColumn("covered", F.col("truth").between(F.col("lower"), F.col("upper")))
    )


def coverage(evaluation: DataFrame, z: float = 1.96) -> DataFrame:
    return with_interval(evaluation, z).groupBy(*KEYS).agg(
        F.count("covered").alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage")
    )


def residual_histogram(evaluation: DataFrame, bins: int = 40) -> DataFrame:
    """Counts in equal-width residual bins per channel; the greatest value is in the last bin."""
    known = evaluation.filter(F.col("residual").isNotNull())
    ends = known.groupBy(*KEYS).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    number = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(
        F.least(
            F.floor((F.col("residual") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1,
            F.lit(bins),
        )
    )
    return (
        known.join(ends, KEYS)
        .withColumn("bin", number.cast("int"))
        .groupBy(*KEYS, "lo", "hi", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sensor_drift(readings: DataFrame, weather: DataFrame, outdoor: DataFrame) -> DataFrame:
    """Outdoor readings that differ from the weather by more than the node allows.

    ``weather`` is ``(ts, metric, value)``; each reading meets the last entry at or before it.
    """
    watched = readings.filter(F.col("value").isNotNull()).join(outdoor, KEYS)
    near = match_times(watched, weather, ["metric"]).select(
        "metric", from_micros("at_us").alias("ts"), from_micros("match_us").alias("weather_ts")
    )
    known = weather.select(
        F.col("ts").alias("weather_ts"), "metric", F.col("value").alias("weather")
    )
    return (
        watched.join(near, ["metric", "ts"])
        .join(known, ["metric", "weather_ts"])
        .withColumn("deviation", F.abs(F.col("value") - F.col("weather")))
        .filter(F.col("deviation") > F.col("max_dev"))
        .select("ts", *KEYS, "node_type", "value", "weather_ts", "weather", "deviation")
    )
