"""One-step forecasts on standardised first differences.

The model is a linear autoregression per channel over the last ``lags`` differences, with an
intercept, solved from normal equations that Spark sums up. Only the small coefficient systems
(``lags + 1`` unknowns per channel and ensemble member) are solved in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sensorlake import schema
from sensorlake.functions.times import from_micros, micros
from sensorlake.operators.blocks import BLOCK_ROWS, rows_frame
from sensorlake.operators.series import last_rows, sampling_step

KEYS = ["node", "metric"]
LAGS = 20


class ForecastError(RuntimeError):
    """Too few rows to fit or to predict."""


def differences(frame: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``delta``, the change from the previous frame row (null in the first)."""
    return rows_frame(
        frame,
        KEYS,
        {"delta": lambda w: F.col("value") - F.lag("value").over(w)},
        before=1,
        after=0,
        block_rows=block_rows,
    )


def delta_scaler(deltas: DataFrame) -> DataFrame:
    """Mean and spread of the differences per channel; a spread near zero counts as 1."""
    spread = F.stddev_pop("delta")
    return deltas.groupBy(*KEYS).agg(
        F.avg("delta").alias("mu"),
        F.when(spread < 1e-8, 1.0).otherwise(spread).alias("sigma"),
    )


def standardise(deltas: DataFrame, scaler: DataFrame) -> DataFrame:
    return deltas.join(scaler, KEYS).withColumn("z", (F.col("delta") - F.col("mu")) / F.col("sigma"))


def lag_windows(scaled: DataFrame, lags: int = LAGS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``x``, the ``lags`` standardised differences before the row; only full windows stay.

    ``y`` is the row's own standardised difference, the one-step-ahead target.
    """
    rows = rows_frame(
        scaled,
        KEYS,
        {"x": lambda w: F.collect_list("z").over(w.rowsBetween(-lags, -1))},
        before=lags,
        after=0,
        block_rows=block_rows,
    )
    return rows.filter((F.size("x") == lags) & F.col("z").isNotNull()).withColumn("y", F.col("z"))


def latest_window(scaled: DataFrame, lags: int = LAGS) -> DataFrame:
    """Per channel the newest ``lags`` standardised differences, oldest first, with the level."""
    tail = last_rows(scaled, lags)
    window = F.array_sort(F.collect_list(F.struct("pos", "z")))
    return (
        tail.groupBy(*KEYS)
        .agg(
            F.transform(window, lambda r: r["z"]).alias("x"),
            F.count("z").alias("_n"),
            F.max("ts").alias("ts"),
            F.max_by("value", "pos").alias("level"),
            F.first("mu").alias("mu"),
            F.first("sigma").alias("sigma"),
        )
        .filter(F.col("_n") == lags)
        .drop("_n")
    )


def training_rows(frame: DataFrame, rows: int = schema.TRAIN_ROWS, lags: int = LAGS) -> DataFrame:
    return last_rows(frame, max(rows, lags + 2))


def normal_sums(windows: DataFrame, keys: list[str] = KEYS, lags: int = LAGS, weight=None) -> DataFrame:
    """``keys, s``: the sums of ``(1, x) (1, x, y)`` over the windows, row by row.

    Tasks add up one small matrix per key, and Spark sums these entry by entry.
    """
    size = lags + 1
    rows = windows.select(*keys, "x", "y", (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"))
    key_fields = [rows.schema[k] for k in keys]
    matrix = StructType([*key_fields, StructField("s", ArrayType(DoubleType()))])

    def packed(sums):
        ids, arrays = list(sums), [m.ravel().tolist() for m in sums.values()]
        return pd.DataFrame({**{k: [i[n] for i in ids] for n, k in enumerate(keys)}, "s": arrays})

    def add_up(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                w = part["_w"].to_numpy()
                terms = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy()), part["y"].to_numpy()])
                gram = (terms[:, :size] * w[:, None]).T @ terms
                sums[key] = sums[key] + gram if key in sums else gram
            if len(sums) > 5_000:
                yield packed(sums)
                sums = {}
        if sums:
            yield packed(sums)

    return (
        rows.mapInPandas(add_up, matrix)
        .select(*keys, F.posexplode("s").alias("_place", "_part"))
        .groupBy(*keys, "_place")
        .agg(F.sum("_part").alias("_part"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_part"))).alias("s"))
        .select(*keys, F.col("s._part").alias("s"))
    )


def fit(windows: DataFrame, keys: list[str] = KEYS, lags: int = LAGS, weight=None) -> DataFrame:
    """Coefficients ``(intercept, b1 .. bL)`` per key from distributed normal equations; only the sums
    of a key meet for the solve."""
    size = lags + 1
    totals = normal_sums(windows, keys, lags, weight)
    out = StructType([*[totals.schema[k] for k in keys], StructField("beta", ArrayType(DoubleType()))])

    def solve(batches):
        for pdf in batches:
            betas = []
            for entries in pdf["s"]:
                both = np.asarray(entries).reshape(size, size + 1)
                betas.append(np.linalg.lstsq(both[:, :size], both[:, size], rcond=1e-10)[0].tolist())
            yield pdf[keys].assign(beta=pd.Series(betas, index=pdf.index))

    return totals.mapInPandas(solve, out)


def _predicted_z():
    pairs = F.zip_with("x", F.slice("beta", 2, F.size("x")), lambda a, b: a * b)
    return F.col("beta")[0] + F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def predict_next(window: DataFrame, model: DataFrame) -> DataFrame:
    """Next level per channel: last level plus the de-standardised predicted difference."""
    return (
        window.join(model, KEYS)
        .withColumn("predicted", F.col("level") + (_predicted_z() * F.col("sigma") + F.col("mu")))
        .withColumn("delta", F.col("predicted") - F.col("level"))
        .select("ts", *KEYS, F.col("level").alias("current"), "predicted", "delta")
    )


def snapshot(predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Predictions with issue and target time; the step is the frame's median gap."""
    step = sampling_step(readings).scalar()
    issue = F.col("ts")
    target = from_micros((micros(issue) + step).cast("bigint"))
    return predictions.select(
        issue.alias("issue_ts"), target.alias("target_ts"), *KEYS, "current", "predicted", "delta"
    )


def module_payloads(forecasts: DataFrame) -> DataFrame:
    """One row per node and forecast, in text order of the node: maps and feature list of its metrics.
    The times stand in the order as well, so that the sort has more ranges than nodes."""

    def mapped(column):
        entries = F.array_sort(F.collect_list(F.struct("metric", column)))
        return F.map_from_entries(entries).alias(column)

    features = F.array_sort(
        F.collect_list(F.struct(F.col("metric").alias("name"), "current", "predicted", "delta"))
    )
    return (
        forecasts.groupBy("node", "issue_ts", "target_ts")
        .agg(mapped("current"), mapped("predicted"), mapped("delta"), features.alias("features"))
        .orderBy("node", "issue_ts", "target_ts")
    )


def naive(frame: DataFrame, lag: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Persistence forecast: the value ``lag`` rows earlier, as ``pred``."""
    return rows_frame(
        frame,
        KEYS,
        {"pred": lambda w: F.lag("value", lag).over(w)},
        before=lag,
        after=0,
        block_rows=block_rows,
    ).filter(F.col("pred").isNotNull())


def persistence_members(frame: DataFrame, members: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """An ensemble without a model: member ``k`` predicts the value ``k`` rows earlier."""

    def lagged(k):
        return lambda w: F.lag("value", k).over(w)

    names = {f"{k}": lagged(k) for k in range(1, members + 1)}
    wide = rows_frame(frame, KEYS, names, before=members, after=0, block_rows=block_rows)
    return (
        wide.unpivot(["ts", *KEYS], list(names), "member", "pred")
        .withColumn("member", F.col("member").cast("int"))
        .filter(F.col("pred").isNotNull())
    )


def bagged_fit(windows: DataFrame, members: int = 5, lags: int = LAGS) -> DataFrame:
    """One model per ensemble member on a bootstrap whose weights come from a row hash.

    A retried task draws the same weights again, so lost executors do not change the result.
    """
    spread = windows.withColumn(
        "member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))
    )
    # Weights 0, 1, 2 with mean 1, as a bootstrap would give on average.
    weight = F.pmod(F.xxhash64("node", "metric", "pos", "member"), F.lit(3)).cast("double")
    return fit(spread, [*KEYS, "member"], lags, weight)


def ensemble(predictions: DataFrame) -> DataFrame:
    """Mean and sample spread over the members; a single member has spread 0."""
    return predictions.groupBy("ts", *KEYS).agg(
        F.avg("pred").alias("mean"), F.coalesce(F.stddev_samp("pred"), F.lit(0.0)).alias("std")
    )


def predict_history(
    frame: DataFrame, models: DataFrame, scaler: DataFrame, lags: int = LAGS
) -> DataFrame:
    """One-step predictions of every member for every row that has a full window.

    The first is at frame position ``lags + 1``; the base level is the row before it.
    """
    windows = lag_windows(standardise(differences(frame), scaler), lags)
    base = F.col("value") - F.col("delta")
    return windows.join(models, KEYS).select(
        "ts", "pos", *KEYS, "member", F.col("value").alias("truth"),
        (base + (_predicted_z() * F.col("sigma") + F.col("mu"))).alias("pred"),
    )


def channel_drift(fitted: DataFrame, current: DataFrame) -> DataFrame:
    """Channels on one side only, with the side they are missing from."""
    a, b = fitted.select(*KEYS).distinct(), current.select(*KEYS).distinct()
    gone = a.exceptAll(b).withColumn("side", F.lit("missing in data"))
    new = b.exceptAll(a).withColumn("side", F.lit("missing in model"))
    return gone.unionByName(new)


def must_retrain(fitted: DataFrame | None, current: DataFrame, force: bool = False) -> bool:
    """Retrain when there is no model, when forced, or when the channels changed."""
    return force or fitted is None or not channel_drift(fitted, current).isEmpty()


def require_rows(frame: DataFrame, lags: int = LAGS) -> None:
    n = frame.select("ts").distinct().limit(lags + 2).count()
    if n < lags + 2:
        raise ForecastError(f"Need at least {lags + 2} rows, received {n}.")
