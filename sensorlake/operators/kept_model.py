"""Forecast models that are kept and added to instead of fitted anew.

What a fit needs are sums over its windows: products of raw differences, and the differences' count,
sum and sum of squares. They are stored per day and channel in a ledger, so each change is a version.
New days add rows, the last day is replaced, and a model is solved from the sums of whatever days it
shall cover. Standardising is linear, so it is applied to the sums and not to the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sensorlake.operators import forecast
from sensorlake.operators.forecast import KEYS, LAGS
from sensorlake.sources.ledger import Ledger


def model_store(spark: SparkSession, path: str) -> Ledger:
    """Sums per day (``at``, its beginning) and channel."""
    return Ledger(spark, path, ["at", *KEYS], ts="at")


def daily_sums(frame: DataFrame, lags: int = LAGS) -> DataFrame:
    """``at, node, metric, n_delta, s_delta, q_delta, n_windows, products`` of the frame's days.

    ``products`` are the sums of ``(1, x) (1, x, y)`` over the windows that end on the day, row by row;
    null on a day without a full window.
    """
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("at")
    deltas = forecast.differences(frame).withColumn("z", F.col("delta"))
    moments = deltas.filter("delta IS NOT NULL").groupBy(day, *KEYS).agg(
        F.count("delta").alias("n_delta"), F.sum("delta").alias("s_delta"), F.sum(F.col("delta") * F.col("delta")).alias("q_delta")
    )
    windows = forecast.lag_windows(deltas, lags).withColumn("at", day)
    products = forecast.normal_sums(windows, ["at", *KEYS], lags).withColumnRenamed("s", "products")
    return moments.join(products, ["at", *KEYS], "left").withColumn(
        "n_windows", F.coalesce(F.col("products")[0], F.lit(0.0)).cast("long")
    ).select("at", *KEYS, "n_delta", "s_delta", "q_delta", "n_windows", "products")


def refresh(store: Ledger, frame: DataFrame, force: bool = False, lags: int = LAGS) -> str:
    """Brings the stored sums up to the frame: ``"fitted"`` anew where there are none, the channels
    changed or ``force`` is set, else ``"extended"`` by the days from the last stored one on.

    An extension reads the rows of these days and the ``lags + 1`` before them. The frame's positions
    must count the same rows as before.
    """
    known = None if store.snapshot()["schema"] is None else store.read()
    if forecast.must_retrain(known, frame, force):
        store.replace(daily_sums(frame, lags))
        return "fitted"
    last = known.agg(F.max("at")).first()[0]
    first = frame.filter(F.col("ts") >= F.lit(last).cast("timestamp_ntz")).agg(F.min("pos")).first()[0]
    if first is not None:
        recent = frame.filter(F.col("pos") >= first - lags - 1)
        store.upsert(daily_sums(recent, lags).filter(F.col("at") >= F.lit(last).cast("timestamp_ntz")))
    return "extended"


def totals(store: Ledger, days: int | None = None, version: int | None = None) -> DataFrame:
    """The sums of the newest ``days`` (all by default) per channel."""
    sums = store.read(version)
    if days is not None:
        newest = sums.agg(F.max("at")).scalar()
        sums = sums.filter(F.col("at") > newest - F.expr(f"INTERVAL {days} DAYS"))
    names = ["n_delta", "s_delta", "q_delta", "n_windows"]
    scalars = sums.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in names])
    entries = (
        sums.select(*KEYS, F.posexplode("products").alias("place", "part"))
        .groupBy(*KEYS, "place")
        .agg(F.sum("part").alias("part"))
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
        .select(*KEYS, F.col("p.part").alias("products"))
    )
    return scalars.join(entries, KEYS)


def kept_model(store: Ledger, days: int | None = None, version: int | None = None, lags: int = LAGS) -> DataFrame:
    """``node, metric, mu, sigma, beta`` solved from the stored sums: the scaler and coefficients that a
    fit over all rows of these days gives. Channels without a window have none."""
    sums = totals(store, days, version)
    key_fields = [sums.schema[k] for k in KEYS]
    out = StructType(
        [*key_fields, StructField("mu", DoubleType()), StructField("sigma", DoubleType()),
         StructField("beta", ArrayType(DoubleType())), StructField("n_windows", LongType())]
    )
    size = lags + 1

    def solve(batches):
        for pdf in batches:
            rows = []
            for n, s, q, products in zip(pdf["n_delta"], pdf["s_delta"], pdf["q_delta"], pdf["products"]):
                mu = s / n
                sigma = float(np.sqrt(max(q / n - mu * mu, 0.0)))
                sigma = 1.0 if sigma < 1e-8 else sigma
                # (1, x, y) -> (1, (x - mu) / sigma, (y - mu) / sigma)
                scale = np.diag(np.r_[1.0, np.full(size, 1 / sigma)])
                scale[1:, 0] = -mu / sigma
                both = scale[:size, :size] @ np.asarray(products).reshape(size, size + 1) @ scale.T
                rows.append((mu, sigma, np.linalg.lstsq(both[:, :size], both[:, size], rcond=1e-10)[0].tolist()))
            fitted = pd.DataFrame(rows, columns=["mu", "sigma", "beta"], index=pdf.index)
            yield pd.concat([pdf[KEYS], fitted, pdf[["n_windows"]]], axis=1)

    return sums.mapInPandas(solve, out)


def predict_kept(frame: DataFrame, model: DataFrame, lags: int = LAGS) -> DataFrame:
    """Next values of ``frame`` by a stored model, without a fit: only the last rows are read."""
    tail = forecast.last_rows(frame, lags + 1)
    scaled = forecast.standardise(forecast.differences(tail), model.select(*KEYS, "mu", "sigma"))
    return forecast.predict_next(forecast.latest_window(scaled, lags), model.select(*KEYS, "beta"))
