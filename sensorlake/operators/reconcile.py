"""Reconciling a growing forecast log: each run touches what is still open, and keeps the rest.

The log's state is a ledger with one row per forecast. A run takes new forecasts and the readings of
its time; older readings may be gone by then. A forecast keeps the nearest reading so far and is settled
once no later reading can be nearer, so runs one after the other end where one run over all readings
would have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sensorlake.functions.times import micros
from sensorlake.operators.evaluate import reconcile
from sensorlake.sources.ledger import Ledger

FORECAST = ["issue_ts", "target_ts", "node", "metric"]
FOUND = ["gt_ts", "gt", "residual", "abs_error", "matched"]


def reconciled_log(spark: SparkSession, path: str) -> Ledger:
    """The state: ``FORECAST, pred, FOUND, settled``, stored by the target's day."""
    return Ledger(spark, path, FORECAST, ts="target_ts")


def reconcile_run(state: Ledger, forecasts: DataFrame, readings: DataFrame, tolerance_us: int) -> None:
    """Adds ``forecasts`` (``FORECAST, pred``) and matches all open ones with ``readings``.

    Only the days that the readings reach are read, and of these only forecasts that are not settled
    are matched and written. A forecast that comes again keeps what was found for it. Forecasts without
    issue or target time, node or metric are left out; they could never be matched.
    """
    new = forecasts.select(*FORECAST, "pred").dropna(subset=FORECAST).dropDuplicates(FORECAST)
    ends = readings.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    known = _near(state, new, ends, tolerance_us)
    blank = [F.lit(None).cast(t).alias(f"_{c}") for c, t in zip(FOUND, ("timestamp_ntz", "double", "double", "double", "boolean"))]
    if known is None:
        pending = new.select("*", *blank)
    else:
        old = known.filter(~F.col("settled")).select(*FORECAST, "pred", *[F.col(c).alias(f"_{c}") for c in FOUND])
        pending = old.unionByName(new.join(known.select(*FORECAST), FORECAST, "left_anti").select("*", *blank))
    found = reconcile(pending.select(*FORECAST, "pred"), readings, tolerance_us).select(*FORECAST, *FOUND)

    def away(column):
        return F.abs(micros(column) - micros("target_ts"))

    nearer = F.col("gt_ts").isNotNull() & (F.col("_gt_ts").isNull() | (away("gt_ts") <= away("_gt_ts")))
    merged = pending.join(found, FORECAST)
    picked = merged.select(
        *FORECAST, "pred", *[F.when(nearer, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in FOUND]
    ).withColumn("matched", F.coalesce("matched", F.lit(False)))
    # A reading still to come lies beyond the last one.
    reach = F.lit(None).cast("timestamp_ntz") if ends["b"] is None else F.lit(ends["b"]).cast("timestamp_ntz")
    settled = micros(reach) - micros("target_ts") >= F.coalesce(away("gt_ts"), F.lit(tolerance_us))
    state.upsert(picked.withColumn("settled", F.coalesce(settled, F.lit(False))))


def _near(state: Ledger, new: DataFrame, ends, tolerance_us: int) -> DataFrame | None:
    """The stored forecasts whose targets the readings or the new forecasts reach."""
    if state.snapshot()["schema"] is None:
        return None
    own = new.agg(F.min("target_ts").alias("a"), F.max("target_ts").alias("b")).first()
    lows, highs = [x for x in (ends["a"], own["a"]) if x], [x for x in (ends["b"], own["b"]) if x]
    if not lows:
        return None
    reach = F.expr(f"INTERVAL '{tolerance_us / 1e6:.6f}' SECOND")
    days = state.spark.range(1).select(
        (F.lit(min(lows)).cast("timestamp_ntz") - reach).cast("date").cast("string").alias("a"),
        (F.lit(max(highs)).cast("timestamp_ntz") + reach).cast("date").cast("string").alias("b"),
    ).first()
    return state.read(days=(days["a"], days["b"]))


def reconciled(state: Ledger) -> DataFrame:
    """The log as it stands, with ``ground_truth_matched`` where all channels of an issue and target
    time have their reading."""
    pair = Window.partitionBy("issue_ts", "target_ts")
    return state.read().withColumn("ground_truth_matched", F.bool_and("matched").over(pair))
