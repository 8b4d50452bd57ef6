"""Forecasts, their log and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.functions.text import fixed_text
from sensorlake.functions.times import MINUTE_US
from sensorlake.operators import evaluate, forecast, kept_model, reconcile, series
from sensorlake.operators.series import KEYS
from sensorlake.plans.base import CLEAN, clean_frame, grid, query, readings, rounded
from sensorlake.session import materialise, work_dir

MEMBERS = 5


def settled(spark, d):
    """The cleaned frame, written once: forecasting reads it several times."""
    return materialise(clean_frame(spark, d))


DELTAS = f"""{CLEAN}, deltas AS (
  SELECT *, value - lag(value) OVER (PARTITION BY node, metric ORDER BY pos) AS delta
  FROM cleaned)"""
SCALER = f"""{DELTAS}, scaler AS (
  SELECT node, metric, avg(delta) AS mu,
    CASE WHEN stddev_pop(delta) < 1e-8 THEN 1 ELSE stddev_pop(delta) END AS sigma
  FROM deltas GROUP BY node, metric)"""


@query(
    "e08_first_differences",
    f"""WITH {DELTAS}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(delta, 6) AS delta FROM deltas""",
)
def _(spark, d):
    return forecast.differences(clean_frame(spark, d)).select("ts", *KEYS, "delta")


@query(
    "d13_delta_scaler",
    f"WITH {SCALER} SELECT node, metric, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM scaler",
)
def _(spark, d):
    return forecast.delta_scaler(forecast.differences(clean_frame(spark, d)))


@query(
    "e09_supervised_windows",
    f"""WITH {SCALER}, scaled AS (
      SELECT d.*, (delta - mu) / sigma AS z FROM deltas d JOIN scaler USING (node, metric)),
    w AS (
      SELECT *, count(z) OVER l AS n, sum(z) OVER l AS x_sum, first_value(z) OVER l AS x_first,
        last_value(z) OVER l AS x_last FROM scaled
      WINDOW l AS (PARTITION BY node, metric ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT epoch_us(ts) AS ts_us, pos, node, metric, round(x_first, 6) AS x_first,
      round(x_last, 6) AS x_last, round(x_sum, 6) AS x_sum, round(z, 6) AS y FROM w
    WHERE n = 20 AND z IS NOT NULL""",
)
def _(spark, d):
    deltas = forecast.differences(settled(spark, d))
    windows = forecast.lag_windows(forecast.standardise(deltas, forecast.delta_scaler(deltas)))
    return windows.select(
        "ts", "pos", *KEYS,
        F.element_at("x", 1).alias("x_first"),
        F.element_at("x", -1).alias("x_last"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
        "y",
    )


NAIVE = f"""{CLEAN}, naive AS (
  SELECT *, lag(value) OVER (PARTITION BY node, metric ORDER BY pos) AS pred FROM cleaned)"""


@query(
    "j06_naive_baseline",
    f"""WITH {NAIVE}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(value, 6) AS truth, round(pred, 6) AS pred
    FROM naive WHERE pred IS NOT NULL""",
)
def _(spark, d):
    return forecast.naive(clean_frame(spark, d)).select(
        "ts", *KEYS, F.col("value").alias("truth"), "pred"
    )


# Evaluation runs on an ensemble of persistence forecasts, which SQL can state too:
# member k predicts the value k rows earlier.
ENSEMBLE = f"""{CLEAN}, members AS (
  {" UNION ALL ".join(
    f"SELECT ts, node, metric, {k} AS member, lag(value, {k}) OVER (PARTITION BY node, metric"
    f" ORDER BY pos) AS pred FROM cleaned" for k in range(1, MEMBERS + 1))}),
ensemble AS (
  SELECT ts, node, metric, avg(pred) AS mean, coalesce(stddev_samp(pred), 0) AS std
  FROM members WHERE pred IS NOT NULL GROUP BY ts, node, metric),
evaluation AS (
  SELECT c.ts, c.node, c.metric, c.value AS truth, e.mean, e.std, c.value - e.mean AS residual
  FROM cleaned c JOIN ensemble e USING (ts, node, metric))"""


def evaluation(spark, d):
    rows = settled(spark, d)
    both = materialise(forecast.ensemble(forecast.persistence_members(rows, MEMBERS)))
    mean = both.select("ts", *KEYS, F.col("mean").alias("value"))
    std = both.select("ts", *KEYS, F.col("std").alias("value"))
    return evaluate.align(rows, mean, std)


@query(
    "d14_ensemble_spread",
    f"""WITH {ENSEMBLE}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(mean, 6) AS mean, round(std, 6) AS std
    FROM ensemble""",
)
def _(spark, d):
    return forecast.ensemble(
        forecast.persistence_members(settled(spark, d), MEMBERS)
    )


@query(
    "c02_aligned_evaluation",
    f"""WITH {ENSEMBLE}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(truth, 6) AS truth, round(mean, 6) AS mean,
      round(std, 6) AS std, round(residual, 6) AS residual FROM evaluation""",
)
def _(spark, d):
    return evaluation(spark, d)


@query(
    "g03_common_times",
    f"""WITH {CLEAN}, e AS (SELECT ts FROM cleaned WHERE pos >= 1), f AS (SELECT ts FROM cleaned
      WHERE pos >= 21)
    SELECT DISTINCT epoch_us(c.ts) AS ts_us FROM cleaned c JOIN e USING (ts) JOIN f USING (ts)""",
)
def _(spark, d):
    rows = settled(spark, d)
    return evaluate.common_times(rows, rows.filter("pos >= 1"), rows.filter("pos >= 21"))


ROLLING = "ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


@query(
    "e06_rolling_errors",
    f"""WITH {ENSEMBLE}, e AS (
      SELECT ts, avg(abs(residual)) AS mae, avg(residual * residual) AS mse FROM evaluation
      GROUP BY ts)
    SELECT epoch_us(ts) AS ts_us, round(avg(mae) OVER w, 6) AS rolling_mae,
      round(sqrt(avg(mse) OVER w), 6) AS rolling_rmse FROM e
    WINDOW w AS (ORDER BY ts {ROLLING.format(n=29)})""",
)
def _(spark, d):
    return evaluate.rolling_errors(evaluation(spark, d))


@query(
    "e07_rolling_errors_per_channel",
    f"""WITH {ENSEMBLE}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(avg(abs(residual)) OVER w, 6) AS rolling_mae,
      round(sqrt(avg(residual * residual) OVER w), 6) AS rolling_rmse FROM evaluation
    WINDOW w AS (PARTITION BY node, metric ORDER BY ts {ROLLING.format(n=19)})""",
)
def _(spark, d):
    return evaluate.rolling_errors_per_channel(evaluation(spark, d))


@query(
    "e12_interval_coverage",
    f"""WITH {ENSEMBLE}
    SELECT z, node, metric, count(*) AS n, round(avg(CASE WHEN truth BETWEEN mean - z * std
      AND mean + z * std THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM evaluation, (VALUES (1.96::DOUBLE), (1.0::DOUBLE)) AS v(z) GROUP BY ALL""",
)
def _(spark, d):
    rows = materialise(evaluation(spark, d))
    wide = evaluate.coverage(rows, 1.96).withColumn("z", F.lit(1.96))
    return wide.unionByName(evaluate.coverage(rows, 1.0).withColumn("z", F.lit(1.0)))


@query(
    "d12_residual_histogram",
    f"""WITH {ENSEMBLE}, r AS (SELECT * FROM evaluation),
    ends AS (SELECT node, metric, min(residual) AS lo, max(residual) AS hi FROM r GROUP BY 1, 2)
    SELECT node, metric, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(CASE WHEN lo = hi THEN 1 ELSE
      least(floor((residual - lo) / (hi - lo) * 40) + 1, 40) END AS INT) AS bin, count(*) AS n
    FROM r JOIN ends USING (node, metric) GROUP BY ALL""",
)
def _(spark, d):
    return evaluate.residual_histogram(evaluation(spark, d))


# --- the log against later readings ------------------------------------------------------

TOLERANCE_US = 10 * MINUTE_US


@query(
    "c01_reconcile_forecasts",
    f"""WITH {NAIVE}, log AS (
      SELECT ts AS issue_ts, ts + INTERVAL 3 MINUTE AS target_ts, node, metric, pred FROM naive
      WHERE pred IS NOT NULL),
    frame_times AS (SELECT DISTINCT ts FROM readings),
    targets AS (SELECT DISTINCT target_ts FROM log),
    back AS (SELECT target_ts, f.ts AS b FROM targets ASOF LEFT JOIN frame_times f
      ON target_ts >= f.ts),
    ahead AS (SELECT target_ts, f.ts AS a FROM targets ASOF LEFT JOIN frame_times f
      ON target_ts <= f.ts),
    near_ts AS (
      SELECT target_ts, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a
        WHEN epoch_us(a) - epoch_us(target_ts) <= epoch_us(target_ts) - epoch_us(b) THEN a
        ELSE b END AS gt_ts FROM back JOIN ahead USING (target_ts)),
    filled AS (
      SELECT l.*, CASE WHEN abs(epoch_us(n.gt_ts) - epoch_us(l.target_ts)) <= {TOLERANCE_US}
        THEN n.gt_ts END AS gt_ts FROM log l JOIN near_ts n USING (target_ts)),
    valued AS (
      SELECT f.*, r.value AS gt FROM filled f LEFT JOIN readings r
        ON r.ts = f.gt_ts AND r.node = f.node AND r.metric = f.metric)
    SELECT epoch_us(issue_ts) AS issue_ts_us, epoch_us(target_ts) AS target_ts_us, node, metric,
      round(pred, 6) AS pred, epoch_us(gt_ts) AS gt_ts_us, round(gt, 6) AS gt,
      CAST(gt IS NOT NULL AS INT) AS matched, round(gt - pred, 6) AS residual,
      round(abs(gt - pred), 6) AS abs_error, CAST(bool_and(gt IS NOT NULL) OVER
        (PARTITION BY issue_ts, target_ts) AS INT) AS ground_truth_matched FROM valued""",
)
def _(spark, d):
    log = forecast.naive(settled(spark, d)).select(
        F.col("ts").alias("issue_ts"),
        (F.col("ts") + F.expr("INTERVAL 3 MINUTES")).alias("target_ts"),
        *KEYS,
        "pred",
    )
    return evaluate.reconcile(log, readings(spark, d), TOLERANCE_US)


@query(
    "c01_reconcile_runs",
    f"""WITH {NAIVE}, log AS (
      SELECT ts AS issue_ts, ts + INTERVAL 70 MINUTE AS target_ts, node, metric, pred FROM naive
      WHERE pred IS NOT NULL AND node <> 'M11'),
    seen AS (SELECT ts, node, metric, value FROM grid WHERE value IS NOT NULL AND hour(ts) % 5 <> 2),
    frame_times AS (SELECT DISTINCT ts FROM seen),
    hops AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM times),
    near_ts AS (
      SELECT target_ts, arg_min(ts, (abs(epoch_us(ts) - epoch_us(target_ts)), -epoch_us(ts))) AS gt_ts
      FROM (SELECT DISTINCT target_ts FROM log) t JOIN frame_times f
        ON abs(epoch_us(ts) - epoch_us(target_ts)) <= (SELECT greatest(60000000,
          CAST(floor(quantile_cont(gap, 0.5) / 2) AS BIGINT)) FROM hops WHERE gap > 0)
      GROUP BY target_ts),
    valued AS (
      SELECT l.*, n.gt_ts, r.value AS gt FROM log l LEFT JOIN near_ts n USING (target_ts)
      LEFT JOIN seen r ON r.ts = n.gt_ts AND r.node = l.node AND r.metric = l.metric)
    SELECT epoch_us(issue_ts) AS issue_ts_us, epoch_us(target_ts) AS target_ts_us, node, metric,
      round(pred, 6) AS pred, epoch_us(gt_ts) AS gt_ts_us, round(gt, 6) AS gt,
      CAST(gt IS NOT NULL AS INT) AS matched, round(gt - pred, 6) AS residual,
      CAST(bool_and(gt IS NOT NULL) OVER (PARTITION BY issue_ts, target_ts) AS INT)
        AS ground_truth_matched FROM valued""",
)
def _(spark, d):
    """Three runs, each with the readings of its time only; some hours have no readings at all, and
    some channels none in an hour. The tolerance is half the sampling step."""
    rows = settled(spark, d)
    log = materialise(
        forecast.naive(rows).filter("node <> 'M11'").select(
            F.col("ts").alias("issue_ts"),
            (F.col("ts") + F.expr("INTERVAL 70 MINUTES")).alias("target_ts"),
            *KEYS,
            "pred",
        )
    )
    seen = materialise(grid(spark, d).filter("value IS NOT NULL AND hour(ts) % 5 <> 2"))
    step = rows.agg(series.sampling_step(rows).scalar()).first()[0]
    state = reconcile.reconciled_log(spark, work_dir(spark))
    ends = log.agg(F.min("issue_ts"), F.max("issue_ts")).first()
    cuts = [ends[0] + (ends[1] - ends[0]) * k / 3 for k in (1, 2)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        log_, seen_ = log, seen
        if low is not None:
            log_, seen_ = log_.filter(F.col("issue_ts") > F.lit(low)), seen_.filter(F.col("ts") > F.lit(low))
        if high is not None:
            log_, seen_ = log_.filter(F.col("issue_ts") <= F.lit(high)), seen_.filter(F.col("ts") <= F.lit(high))
        reconcile.reconcile_run(state, log_, seen_, evaluate.tolerance_us(step))
    return reconcile.reconciled(state).drop("settled", "abs_error")


# --- models -------------------------------------------------------------------------------


def trained(rows):
    deltas = forecast.differences(rows)
    scaler = materialise(forecast.delta_scaler(deltas))
    scaled = forecast.standardise(deltas, scaler)
    return scaler, scaled, forecast.fit(forecast.lag_windows(scaled))


@query("j01_fit_autoregression")
def _(spark, d):
    _, _, model = trained(forecast.training_rows(settled(spark, d)))
    return model.select(
        *KEYS, F.posexplode("beta").alias("term", "coefficient")
    ).withColumn("coefficient", F.round("coefficient", 4))


def next_step(spark, d):
    rows = settled(spark, d)
    _, scaled, model = trained(forecast.training_rows(rows))
    return forecast.predict_next(forecast.latest_window(scaled), model), rows


@query("j02_predict_next_step")
def _(spark, d):
    return next_step(spark, d)[0]


@query("j03_history_with_uncertainty")
def _(spark, d):
    rows = settled(spark, d)
    scaler, scaled, _ = trained(forecast.training_rows(rows))
    models = materialise(forecast.bagged_fit(forecast.lag_windows(scaled), MEMBERS))
    return forecast.ensemble(forecast.predict_history(rows, models, scaler))


@query(
    "j05_snapshot_given_coefficients",
    f"""WITH {SCALER}, z AS (
      SELECT d.*, mu, sigma, (delta - mu) / sigma AS z,
        row_number() OVER (PARTITION BY node, metric ORDER BY pos DESC) AS k
      FROM deltas d JOIN scaler USING (node, metric)),
    hops AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM times),
    guess AS (
      SELECT node, metric, max(ts) AS issue_ts, max(CASE WHEN k = 1 THEN value END) AS level,
        (0.1 + 0.5 * max(CASE WHEN k = 1 THEN z END) - 0.25 * max(CASE WHEN k = 20 THEN z END))
          * max(sigma) + max(mu) AS delta
      FROM z WHERE k <= 20 GROUP BY node, metric)
    SELECT epoch_us(issue_ts) AS issue_ts_us, CAST(trunc(epoch_us(issue_ts) + (
        SELECT quantile_cont(gap, 0.5) FROM hops WHERE gap > 0)) AS BIGINT) AS target_ts_us,
      node, metric, round(level, 6) AS current, round(level + delta, 6) AS predicted,
      round(delta, 6) AS delta FROM guess""",
)
def _(spark, d):
    rows = settled(spark, d)
    deltas = forecast.differences(rows)
    scaled = forecast.standardise(deltas, forecast.delta_scaler(deltas))
    # Intercept, the oldest difference, ..., the newest one.
    beta = [0.1, -0.25, *[0.0] * (forecast.LAGS - 2), 0.5]
    model = rows.select(*KEYS).distinct().withColumn("beta", F.array(*map(F.lit, beta)))
    return forecast.snapshot(
        forecast.predict_next(forecast.latest_window(scaled), model), rows
    )


@query("j05_forecast_snapshot")
def _(spark, d):
    predictions, rows = next_step(spark, d)
    return forecast.snapshot(predictions, rows)


@query(
    "d15_module_payloads",
    f"""WITH {NAIVE}, last AS (
      SELECT ts AS issue_ts, ts + INTERVAL 1 HOUR AS target_ts, node, metric, round(value, 6) AS
        current, round(pred, 6) AS predicted FROM naive
      WHERE pos >= 1)
    SELECT node, epoch_us(issue_ts) AS issue_ts_us, epoch_us(target_ts) AS target_ts_us,
      string_agg(concat(metric, '=', printf('%.2f', predicted)), ',' ORDER BY metric) AS predicted,
      string_agg(metric, ',' ORDER BY metric) AS features
    FROM last GROUP BY node, issue_ts, target_ts""",
)
def _(spark, d):
    rows = forecast.naive(settled(spark, d)).select(
        F.col("ts").alias("issue_ts"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target_ts"),
        *KEYS,
        F.col("value").alias("current"),
        F.col("pred").alias("predicted"),
    )
    payloads = forecast.module_payloads(
        rows.withColumn("delta", F.col("predicted") - F.col("current"))
    )
    texts = F.transform(
        F.map_entries("predicted"),
        lambda e: F.concat(e["key"], F.lit("="), fixed_text(e["value"])),
    )
    return payloads.select(
        "node", "issue_ts", "target_ts",
        F.array_join(texts, ",").alias("predicted"),
        F.array_join(F.transform("features", lambda f: f["name"]), ",").alias("features"),
    )


@query(
    "g05_channel_drift",
    f"""WITH {CLEAN}, fitted AS (SELECT DISTINCT node, metric FROM cleaned
        WHERE NOT (node = 'M9' AND metric = 'CO2')
      UNION ALL SELECT 'M12', 'Temp'),
    now AS (SELECT DISTINCT node, metric FROM cleaned)
    SELECT node, metric, 'missing in data' AS side FROM (FROM fitted EXCEPT FROM now)
    UNION ALL SELECT node, metric, 'missing in model' FROM (FROM now EXCEPT FROM fitted)""",
)
def _(spark, d):
    return forecast.channel_drift(*_drifted(spark, d))


def _drifted(spark, d):
    now = settled(spark, d).select(*KEYS).distinct()
    other = spark.range(1).select(F.lit("M12").alias("node"), F.lit("Temp").alias("metric"))
    fitted = now.filter("NOT (node = 'M9' AND metric = 'CO2')").unionByName(other)
    return fitted, now


@query(
    "j07_retrain_rows",
    f"""WITH {CLEAN}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(value, 6) AS value FROM cleaned
    WHERE ts IN (SELECT ts FROM times ORDER BY ts DESC LIMIT {schema.TRAIN_ROWS})""",
)
def _(spark, d):
    fitted, _now = _drifted(spark, d)
    rows = settled(spark, d)
    if not forecast.must_retrain(fitted, rows):
        return rows.limit(0).drop("pos")
    return forecast.training_rows(rows).drop("pos")


def stored(spark, d):
    """A model store that was filled with the first two thirds of the frame and then extended."""
    rows = settled(spark, d)
    store = kept_model.model_store(spark, work_dir(spark))
    last = rows.agg(F.max("pos")).first()[0]
    kept_model.refresh(store, rows.filter(F.col("pos") <= last * 2 // 3))
    kept_model.refresh(store, rows)
    return store, rows


@query(
    "j07_kept_sums",
    f"""WITH {DELTAS}, w AS (
      SELECT *, count(delta) OVER l AS n, first_value(delta) OVER l AS x1,
        last_value(delta) OVER l AS x20 FROM deltas
      WINDOW l AS (PARTITION BY node, metric ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT node, metric, round(avg(delta), 6) AS mu, round(stddev_pop(delta), 6) AS sigma,
      count(*) FILTER (n = 20) AS n_windows, round(sum(delta) FILTER (n = 20), 4) AS sum_y,
      round(sum(x1 * delta) FILTER (n = 20), 4) AS x1_y, round(sum(x20 * delta) FILTER (n = 20), 4) AS x20_y,
      round(sum(x1 * x20) FILTER (n = 20), 4) AS x1_x20
    FROM w GROUP BY node, metric""",
)
def _(spark, d):
    sums = kept_model.totals(stored(spark, d)[0])
    mu, wide = F.col("s_delta") / F.col("n_delta"), forecast.LAGS + 2

    def product(i, j):
        return F.round(F.col("products")[i * wide + j] + 3.1e-6, 4)

    return sums.select(
        *KEYS,
        mu.alias("mu"),
        F.sqrt(F.col("q_delta") / F.col("n_delta") - mu * mu).alias("sigma"),
        "n_windows",
        product(0, wide - 1).alias("sum_y"),
        product(1, wide - 1).alias("x1_y"),
        product(wide - 2, wide - 1).alias("x20_y"),
        product(1, wide - 2).alias("x1_x20"),
    )


@query("j07_stored_prediction")
def _(spark, d):
    store, rows = stored(spark, d)
    return kept_model.predict_kept(rows, kept_model.kept_model(store))
