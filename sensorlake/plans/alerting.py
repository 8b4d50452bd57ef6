"""Breaches, episodes, notifications, cooldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.operators import alerts, anomaly, evaluate
from sensorlake.plans.base import (
    CLEAN,
    NOTICES,
    READINGS,
    STATE,
    clean_frame,
    greedy_sql,
    query,
    readings,
    scored_sql,
)
from sensorlake.plans.ingest import WEATHER, landed_weather
from sensorlake.sources import weather
from sensorlake.session import materialise

KEYS = ["node", "metric"]


def state(spark, d):
    return alerts.breach_state(readings(spark, d), schema.thresholds(spark))


@query(
    "b04_threshold_breaches",
    f"""WITH {READINGS}, {scored_sql("readings")}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(value, 6) AS value, direction, reason
    FROM breach WHERE direction IS NOT NULL""",
)
def _(spark, d):
    return alerts.breaches(readings(spark, d), schema.thresholds(spark)).select(
        "ts", *KEYS, "value", "direction", "reason"
    )


@query(
    "b05_breach_severity",
    f"""WITH {READINGS}, {scored_sql("readings")}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(severity, 6) AS severity FROM breach""",
)
def _(spark, d):
    return alerts.score_breaches(readings(spark, d), schema.thresholds(spark)).select(
        "ts", *KEYS, "severity"
    )


@query(
    "b06_breach_directions",
    f"""WITH {READINGS}, {scored_sql("readings")}
    SELECT node, metric, direction, count(*) AS n FROM breach
    WHERE direction IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, d):
    found = alerts.breaches(readings(spark, d), schema.thresholds(spark))
    return found.groupBy(*KEYS, "direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e10_breach_state",
    f"""WITH {STATE}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(value, 6) AS value, active,
      CAST(onset AS INT) AS onset FROM state""",
)
def _(spark, d):
    return state(spark, d).select(
        "ts", *KEYS, "value", F.col("active").cast("int").alias("active"), "onset"
    )


@query(
    "e11_breach_episodes",
    f"""WITH {STATE}
    SELECT node, metric, epoch_us(started) AS started_us, epoch_us(max(ts)) AS ended_us,
      count(*) AS n_readings, round(max(severity), 6) AS peak_severity,
      epoch_us(max(ts)) - epoch_us(started) AS duration_us
    FROM running GROUP BY node, metric, started""",
)
def breach_episodes(spark, d):
    return alerts.episodes(state(spark, d))


@query(
    "g01_resolved_channels",
    f"""WITH {READINGS}, {scored_sql("readings")}, hourly AS (
      SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) AS hour, node, metric
      FROM breach WHERE direction IS NOT NULL)
    SELECT epoch_us(hour + INTERVAL 1 HOUR) AS hour_us, node, metric FROM hourly h
    WHERE NOT EXISTS (SELECT 1 FROM hourly n WHERE n.hour = h.hour + INTERVAL 1 HOUR
      AND n.node = h.node AND n.metric = h.metric)""",
)
def _(spark, d):
    found = alerts.breaches(readings(spark, d), schema.thresholds(spark))
    hourly = found.select(F.window("ts", "1 hour")["start"].alias("hour"), *KEYS).distinct()
    before = hourly.withColumn("hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    return alerts.resolved(before, hourly, ["hour", *KEYS])


@query(
    "g02_most_severe_breach",
    f"""WITH {READINGS}, {scored_sql("readings")}
    SELECT CAST(ts AS DATE)::VARCHAR AS day, node, metric, round(value, 6) AS value,
      round(severity, 6) AS severity, epoch_us(ts) AS ts_us, direction
    FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE), node, metric
      ORDER BY severity DESC, ts DESC) AS rn FROM breach WHERE direction IS NOT NULL) WHERE rn = 1""",
)
def _(spark, d):
    found = alerts.breaches(readings(spark, d), schema.thresholds(spark)).select(
        F.to_date("ts").alias("day"), *KEYS, "ts", "value", "severity", "direction"
    )
    return alerts.most_severe(found, ["day", *KEYS])


@query(
    "h02_notifications",
    f"""WITH RECURSIVE {NOTICES}
    SELECT node, metric, at_us, round(value, 6) AS value, round(severity, 6) AS severity,
      direction, reason, kind FROM notices""",
)
def _(spark, d):
    return alerts.notifications(state(spark, d)).drop("ts")


@query(
    "h03_notification_batches",
    f"""WITH RECURSIVE {NOTICES}, queued AS (
      SELECT *, 1 AS one, CAST(NULL AS BIGINT) AS start_us FROM notices WHERE kind <> 'suppressed'),
    {greedy_sql("opened", "queued", "one", 120 * 10**6, ">")}
    SELECT last_us AS batch_start_us, kind, node, metric, epoch_us(ts) AS ts_us,
      round(value, 6) AS value, round(severity, 6) AS severity
    FROM (SELECT *, row_number() OVER (PARTITION BY last_us, kind, node, metric
      ORDER BY severity DESC, ts DESC) AS k FROM opened) WHERE k = 1""",
)
def _(spark, d):
    batches = alerts.notification_batches(alerts.notifications(state(spark, d)))
    return batches.select("batch_start", "kind", *KEYS, "ts", "value", "severity")


DRIFT = f"""{READINGS}, {WEATHER}, outdoor AS ({schema.OUTDOOR_SQL}),
    meteo AS (
      SELECT ts, 'Temp' AS metric, temperature_c AS value FROM hourly
      UNION ALL SELECT ts, 'Humid' AS metric, humidity_pct AS value FROM hourly),
    drift AS (
      SELECT r.ts, r.node, r.metric, o.node_type, r.value, w.ts AS weather_ts, w.value AS weather,
        abs(r.value - w.value) AS deviation
      FROM readings r JOIN outdoor o ON o.node = r.node AND o.metric = r.metric
      ASOF JOIN meteo w ON w.metric = r.metric AND w.ts <= r.ts
      WHERE r.value IS NOT NULL AND abs(r.value - w.value) > o.max_dev)"""


def drift(spark, d):
    codes = schema.weather_codes(spark)
    hourly = weather.hourly_forecast(landed_weather(spark, d), codes, ["day"])
    return evaluate.sensor_drift(
        readings(spark, d), weather.weather_readings(hourly), schema.outdoor(spark)
    )


@query(
    "c04_sensor_weather_drift",
    f"""WITH {DRIFT}
    SELECT epoch_us(ts) AS ts_us, node, metric, node_type, round(value, 6) AS value,
      epoch_us(weather_ts) AS weather_ts_us, round(weather, 6) AS weather,
      round(deviation, 6) AS deviation FROM drift""",
)
def _(spark, d):
    return drift(spark, d)


@query(
    "h04_drift_cooldown",
    f"""WITH RECURSIVE {DRIFT}, marks AS (
      SELECT *, epoch_us(ts) AS at_us, CAST(NULL AS BIGINT) AS start_us FROM drift),
    {greedy_sql("passed", "marks", "node, metric", 14400 * 10**6)}
    SELECT at_us AS ts_us, node, metric, round(deviation, 6) AS deviation
    FROM passed WHERE accepted""",
)
def _(spark, d):
    found = drift(spark, d).select("ts", *KEYS, "deviation")
    return alerts.cooldown(found, KEYS, schema.DRIFT_COOLDOWN_S)


SCORES = f"""{CLEAN}, spread AS (
      SELECT node, metric, avg(value) AS mu,
        CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sigma
      FROM cleaned GROUP BY node, metric),
    errors AS (
      SELECT c.ts, c.pos, c.node, c.metric, ((value - mu) / sigma) * ((value - mu) / sigma) AS err
      FROM cleaned c JOIN spread USING (node, metric)),
    windowed AS (
      SELECT * FROM (SELECT *, avg(err) OVER (PARTITION BY node, metric ORDER BY pos
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS window_err FROM errors) WHERE pos >= 19),
    scores AS (SELECT ts, avg(window_err) AS score FROM windowed GROUP BY ts),
    judged AS (
      SELECT *, score > 1.1 AS is_anomaly FROM scores)"""


def windowed_errors(spark, d):
    rows = materialise(clean_frame(spark, d))
    return anomaly.window_errors(anomaly.mean_errors(rows, anomaly.channel_scaler(rows)))


@query(
    "f04_top_contributors",
    f"""WITH {SCORES}
    SELECT epoch_us(ts) AS ts_us, rank, node, metric, round(window_err, 6) AS window_err
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ts
      ORDER BY window_err DESC, node, metric) AS INT) AS rank FROM windowed) WHERE rank <= 3""",
)
def _(spark, d):
    return anomaly.top_contributors(windowed_errors(spark, d))


@query(
    "h05_anomaly_cooldown",
    f"""WITH RECURSIVE {SCORES}, marks AS (
      SELECT ts, score, 1 AS one, epoch_us(ts) AS at_us, CAST(NULL AS BIGINT) AS start_us
      FROM judged WHERE is_anomaly),
    {greedy_sql("passed", "marks", "one", 3600 * 10**6)}
    SELECT at_us AS ts_us, round(score, 6) AS score FROM passed WHERE accepted""",
)
def _(spark, d):
    found = anomaly.score(windowed_errors(spark, d), threshold=1.1).filter("is_anomaly")
    return alerts.cooldown(found.select("ts", "score"), [], schema.ANOMALY_COOLDOWN_S)


@query("j04_reconstruction_anomaly")
def _(spark, d):
    rows = materialise(clean_frame(spark, d))
    scaler = anomaly.channel_scaler(rows)
    loadings = anomaly.fit_reconstruction(rows, scaler)
    windowed = materialise(
        anomaly.window_errors(anomaly.reconstruction_errors(rows, scaler, loadings))
    )
    top = (
        anomaly.top_contributors(windowed)
        .groupBy("ts")
        .pivot("rank", [1, 2, 3])
        .agg(F.first(F.concat_ws("_", "node", "metric")))
        .toDF("ts", "top1", "top2", "top3")
    )
    return anomaly.score(windowed).join(top, "ts")


# With one component that weighs all channels alike, a row is rebuilt as its mean.
@query(
    "j04_anomaly_given_loadings",
    f"""WITH {CLEAN}, spread AS (
      SELECT node, metric, avg(value) AS mu,
        CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sigma
      FROM cleaned GROUP BY node, metric),
    z AS (SELECT ts, pos, node, metric, (value - mu) / sigma AS z FROM cleaned JOIN spread USING (node, metric)),
    errors AS (SELECT *, (z - avg(z) OVER (PARTITION BY ts)) ** 2 AS err FROM z),
    windowed AS (
      SELECT * FROM (SELECT *, avg(err) OVER (PARTITION BY node, metric ORDER BY pos
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS window_err FROM errors) WHERE pos >= 19),
    scores AS (SELECT ts, avg(window_err) AS score FROM windowed GROUP BY ts),
    bound AS (SELECT 1.2 * quantile_cont(score, 0.5) AS threshold FROM scores)
    SELECT epoch_us(ts) AS ts_us, round(score, 6) AS score, round(threshold, 6) AS threshold,
      CAST(score > threshold AS INT) AS is_anomaly FROM scores, bound""",
)
def _(spark, d):
    rows = materialise(clean_frame(spark, d))
    scaler = anomaly.channel_scaler(rows)
    even = F.array(F.lit(1.0) / F.sqrt(F.lit(scaler.count())))
    errors = anomaly.reconstruction_errors(rows, scaler, scaler.select(*KEYS, even.alias("loadings")))
    return anomaly.score(materialise(anomaly.window_errors(errors)), factor=1.2)
