"""Filters, latest values, rankings, summaries, resampled histories and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.operators import series, spatial
from sensorlake.operators.series import KEYS
from sensorlake.plans.base import (
    CLEAN,
    FRAME,
    METRICS,
    METRIC_CASE,
    NODES,
    READINGS,
    VALUE_CASE,
    clean_frame,
    frame,
    neighbours_sql,
    query,
    readings,
    rounded,
    scored_sql,
    table,
)

LATEST = f"""{READINGS}, latest AS (
  SELECT node, metric, max(ts) AS ts, arg_max(value, ts) AS value FROM readings
  WHERE value IS NOT NULL GROUP BY node, metric)"""
LATEST_COLUMNS = "node, metric, round(value, 6) AS value"


@query(
    "b01_module_channels",
    f"""WITH {READINGS}
    SELECT epoch_us(ts) AS ts_us, {LATEST_COLUMNS} FROM readings WHERE node = 'M1'""",
)
def _(spark, d):
    return series.of_module(readings(spark, d), "M1")


@query(
    "b02_trailing_window",
    f"""WITH {READINGS}
    SELECT w.name AS window_name, epoch_us(ts) AS ts_us, {LATEST_COLUMNS} FROM readings,
      (VALUES ('hour', INTERVAL 1 HOUR), ('day', INTERVAL 1 DAY), ('week', INTERVAL 7 DAY),
        ('other', INTERVAL 10000 DAY)) AS w(name, span)
    WHERE ts >= (SELECT max(ts) FROM readings) - w.span""",
)
def _(spark, d):
    rows = readings(spark, d)
    parts = [
        series.trailing(rows, name).withColumn("window_name", F.lit(name))
        for name in ("hour", "day", "week", "other")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "b03_local_day",
    f"""WITH {READINGS}
    SELECT epoch_us(ts) AS ts_us, {LATEST_COLUMNS} FROM readings
    WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'""",
)
def _(spark, d):
    return series.local_day(readings(spark, d), "2024-01-15")


@query(
    "f01_latest_values",
    f"WITH {LATEST} SELECT epoch_us(ts) AS ts_us, {LATEST_COLUMNS} FROM latest",
)
def _(spark, d):
    return series.latest(readings(spark, d))


@query(
    "f02_last_rows",
    f"""WITH {READINGS}
    SELECT epoch_us(ts) AS ts_us, {LATEST_COLUMNS} FROM readings
    WHERE ts IN (SELECT DISTINCT ts FROM readings ORDER BY ts DESC LIMIT 480)""",
)
def _(spark, d):
    return series.last_rows(readings(spark, d), schema.DAY_ROWS).orderBy("ts")


RANKED = f"""{LATEST}, {NODES}, ranked AS (
  SELECT l.metric, CAST(row_number() OVER (PARTITION BY l.metric ORDER BY value DESC, ord) AS INT)
    AS rank, l.node, n.name, l.value, count(*) OVER (PARTITION BY l.metric) AS n
  FROM latest l JOIN nodes n USING (node))"""


@query(
    "f03_rank_nodes",
    f"""WITH {RANKED}
    SELECT metric, rank, node, name, round(value, 6) AS value,
      CASE WHEN rank = 1 THEN 'highest' WHEN rank = n THEN 'lowest' END AS tag FROM ranked""",
)
def _(spark, d):
    return series.rank_nodes(series.latest(readings(spark, d)), schema.nodes(spark))


def _cell(metric: str, decimals: int) -> str:
    return (
        f"coalesce(printf('%.{decimals}f', max(CASE WHEN metric = '{metric}' THEN value END)), '--')"
        f" AS {metric.lower()}"
    )


@query(
    "d19_node_table",
    f"""WITH {LATEST}, {NODES}
    SELECT n.ord, n.node, n.name, {_cell("Temp", 1)}, {_cell("Humid", 1)}, {_cell("CO2", 0)},
      {_cell("TVOC", 1)} FROM nodes n LEFT JOIN latest l ON l.node = n.node GROUP BY ALL""",
)
def _(spark, d):
    return series.node_table(series.latest(readings(spark, d)), schema.nodes(spark))


@query(
    "d08_latest_summary",
    f"""WITH {LATEST}, {scored_sql("latest")}
    SELECT round(avg(CASE WHEN metric = 'Temp' THEN value END), 6) AS avg_temp,
      round(avg(CASE WHEN metric = 'Humid' THEN value END), 6) AS avg_humid,
      count(direction) AS n_breaches FROM breach""",
)
def _(spark, d):
    return series.short_summary(series.latest(readings(spark, d)), schema.thresholds(spark))


@query(
    "b09_value_bands",
    f"""WITH {READINGS}, {METRICS}
    SELECT epoch_us(ts) AS ts_us, {LATEST_COLUMNS},
      CASE WHEN value > vmin + (vmax - vmin) * 0.65::DOUBLE THEN 'high'
           WHEN value > vmin + (vmax - vmin) * 0.35::DOUBLE THEN 'mid' ELSE 'low' END AS band
    FROM readings JOIN metrics USING (metric) WHERE value IS NOT NULL""",
)
def _(spark, d):
    known = readings(spark, d).filter("value IS NOT NULL")
    return series.value_bands(known, schema.metrics(spark))


LEGACY = "concat(node, '_', CASE metric WHEN 'Humid' THEN 'Hum' ELSE metric END)"
FIXED = "printf('%.2f', round(value, 6))"


@query(
    "b07_legacy_snapshot",
    f"""WITH {CLEAN}, last AS (SELECT * FROM cleaned WHERE ts = (SELECT max(ts) FROM cleaned))
    SELECT {LEGACY} AS name, {FIXED} AS text FROM last
    UNION ALL SELECT 'Timestamp', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM last""",
)
def _(spark, d):
    return series.snapshot_texts(clean_frame(spark, d))


@query(
    "b08_legacy_history",
    f"""WITH {FRAME}, pairs AS (
      SELECT ts, {LEGACY} AS k, {FIXED} AS v FROM frame WHERE value IS NOT NULL
        AND ts IN (SELECT ts FROM times ORDER BY ts DESC LIMIT 480))
    SELECT epoch_us(ts) AS ts_us, concat('{{', string_agg(concat('"', k, '":"', v, '"'), ','
      ORDER BY k), ',"created":"', strftime(ts, '%H:%M:%S'), '"}}') AS payload
    FROM pairs GROUP BY ts""",
)
def _(spark, d):
    return series.history_json(frame(spark, d), schema.DAY_ROWS)


@query(
    "b08_history_envelope",
    f"""WITH {FRAME}, pairs AS (
      SELECT ts, {LEGACY} AS k, {FIXED} AS v FROM frame WHERE value IS NOT NULL
        AND ts IN (SELECT ts FROM times ORDER BY ts DESC LIMIT 480)),
    payloads AS (
      SELECT ts, concat('{{', string_agg(concat('"', k, '":"', v, '"'), ',' ORDER BY k),
        ',"created":"', strftime(ts, '%H:%M:%S'), '"}}') AS payload FROM pairs GROUP BY ts)
    SELECT strftime(max(ts), '%Y-%m-%d') AS date, count(*) AS count,
      string_agg(payload, chr(10) ORDER BY ts) AS data FROM payloads""",
)
def _(spark, d):
    envelope = series.history_envelope(frame(spark, d), schema.DAY_ROWS)
    return envelope.withColumn("data", F.array_join("data", "\n"))


SMOOTHED = f"""{READINGS}, smoothed AS (
  SELECT *, avg(value) OVER (PARTITION BY node, metric ORDER BY ts
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM readings WHERE value IS NOT NULL)"""


@query(
    "e05_centred_smoothing",
    f"""WITH {SMOOTHED}
    SELECT epoch_us(ts) AS ts_us, node, metric, round(smoothed, 6) AS smoothed FROM smoothed""",
)
def _(spark, d):
    return series.smooth(readings(spark, d)).select("ts", *KEYS, "smoothed")


@query(
    "d05_cross_node_band",
    f"""WITH {CLEAN}
    SELECT epoch_us(ts) AS ts_us, metric, round(avg(value), 6) AS mean, round(min(value), 6) AS low,
      round(max(value), 6) AS high FROM cleaned GROUP BY ts, metric""",
)
def _(spark, d):
    return series.cross_node(clean_frame(spark, d))


@query(
    "d06_half_hour_means",
    f"""WITH {SMOOTHED}
    SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) AS ts_us, node, metric,
      round(avg(smoothed), 6) AS value FROM smoothed GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return series.resample_smoothed(readings(spark, d))


DAY_FRAMES = f"""{READINGS}, steps AS (
  SELECT CAST(ts AS DATE) AS day, node, metric, epoch_us(ts) // 1800000000 AS step, value
  FROM readings),
means AS (SELECT day, node, metric, step, avg(value) AS value FROM steps GROUP BY ALL),
ends AS (SELECT day, min(step) AS s0, max(step) AS s1 FROM steps GROUP BY day),
spine AS (
  SELECT c.day, c.node, c.metric, e.s0, unnest(range(e.s0, e.s1 + 1)) AS step
  FROM (SELECT DISTINCT day, node, metric FROM steps) c JOIN ends e USING (day)),
frames AS (
  SELECT s.day, s.step * 1800000000 AS ts_us, s.step - s.s0 AS pos, s.node, s.metric, m.value
  FROM spine s LEFT JOIN means m USING (day, node, metric, step))"""
DAY_NEAR = neighbours_sql("frames", "value", "day, node, metric")


@query(
    "d07_day_frames",
    f"""WITH {DAY_FRAMES}
    SELECT day::VARCHAR AS day, ts_us, pos, node, metric, round(value, 6) AS value FROM frames""",
)
def _(spark, d):
    return series.day_frames(readings(spark, d))


@query(
    "e04_limited_interpolation",
    f"""WITH {DAY_FRAMES}, {DAY_NEAR}
    SELECT day::VARCHAR AS day, ts_us, node, metric,
      round(coalesce(value, CASE WHEN pos - p0 <= 6
        THEN coalesce(v0 + (v1 - v0) / (p1 - p0) * (pos - p0), v0) END), 6) AS filled
    FROM near""",
)
def _(spark, d):
    frames = series.filled_day_frames(series.day_frames(readings(spark, d)))
    return frames.select("day", "ts", *KEYS, "filled")


@query(
    "d17_hourly_snapshots",
    f"""WITH {READINGS}, last AS (
      SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, node, metric, arg_max(value, ts) AS value
      FROM readings WHERE value IS NOT NULL GROUP BY 1, 2, 3), {scored_sql("last")}
    SELECT epoch_us(hour) AS hour_us, count(*) AS n_channels, count(direction) AS n_breaches
    FROM breach GROUP BY hour""",
)
def _(spark, d):
    return series.hourly_snapshots(readings(spark, d), schema.thresholds(spark))


@query(
    "d11_sampling_step",
    f"""WITH {READINGS}, gaps AS (
      SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap
      FROM (SELECT DISTINCT ts FROM readings))
    SELECT quantile_cont(gap, 0.5)::DOUBLE AS step_us FROM gaps WHERE gap > 0""",
)
def _(spark, d):
    return series.sampling_step(readings(spark, d))


@query(
    "c08_compare_nodes",
    f"""WITH {FRAME}, recent AS (
      SELECT * FROM frame WHERE ts >= (SELECT max(ts) FROM times) - INTERVAL 1 DAY
        AND node IN ('M1', 'M4')),
    s AS (
      SELECT *, avg(value) OVER (PARTITION BY node, metric ORDER BY pos
        ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM recent
      WHERE ts IN (SELECT DISTINCT ts FROM recent ORDER BY ts DESC LIMIT 60)),
    sides AS (
      SELECT ts, metric, max(CASE WHEN node = 'M1' THEN sm END) AS a,
        max(CASE WHEN node = 'M4' THEN sm END) AS b FROM s GROUP BY ts, metric)
    SELECT epoch_us(ts) AS ts_us, metric, round(a, 6) AS a, round(b, 6) AS b,
      CASE WHEN b >= a THEN 'M4' WHEN b < a THEN 'M1' END AS above,
      round(last_value(b - a) OVER (PARTITION BY metric ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS last_delta FROM sides""",
)
def _(spark, d):
    return series.compare_nodes(frame(spark, d), "M1", "M4")


SILENT = """active AS (
  SELECT DISTINCT node FROM readings WHERE value IS NOT NULL
    AND ts >= (SELECT max(ts) FROM readings) - INTERVAL 60 MINUTE)"""


@query(
    "c05_silent_nodes",
    f"""WITH {READINGS}, {NODES}, {SILENT}
    SELECT node, name, ord FROM nodes WHERE node NOT IN (SELECT node FROM active)""",
)
def _(spark, d):
    return series.silent_nodes(readings(spark, d), schema.nodes(spark))


# Two CO2 sensors that are stuck at one value, so that some channels freeze.
STUCK = """stuck AS (
  SELECT ts, pos, node, metric, CASE WHEN node IN ('M6', 'M9') AND metric = 'CO2' THEN 512.0
    ELSE value END AS value FROM frame)"""
FROZEN = f"""{FRAME}, {STUCK}, frozen AS (
  SELECT node, metric, min(value) AS value FROM stuck
  WHERE ts IN (SELECT ts FROM times ORDER BY ts DESC LIMIT 40) GROUP BY node, metric
  HAVING count(value) = 40 AND min(value) = max(value))"""


def stuck_frame(spark, d):
    stuck = F.col("node").isin("M6", "M9") & (F.col("metric") == "CO2")
    return frame(spark, d).withColumn("value", F.when(stuck, 512.0).otherwise(F.col("value")))


@query("d09_frozen_channels", f"WITH {FROZEN} SELECT {LATEST_COLUMNS} FROM frozen")
def _(spark, d):
    return series.frozen_channels(stuck_frame(spark, d))


@query(
    "d10_situation_summary",
    f"""WITH {FROZEN}, {SILENT}, latest AS (
      SELECT node, metric, arg_max(value, ts) AS value FROM readings WHERE value IS NOT NULL
      GROUP BY node, metric), {scored_sql("latest")}
    SELECT strftime((SELECT max(ts) FROM readings), '%d/%m/%Y %H:%M') AS latest_data,
      (SELECT coalesce(string_agg(node, ', ' ORDER BY node), '') FROM active) AS active,
      (SELECT coalesce(string_agg(node, ', ' ORDER BY node), '') FROM nodes
        WHERE node NOT IN (SELECT node FROM active)) AS silent,
      (SELECT coalesce(string_agg(concat(node, '_', metric), ', ' ORDER BY concat(node, '_', metric)),
        '') FROM frozen) AS frozen,
      (SELECT coalesce(string_agg(t, ', ' ORDER BY t), '') FROM (SELECT concat(node, '_', metric, '=',
        printf('%.1f', value), ' [', direction, ']') AS t FROM breach
        WHERE direction IS NOT NULL)) AS alerts""",
)
def _(spark, d):
    return series.situation(
        readings(spark, d), stuck_frame(spark, d), schema.nodes(spark), schema.thresholds(spark)
    )


@query(
    "d16_freshness_status",
    f"""WITH {READINGS}, {NODES}, ages AS (
      SELECT n.node, max(r.ts) AS last_ts,
        (epoch_us((SELECT max(ts) FROM readings)) - epoch_us(max(r.ts))) // 1000000 AS age_s
      FROM nodes n LEFT JOIN readings r USING (node) GROUP BY n.node)
    SELECT node, epoch_us(last_ts) AS last_ts_us, age_s, CASE WHEN age_s > 900 THEN 'unhealthy'
      WHEN age_s IS NULL OR age_s >= 300 THEN 'degraded' ELSE 'ok' END AS status FROM ages""",
)
def _(spark, d):
    return series.freshness(readings(spark, d), schema.nodes(spark))


# --- surfaces ------------------------------------------------------------------------

GRID_POSITIONS = [p[1:] for p in schema.POSITIONS if p[0] == "grid"]
POSITIONS = f"positions AS (SELECT * FROM ({schema.POSITIONS_SQL}) WHERE view = 'grid')"


def cells_sql(nx: int, ny: int) -> str:
    return f"""cells AS (
  SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col,
    c * ({schema.GRID_WIDTH}::DOUBLE / {nx - 1}) AS x,
    r * ({schema.GRID_HEIGHT}::DOUBLE / {ny - 1}) AS y
  FROM range({ny}) a(r), range({nx}) b(c))"""


@query(
    "c06_heat_grid",
    f"""WITH {LATEST}, {POSITIONS}, {cells_sql(300, 300)}, weighted AS (
      SELECT l.metric, c.row, c.col, c.x, c.y, l.value,
        1 / ((sqrt((x - px) * (x - px) + (y - py) * (y - py)) + 1e-6)
           * (sqrt((x - px) * (x - px) + (y - py) * (y - py)) + 1e-6)) AS w
      FROM latest l JOIN positions p USING (node) CROSS JOIN cells c)
    SELECT metric, row, col, round(x, 6) AS x, round(y, 6) AS y,
      round(sum(w * value) / sum(w), 4) AS z FROM weighted GROUP BY metric, row, col, x, y""",
)
def _(spark, d):
    grid = spatial.heat_grid(series.latest(readings(spark, d)), GRID_POSITIONS)
    return grid.withColumn("z", rounded("z", 4))


# Every user stands for a node of a site: as many nodes as the data have users.
SITE_X, SITE_Y = "user_id * 37 % 1000 * 0.0075E0", "user_id * 91 % 1000 * 0.0068E0"


@query(
    "c06_site_heat_grid",
    f"""WITH site AS (
      SELECT user_id, {METRIC_CASE} AS metric, ts, {VALUE_CASE} AS value, {SITE_X} AS px, {SITE_Y} AS py
      FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup')),
    last AS (SELECT user_id, metric, px, py, arg_max(value, ts) AS value FROM site GROUP BY ALL),
    {cells_sql(60, 60)}, near AS (
      SELECT metric, row, col, x, y, value,
        sqrt((x - px) * (x - px) + (y - py) * (y - py)) + 1e-6 AS d FROM last, cells)
    SELECT metric, row, col, round(x, 6) AS x, round(y, 6) AS y,
      round(sum(value / (d * d)) / sum(1 / (d * d)), 4) AS z FROM near GROUP BY metric, row, col, x, y""",
)
def _(spark, d):
    site = table(spark, d, "events").filter("event_type IN ('click', 'view', 'purchase', 'signup')").select(
        F.col("user_id").cast("string").alias("node"), F.expr(METRIC_CASE).alias("metric"), "ts",
        F.expr(VALUE_CASE).alias("value"), F.expr(SITE_X).alias("px"), F.expr(SITE_Y).alias("py"),
    )
    places = site.select("node", "px", "py").distinct()
    grid = spatial.heat_grid(series.latest(site), places, nx=60, ny=60)
    return grid.withColumn("z", rounded("z", 4))


def frame_surfaces_sql(nx: int, ny: int) -> str:
    """Every cell of every frame: node values and a cell's weights as columns, ``z`` from both."""
    nodes = list(enumerate(GRID_POSITIONS))
    values = ", ".join(f"max(value) FILTER (node = '{n}') AS v{i}" for i, (n, _, _) in nodes)
    weights = ", ".join(
        f"1 / greatest((x - {px}::DOUBLE) * (x - {px}::DOUBLE)"
        f" + (y - {py}::DOUBLE) * (y - {py}::DOUBLE), 1e-10) AS w{i}"
        for i, (_, px, py) in nodes
    )
    top = " + ".join(f"coalesce(w{i} * v{i}, 0)" for i, _ in nodes)
    bottom = " + ".join(f"CASE WHEN v{i} IS NULL THEN 0 ELSE w{i} END" for i, _ in nodes)
    known = ", ".join(f"v{i}" for i, _ in nodes)
    return f"""{cells_sql(nx, ny)},
    wide AS (SELECT day, ts_us, metric, {values} FROM filled GROUP BY ALL),
    shares AS (SELECT row, col, {weights} FROM cells),
    surfaces AS (SELECT day, ts_us, metric, row, col, ({top}) / ({bottom}) AS z
      FROM wide CROSS JOIN shares WHERE coalesce({known}) IS NOT NULL)"""


@query(
    "c07_frame_grid",
    f"""WITH {DAY_FRAMES}, {DAY_NEAR}, filled AS (
      SELECT day, ts_us, node, metric, coalesce(value, CASE WHEN pos - p0 <= 6
        THEN coalesce(v0 + (v1 - v0) / (p1 - p0) * (pos - p0), v0) END) AS value FROM near),
    {frame_surfaces_sql(200, 200)}
    SELECT day::VARCHAR AS day, ts_us, metric, count(*) AS n_cells, round(avg(z), 4) AS z_mean,
      round(avg(z * row), 4) AS z_by_row, round(avg(z * col), 4) AS z_by_col,
      round(min(z), 4) AS z_min, round(max(z), 4) AS z_max
    FROM surfaces GROUP BY ALL""",
)
def _(spark, d):
    """All cells of all frames, summed up per frame: two moments tell where on the grid values lie."""
    frames = series.filled_day_frames(series.day_frames(readings(spark, d)))
    known = frames.select("day", "ts", *KEYS, F.col("filled").alias("value"))
    by = ["day", "ts", "metric"]
    return (
        spatial.frame_grid(known, GRID_POSITIONS, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            rounded(F.avg("z"), 4).alias("z_mean"),
            rounded(F.avg(F.col("z") * F.col("row")), 4).alias("z_by_row"),
            rounded(F.avg(F.col("z") * F.col("col")), 4).alias("z_by_col"),
            rounded(F.min("z"), 4).alias("z_min"),
            rounded(F.max("z"), 4).alias("z_max"),
        )
    )
