"""Registry of queries, and the inputs they derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from sensorlake import schema
from sensorlake.functions.times import HOUR_US, micros
from sensorlake.operators.clean import clean, densify, reading_gap_us, to_grid
from sensorlake.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(column, decimals: int = 6):
    """Rounding for comparison. Means and midpoints of short decimals often end in an exact half,
    where the last bit decides; a nudge of 3 % of a unit moves them off that edge."""
    column = F.col(column) if isinstance(column, str) else column
    # Adding 0.0 turns a negative zero into zero.
    return F.round(column + F.lit(3.1 * 10.0 ** -(decimals + 2)), decimals) + F.lit(0.0)


def rounded_sql(sql: str) -> str:
    """The same nudge inside every ``round(x, 6|4|3)`` of a SQL text."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, end = 1, begin + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = rounded_sql(sql[begin + 6 : end - 1])
        value, _, decimals = inner.rpartition(", ")
        if decimals in ("6", "4", "3"):
            inner = f"({value}) + 3.1e-{int(decimals) + 2}, {decimals}"
        out += sql[at:begin] + f"round({inner})"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``, with its SQL counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql)
        return fn

    return register


def flat(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Plain columns only: times as epoch microseconds (``<name>_us``), numbers rounded."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            columns.append(micros(column).alias(f"{field.name}_us"))
        elif isinstance(field.dataType, T.DateType):
            columns.append(F.date_format(column, "yyyy-MM-dd").alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            columns.append(rounded(column, decimals).alias(field.name))
        elif isinstance(field.dataType, T.BooleanType):
            columns.append(column.cast("int").alias(field.name))
        else:
            columns.append(column)
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs made from the tables ---------------------------------------------------
# Event rows stand for sensor readings: the user picks the node, the event type the metric,
# and an affine map brings the value into the metric's range. Error rows are failed reads.

METRIC_CASE = (
    "CASE event_type WHEN 'click' THEN 'Temp' WHEN 'error' THEN 'Temp' WHEN 'view' THEN 'Humid'"
    " WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'TVOC' END"
)
VALUE_CASE = (
    "CASE event_type WHEN 'click' THEN 15.0E0 + 0.25E0 * value WHEN 'view' THEN 25.0E0 + value"
    " WHEN 'purchase' THEN 400.0E0 + 10.0E0 * value WHEN 'signup' THEN 4.0E0 * value END"
)
NODE_CASE = (
    "CASE user_id % 8 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(schema.NODE_IDS))
    + " END"
)
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def readings(spark: SparkSession, sf_dir: str, keep: list[str] = []) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin(EVENT_TYPES))
        .select(
            *keep,
            "ts",
            F.expr(NODE_CASE).alias("node"),
            F.expr(METRIC_CASE).alias("metric"),
            F.expr(VALUE_CASE).alias("value"),
        )
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the readings per step: an hour, or less where a channel has several readings an hour.

    The step is the mean distance of a channel's readings, so the grid grows with the readings.
    """
    rows = readings(spark, sf_dir)
    return to_grid(rows, f"{min(HOUR_US, reading_gap_us(rows))} microseconds")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense frame of the means per step, uncleaned.

    The means are written once: the frame numbers its rows and is read in several branches, and
    none of those should scan the events again.
    """
    return densify(materialise(grid(spark, sf_dir)))


def clean_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(frame(spark, sf_dir))


# --- the same inputs in SQL ----------------------------------------------------------

READINGS = f"""readings AS (
  SELECT event_id, ts, {NODE_CASE} AS node, {METRIC_CASE} AS metric, {VALUE_CASE} AS value
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup', 'error'))"""

NODES = f"nodes AS ({schema.NODES_SQL})"
METRICS = f"metrics AS ({schema.METRICS_SQL})"
THRESHOLDS = f"thresholds AS ({schema.THRESHOLDS_SQL})"

GRID = f"""{READINGS}, step AS (
  SELECT least(3600, greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000
    * count(DISTINCT (node, metric)) // count(*))) * 1000000 AS us FROM readings),
grid AS (
  SELECT make_timestamp(epoch_us(ts) // us * us) AS ts, node, metric, avg(value) AS value
  FROM readings, step GROUP BY 1, 2, 3)"""

FRAME = f"""{GRID}, {NODES}, {METRICS}, times AS (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM grid)),
frame AS (
  SELECT t.ts, t.pos, n.node, m.metric, g.value
  FROM times t CROSS JOIN nodes n CROSS JOIN metrics m
  LEFT JOIN grid g ON g.ts = t.ts AND g.node = n.node AND g.metric = m.metric)"""

FLAGGED = f"""{FRAME}, flat AS (
  SELECT *, count(value) OVER w AS roll_n,
    CASE WHEN count(value) OVER w >= 10 THEN var_pop(value) OVER w END AS roll_var
  FROM frame
  WINDOW w AS (PARTITION BY node, metric ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
unflat AS (
  SELECT *, coalesce(roll_var < 0.0001 AND value IS NOT NULL, false) AS is_flat FROM flat),
kept0 AS (SELECT *, CASE WHEN NOT is_flat THEN value END AS kept FROM unflat),
moments AS (
  SELECT node, metric, avg(kept) AS m, stddev_pop(kept) AS s FROM kept0 GROUP BY node, metric),
scored AS (
  SELECT k.*, CASE WHEN s > 0 THEN (kept - m) / s END AS zscore
  FROM kept0 k JOIN moments USING (node, metric)),
flagged AS (
  SELECT * REPLACE (CASE WHEN NOT coalesce(abs(zscore) > 3, false) THEN kept END AS kept),
    coalesce(abs(zscore) > 3, false) AS is_outlier FROM scored)"""


def neighbours_sql(source: str, value: str, keys: str = "node, metric") -> str:
    """CTE ``near``: the known value and position at or before, and at or after, each row."""
    known = f"CASE WHEN {value} IS NOT NULL THEN pos END"
    return f"""near AS (
  SELECT *,
    last_value({value} IGNORE NULLS) OVER b AS v0, last_value({known} IGNORE NULLS) OVER b AS p0,
    first_value({value} IGNORE NULLS) OVER a AS v1, first_value({known} IGNORE NULLS) OVER a AS p1
  FROM {source}
  WINDOW b AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


CLEAN = f"""{FLAGGED}, {neighbours_sql("flagged", "kept")}, cleaned AS (
  SELECT ts, pos, node, metric,
    coalesce(kept, v0 + (v1 - v0) / (p1 - p0) * (pos - p0), v0, v1) AS value
  FROM near WHERE coalesce(v0, v1) IS NOT NULL)"""

SCORED = f"""{THRESHOLDS}, breach AS (
  SELECT r.*, t.lo, t.hi, t.margin,
    CASE WHEN value > hi THEN 'HIGH' WHEN value < lo THEN 'LOW' END AS direction,
    CASE WHEN value > hi THEN value - hi WHEN value < lo THEN lo - value ELSE 0 END AS severity,
    CASE WHEN value > hi THEN hi_reason WHEN value < lo THEN lo_reason END AS reason
  FROM {{source}} r JOIN thresholds t USING (metric))"""


def scored_sql(source: str) -> str:
    return SCORED.format(source=source)


STATE = f"""{READINGS}, {scored_sql("readings")}, flags AS (
  SELECT *, CASE WHEN direction IS NOT NULL THEN 1 WHEN value IS NULL THEN 0
    WHEN (hi IS NULL OR value <= hi - margin) AND (lo IS NULL OR value >= lo + margin) THEN 0
    END AS flag FROM breach),
states AS (
  SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER
    (PARTITION BY node, metric ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
    AS active FROM flags),
state AS (
  SELECT *, active = 1 AND coalesce(lag(active) OVER
    (PARTITION BY node, metric ORDER BY ts), 0) = 0 AS onset FROM states),
runs AS (
  SELECT *, last_value(CASE WHEN onset THEN ts END IGNORE NULLS) OVER
    (PARTITION BY node, metric ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS started FROM state),
running AS (SELECT * FROM runs WHERE active = 1)"""


def greedy_sql(name: str, source: str, keys: str, gap_us: int, passes: str = ">=") -> str:
    """CTEs that walk each key's rows in order of ``at_us``; result ``name`` with ``accepted``,
    ``last_us``. ``source`` may carry ``start_us``. Needs WITH RECURSIVE."""
    cols = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} = w.{k}" for k in cols)
    return f"""{name}_o AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY at_us) AS rn FROM {source}),
{name}_w AS (
  SELECT s.*, s.start_us IS NULL OR s.at_us - s.start_us {passes} {gap_us} AS accepted,
    CASE WHEN s.start_us IS NULL OR s.at_us - s.start_us {passes} {gap_us}
      THEN s.at_us ELSE s.start_us END AS last_us
  FROM {name}_o s WHERE rn = 1
  UNION ALL
  SELECT s.*, s.at_us - w.last_us {passes} {gap_us} AS accepted,
    CASE WHEN s.at_us - w.last_us {passes} {gap_us} THEN s.at_us ELSE w.last_us END AS last_us
  FROM {name}_w w JOIN {name}_o s ON {same} AND s.rn = w.rn + 1),
{name} AS (SELECT * FROM {name}_w)"""


NOTICES = f"""{STATE}, onsets AS (
  SELECT node, metric, ts, value, severity, direction, reason, epoch_us(ts) AS at_us,
    CAST(NULL AS BIGINT) AS start_us FROM running WHERE onset),
{greedy_sql("sent", "onsets", "node, metric", 3600 * 10**6)},
late AS (
  SELECT r.node, r.metric, r.ts, r.value, r.severity, r.direction, r.reason, r.started,
    epoch_us(r.ts) AS at_us, s.last_us AS start_us
  FROM running r JOIN sent s ON s.node = r.node AND s.metric = r.metric AND s.ts = r.started
  WHERE r.direction IS NOT NULL AND NOT r.onset),
{greedy_sql("again", "late", "node, metric, started", 43200 * 10**6, ">")},
notices AS (
  SELECT node, metric, ts, value, severity, direction, reason, at_us,
    CASE WHEN accepted THEN 'new' ELSE 'suppressed' END AS kind FROM sent
  UNION ALL
  SELECT node, metric, ts, value, severity, direction, reason, at_us, 'reminder' AS kind
  FROM again WHERE accepted)"""


def median_sql(source: str, column: str) -> str:
    return f"(SELECT quantile_cont({column}, 0.5) FROM {source})"
