"""Histories, latest values, rankings and summaries over readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sensorlake import schema
from sensorlake.functions.text import fixed_text
from sensorlake.functions.times import MINUTE_US, floor_to, from_micros, micros
from sensorlake.operators.alerts import score_breaches
from sensorlake.operators.blocks import BLOCK_ROWS, rows_frame, with_position, with_previous
from sensorlake.operators.clean import interpolate_limited
from sensorlake.operators.quantile import exact_quantile

KEYS = ["node", "metric"]
RANGES = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}


def end_of(readings: DataFrame):
    """The newest timestamp, as a scalar subquery."""
    return readings.agg(F.max("ts")).scalar()


# --- filters ------------------------------------------------------------------


def of_module(readings: DataFrame, module: str) -> DataFrame:
    """Channels of one node. Equality, so M1 does not match M10."""
    return readings.filter(F.col("node") == module)


def require_module(readings: DataFrame, module: str) -> DataFrame:
    rows = of_module(readings, module)
    if rows.isEmpty():
        raise ValueError(f"Module {module} has no channel.")
    return rows


def trailing(readings: DataFrame, range_name: str, as_of=None) -> DataFrame:
    """Readings of the last hour, day or week before ``as_of``; other names filter nothing."""
    span = RANGES.get(range_name)
    if span is None:
        return readings
    end = end_of(readings) if as_of is None else as_of
    return readings.filter(F.col("ts") >= end - F.expr(span))


def local_day(readings: DataFrame, day: str) -> DataFrame:
    """One calendar day of the local time label, half-open."""
    start = F.lit(day).cast("timestamp_ntz")
    return readings.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))


def last_rows(readings: DataFrame, n: int) -> DataFrame:
    """Readings of the last ``n`` distinct timestamps of the frame."""
    newest = readings.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    return readings.join(newest, "ts", "left_semi")


# --- latest -------------------------------------------------------------------


def latest(readings: DataFrame) -> DataFrame:
    """Last known value of each channel."""
    known = readings.filter(F.col("value").isNotNull())
    return known.groupBy(*KEYS).agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")
    )


def rank_nodes(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes by current value, highest first; ties keep the node order."""
    by_value = Window.partitionBy("metric").orderBy(F.desc("value"), "ord")
    everyone = Window.partitionBy("metric")
    return (
        current.join(nodes, "node")
        .withColumn("rank", F.row_number().over(by_value))
        .withColumn("n", F.count(F.lit(1)).over(everyone))
        .withColumn(
            "tag",
            F.when(F.col("rank") == 1, "highest").when(F.col("rank") == F.col("n"), "lowest"),
        )
        .select("metric", "rank", "node", "name", "value", "tag")
    )


def node_table(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text row per node, one column per metric, ``--`` where nothing is known."""
    wide = current.groupBy("node").pivot("metric", schema.METRIC_IDS).agg(F.first("value"))
    decimals = {"Temp": 1, "Humid": 1, "CO2": 0, "TVOC": 1}
    cells = [
        F.coalesce(fixed_text(F.col(m), d), F.lit("--")).alias(m.lower())
        for m, d in decimals.items()
    ]
    return nodes.join(wide, "node", "left").select("ord", "node", "name", *cells)


def short_summary(current: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Average temperature and humidity over the nodes, and the number of breaches."""
    scored = score_breaches(current, thresholds)
    return scored.agg(
        F.avg(F.when(F.col("metric") == "Temp", F.col("value"))).alias("avg_temp"),
        F.avg(F.when(F.col("metric") == "Humid", F.col("value"))).alias("avg_humid"),
        F.count_if(F.col("direction").isNotNull()).alias("n_breaches"),
    )


def value_bands(current: DataFrame, metrics: DataFrame) -> DataFrame:
    """low / mid / high at 35 % and 65 % of the metric's colour range."""
    span = F.col("vmax") - F.col("vmin")
    band = (
        F.when(F.col("value") > F.col("vmin") + span * 0.65, "high")
        .when(F.col("value") > F.col("vmin") + span * 0.35, "mid")
        .otherwise("low")
    )
    return current.join(metrics, "metric").withColumn("band", band).drop("unit", "vmin", "vmax")


# --- client payloads ------------------------------------------------------------


def _legacy_name():
    return F.concat_ws("_", "node", F.when(F.col("metric") == "Humid", "Hum").otherwise(F.col("metric")))


def snapshot_texts(frame: DataFrame) -> DataFrame:
    """Latest frame row as ``(name, text)`` with two decimals, plus its timestamp."""
    last = last_rows(frame, 1)
    stamp = last.agg(
        F.lit("Timestamp").alias("name"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("text"),
    )
    texts = last.select(
        _legacy_name().alias("name"), fixed_text(F.col("value")).alias("text")
    )
    return texts.unionByName(stamp)


def snapshot_json(frame: DataFrame) -> DataFrame:
    """The same snapshot as one JSON object; one entry per channel."""
    entries = F.array_sort(F.collect_list(F.struct("name", "text")))
    return snapshot_texts(frame).agg(F.to_json(F.map_from_entries(entries)).alias("payload"))


def history_json(frame: DataFrame, n: int) -> DataFrame:
    """One JSON object per timestamp of the last ``n`` frame rows, missing values left out."""
    rows = last_rows(frame, n).filter(F.col("value").isNotNull())
    entries = F.array_sort(
        F.collect_list(F.struct(_legacy_name().alias("name"), fixed_text(F.col("value")).alias("text")))
    )
    created = F.array(
        F.struct(F.lit("created").alias("name"), F.date_format("ts", "HH:mm:ss").alias("text"))
    )
    return (
        rows.groupBy("ts")
        .agg(entries.alias("_entries"))
        .select("ts", F.to_json(F.map_from_entries(F.concat("_entries", created))).alias("payload"))
    )


def history_envelope(frame: DataFrame, n: int) -> DataFrame:
    """{date, count, data} of the last ``n`` rows as one row; ``n`` bounds its size."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "payload")))
    return history_json(frame, n).agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("date"),
        F.count(F.lit(1)).alias("count"),
        F.transform(rows, lambda r: r["payload"]).alias("data"),
    )


# --- histories ------------------------------------------------------------------


def smooth(
    readings: DataFrame,
    window_rows: int = 5,
    drop_missing: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Centred moving average over the rows of each channel, as ``smoothed``.

    With ``drop_missing`` missing values do not occupy a row; without, ``pos`` must be present and
    a missing value shows the mean of its neighbours.
    """
    half = window_rows // 2
    rows = readings
    if drop_missing:
        rows = with_position(readings.filter(F.col("value").isNotNull()), KEYS)
    return rows_frame(
        rows,
        KEYS,
        {"smoothed": lambda w: F.avg("value").over(w.rowsBetween(-half, half))},
        before=half,
        after=half,
        block_rows=block_rows,
    )


def cross_node(readings: DataFrame) -> DataFrame:
    """Mean, lowest and highest over the nodes per timestamp and metric."""
    return readings.groupBy("ts", "metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def resample_smoothed(readings: DataFrame, width: str = "30 minutes", **options) -> DataFrame:
    """Smoothed, then averaged per time step; empty steps are left out."""
    return (
        smooth(readings, **options)
        .groupBy(floor_to("ts", width).alias("ts"), *KEYS)
        .agg(F.avg("smoothed").alias("value"))
    )


def day_frames(readings: DataFrame, width_us: int = 30 * MINUTE_US) -> DataFrame:
    """Mean per local day and half hour, with the empty half hours between the first and last.

    A channel's means of a day form one map, at most a day's steps long, and the spine is generated
    beside it. A day's first and last step combine before their shuffle: one row a day, joined by size.
    """
    step = F.floor(micros("ts") / width_us).cast("bigint")
    means = readings.groupBy(F.to_date("ts").alias("day"), *KEYS, step.alias("step")).agg(
        F.avg("value").alias("value")
    )
    ends = means.groupBy("day").agg(F.min("step").alias("_first"), F.max("step").alias("_last"))
    return (
        means.groupBy("day", *KEYS)
        .agg(F.map_from_entries(F.collect_list(F.struct("step", "value"))).alias("_means"))
        .join(ends, "day")
        .withColumn("step", F.explode(F.sequence("_first", "_last")))
        .select(
            "day",
            from_micros(F.col("step") * width_us).alias("ts"),
            (F.col("step") - F.col("_first")).alias("pos"),
            *KEYS,
            F.try_element_at("_means", F.col("step")).alias("value"),
        )
    )


def filled_day_frames(frames: DataFrame, limit: int = 6) -> DataFrame:
    """Day frames with gaps of at most ``limit`` steps bridged; a day of a channel is one group."""
    return interpolate_limited(frames, limit, ["day", *KEYS], block_rows=None)


def hourly_snapshots(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per hour: the last reading of every channel, their number and how many breach."""
    last = (
        readings.filter(F.col("value").isNotNull())
        .groupBy(floor_to("ts", "1 hour").alias("hour"), *KEYS)
        .agg(F.max_by("value", "ts").alias("value"))
    )
    return score_breaches(last, thresholds).groupBy("hour").agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.count_if(F.col("direction").isNotNull()).alias("n_breaches"),
    )


def sampling_step(readings: DataFrame, default_us: int = schema.DEFAULT_STEP_US) -> DataFrame:
    """Median positive gap between frame timestamps in microseconds; one row ``step_us``."""
    times = readings.select("ts").distinct().withColumn("_us", micros("ts"))
    gaps = with_previous(times, [], {"_last": "_us"}).select(
        (F.col("_us") - F.col("_last")).alias("gap")
    )
    median = exact_quantile(gaps.filter("gap > 0"), [], "gap")
    return median.agg(
        F.coalesce(F.max("quantile"), F.lit(float(default_us))).alias("step_us")
    )


def compare_nodes(
    frame: DataFrame, node_a: str, node_b: str, rows: int = schema.COMPARE_ROWS
) -> DataFrame:
    """Two nodes side by side over the last rows of the last day: smoothed values, the sign of
    the area between them, and the last difference per metric."""
    window = last_rows(trailing(frame, "day"), rows)
    smoothed = smooth(
        window.filter(F.col("node").isin(node_a, node_b)), drop_missing=False
    )
    sides = smoothed.groupBy("ts", "metric").agg(
        F.max(F.when(F.col("node") == node_a, F.col("smoothed"))).alias("a"),
        F.max(F.when(F.col("node") == node_b, F.col("smoothed"))).alias("b"),
    )
    last = Window.partitionBy("metric").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return (
        sides.withColumn(
            "above", F.when(F.col("b") >= F.col("a"), node_b).when(F.col("b") < F.col("a"), node_a)
        )
        .withColumn("last_delta", F.last(F.col("b") - F.col("a")).over(last))
    )


# --- state of the fleet -----------------------------------------------------------


def active_nodes(readings: DataFrame, minutes: int = 60, as_of=None) -> DataFrame:
    """Nodes with a known value in the last ``minutes`` (cutoff inclusive)."""
    end = end_of(readings) if as_of is None else as_of
    recent = readings.filter(
        (F.col("ts") >= end - F.expr(f"INTERVAL {minutes} MINUTES")) & F.col("value").isNotNull()
    )
    return recent.select("node").distinct()


def silent_nodes(readings: DataFrame, nodes: DataFrame, minutes: int = 60, as_of=None) -> DataFrame:
    return nodes.join(active_nodes(readings, minutes, as_of), "node", "left_anti")


def frozen_channels(frame: DataFrame, rows: int = schema.FROZEN_ROWS) -> DataFrame:
    """Channels whose last ``rows`` frame rows are all known and all equal."""
    return (
        last_rows(frame, rows)
        .groupBy(*KEYS)
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
        .filter((F.col("n") == rows) & (F.col("lowest") == F.col("highest")))
        .select(*KEYS, F.col("lowest").alias("value"))
    )


def situation(
    readings: DataFrame, frame: DataFrame, nodes: DataFrame, thresholds: DataFrame
) -> DataFrame:
    """One row: newest time, active, silent and frozen members, alerts on the latest values."""

    def names(df: DataFrame, column, alias: str) -> DataFrame:
        return df.agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(alias))

    channel = F.concat_ws("_", "node", "metric")
    alerts = score_breaches(latest(readings), thresholds).filter(F.col("direction").isNotNull())
    alert_text = F.concat(
        channel, F.lit("="), fixed_text(F.col("value"), 1), F.lit(" ["), F.col("direction"), F.lit("]")
    )
    newest = readings.agg(F.date_format(F.max("ts"), "dd/MM/yyyy HH:mm").alias("latest_data"))
    return newest.select(
        "latest_data",
        names(active_nodes(readings), F.col("node"), "active").scalar().alias("active"),
        names(silent_nodes(readings, nodes), F.col("node"), "silent").scalar().alias("silent"),
        names(frozen_channels(frame), channel, "frozen").scalar().alias("frozen"),
        names(alerts, alert_text, "alerts").scalar().alias("alerts"),
    )


def freshness(readings: DataFrame, nodes: DataFrame, as_of=None) -> DataFrame:
    """Age of each node's newest row at ``as_of`` and its status."""
    end = end_of(readings) if as_of is None else as_of
    newest = readings.groupBy("node").agg(F.max("ts").alias("last_ts"))
    age = F.greatest(
        F.lit(0), F.floor((micros(end) - micros("last_ts")) / 1_000_000).cast("bigint")
    )
    return (
        nodes.join(newest, "node", "left")
        .withColumn("age_s", age)
        .withColumn("age_s", F.when(F.col("last_ts").isNotNull(), F.col("age_s")))
        .withColumn(
            "status",
            F.when(F.col("age_s") > 900, "unhealthy")
            .when(F.col("age_s").isNull() | (F.col("age_s") >= 300), "degraded")
            .otherwise("ok"),
        )
        .drop("name", "ord")
    )


def usage_rollup(log: DataFrame) -> DataFrame:
    """Per command: calls, mean and 95th percentile latency, tokens, share answered from cache."""
    totals = log.groupBy("command").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.avg(F.col("is_cached").cast("double")).alias("cache_ratio"),
    )
    tail = exact_quantile(log, ["command"], "latency_ms", 0.95, 1000.0)
    return totals.join(tail.withColumnRenamed("quantile", "p95_latency_ms"), "command", "left")
