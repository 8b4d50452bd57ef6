"""The cleaning gate: flat stretches, spikes, gaps (in that order), and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorlake.functions.times import SECOND_US, floor_to, micros
from sensorlake.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    block_windows,
    carry,
    rows_frame,
    with_position,
)
from sensorlake.schema import CHANNELS, MIN_ROWS
from sensorlake.session import materialise

KEYS = ["node", "metric"]


class DataQualityError(RuntimeError):
    """The input has too few rows, or no channel with a usable value."""


def to_grid(readings: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mean per time step, node and metric. Empty steps have no row."""
    return readings.groupBy(floor_to("ts", width).alias("ts"), *KEYS).agg(
        F.avg("value").alias("value")
    )


def reading_gap_us(readings: DataFrame) -> int:
    """Mean distance of a channel's readings in whole seconds, as microseconds; a second at least."""
    at = micros("ts")
    row = readings.agg(
        F.coalesce(F.max(at) - F.min(at), F.lit(0)).alias("span"),
        F.count_distinct(*KEYS).alias("channels"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    gap = row["span"] // SECOND_US * row["channels"] // max(1, row["rows"])
    return max(1, gap) * SECOND_US


def latest_per_timestamp(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    # Column by column: numbers then aggregate in a hash table, without a sort.
    return (
        rows.groupBy(*keys)
        .agg(*[F.max_by(c, order).alias(c) for c in rest])
        .select(*rows.columns)
    )


def channels_of(readings: DataFrame) -> list[tuple[str, str]]:
    """The fleet's channels, then all others that ``readings`` has: one entry per sensor."""
    found = {tuple(row) for row in readings.select(*KEYS).dropna().distinct().collect()}
    return [*CHANNELS, *sorted(found.difference(CHANNELS))]


def densify(readings: DataFrame, channels: list[tuple[str, str]] | None = None) -> DataFrame:
    """The shared frame: every timestamp has a row for every channel, with its frame position.

    Without ``channels`` these are the fleet's and any others in the data. ``(ts, node, metric)``
    must be unique; readings without a node or metric belong to no channel. One list per timestamp,
    at most as long as the fleet; the channels that it lacks are added to it, in linear time.
    """
    if channels is None:
        channels = channels_of(readings)
    names = F.array(
        *[F.struct(F.lit(n).alias("node"), F.lit(m).alias("metric")) for n, m in channels]
    )
    numbers = readings.sparkSession.range(1).select(F.posexplode(names).alias("_channel", "_name"))
    numbers = numbers.select("_channel", "_name.node", "_name.metric")
    numbered = readings.select("ts", *KEYS, "value").join(numbers, KEYS, "left")
    known = F.when(F.col("_channel").isNotNull(), F.struct("_channel", "value"))
    per_ts = numbered.groupBy("ts").agg(F.collect_list(known).alias("_known"))
    nothing = F.lit(None).cast(readings.schema["value"].dataType)
    lacking = F.transform(
        F.array_except(F.sequence(F.lit(0), F.lit(len(channels) - 1)), F.col("_known._channel")),
        lambda i: F.struct(i.alias("_channel"), nothing.alias("value")),
    )
    return (
        with_position(per_ts, [], "ts")
        .select("ts", "pos", F.inline(F.concat("_known", lacking)))
        .join(numbers, "_channel")
        .select("ts", "pos", *KEYS, "value")
    )


def flatlines(
    frame: DataFrame,
    window_rows: int = 20,
    epsilon: float = 1e-4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the trailing variance and count, and ``is_flat`` where a value hardly moves."""
    window_rows = max(3, window_rows)
    min_count = max(3, window_rows // 2)

    def trailing(window):
        return window.rowsBetween(1 - window_rows, 0)

    scored = rows_frame(
        frame,
        KEYS,
        {
            "roll_n": lambda w: F.count("value").over(trailing(w)),
            "roll_var": lambda w: F.var_pop("value").over(trailing(w)),
        },
        before=window_rows - 1,
        after=0,
        block_rows=block_rows,
    )
    enough = F.col("roll_n") >= min_count
    return scored.withColumn("roll_var", F.when(enough, F.col("roll_var"))).withColumn(
        "is_flat",
        F.coalesce((F.col("roll_var") < epsilon) & F.col("value").isNotNull(), F.lit(False)),
    )


def outliers(frame: DataFrame, threshold: float = 3.0, value: str = "value") -> DataFrame:
    """Adds ``zscore`` and ``is_outlier`` from each channel's mean and spread over all history.

    The moments aggregate map-side to one row per channel; no time filter may go below them.
    """
    moments = frame.groupBy(*KEYS).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    usable = F.col("_std") > 0
    return (
        frame.join(moments, KEYS, "left")
        .withColumn("zscore", F.when(usable, (F.col(value) - F.col("_mean")) / F.col("_std")))
        .withColumn("is_outlier", F.coalesce(F.abs("zscore") > threshold, F.lit(False)))
        .drop("_mean", "_std")
    )


def _neighbours(frame, keys, value, pos, block_rows):
    """Adds the nearest known value and position at or before (``_v0``, ``_p0``), and at or after
    (``_v1``, ``_p1``), each row. Without ``block_rows`` a key is one ordered group."""
    df = frame.withColumn("_known", F.when(F.col(value).isNotNull(), F.col(pos)))
    if block_rows is None:
        key, running = Window.partitionBy(*keys), (Window.unboundedPreceding, 0)
        upto = key.orderBy(pos).rowsBetween(*running)
        back = key.orderBy(F.desc(pos)).rowsBetween(*running)
    else:
        block = F.floor(F.col(pos) / block_rows).cast("bigint")
        df = carry(
            df.withColumn(BLOCK, block), keys, pos,
            last={"_v0_in": value, "_p0_in": "_known"},
            first={"_v1_in": value, "_p1_in": "_known"},
        )
        upto, back, _ = block_windows(keys, pos)

    def nearest(column, window, outside):
        inside = F.last(column, True).over(window)
        return inside if block_rows is None else F.coalesce(inside, F.col(outside))

    return (
        df.withColumn("_v0", nearest(value, upto, "_v0_in"))
        .withColumn("_p0", nearest("_known", upto, "_p0_in"))
        .withColumn("_v1", nearest(value, back, "_v1_in"))
        .withColumn("_p1", nearest("_known", back, "_p1_in"))
        .select(*frame.columns, "_v0", "_p0", "_v1", "_p1")
    )


def _on_line(value: str, pos: str) -> Column:
    slope = (F.col("_v1") - F.col("_v0")) / (F.col("_p1") - F.col("_p0"))
    between = F.col("_p1") > F.col("_p0")
    return F.coalesce(
        F.col(value), F.when(between, F.col("_v0") + slope * (F.col(pos) - F.col("_p0")))
    )


def interpolate(
    frame: DataFrame,
    keys: list[str] = KEYS,
    value: str = "value",
    out: str = "filled",
    pos: str = "pos",
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Linear in row position; both ends repeat the nearest known value."""
    df = _neighbours(frame, keys, value, pos, block_rows)
    filled = F.coalesce(_on_line(value, pos), F.col("_v0"), F.col("_v1"))
    return df.withColumn(out, filled).drop("_v0", "_p0", "_v1", "_p1")


def interpolate_limited(
    frame: DataFrame,
    limit: int = 6,
    keys: list[str] = KEYS,
    value: str = "value",
    out: str = "filled",
    pos: str = "pos",
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Linear on a regular step, forward only: at most ``limit`` steps into a gap.

    Rows before the first known value stay null; after the last one it repeats, up to the limit.
    """
    df = _neighbours(frame, keys, value, pos, block_rows)
    reach = F.col(pos) - F.col("_p0") <= limit
    filled = F.when(reach, F.coalesce(_on_line(value, pos), F.col("_v0")))
    return df.withColumn(out, F.coalesce(F.col(value), filled)).drop("_v0", "_p0", "_v1", "_p1")


def fill_forward_backward(
    frame: DataFrame,
    keys: list[str] = KEYS,
    value: str = "value",
    out: str = "filled",
    pos: str = "pos",
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Last known value, else the next one."""
    df = _neighbours(frame, keys, value, pos, block_rows)
    filled = F.coalesce(F.col(value), F.col("_v0"), F.col("_v1"))
    return df.withColumn(out, filled).drop("_v0", "_p0", "_v1", "_p1")


def flagged(frame: DataFrame, **options) -> DataFrame:
    """Flat and spike flags with the surviving value, before gaps are filled.

    The flat-stretch result is written once: the spread over all history and everything after it
    read it, and recomputing it would shuffle the frame each time.
    """
    zscore = options.pop("zscore", 3.0)
    flat = materialise(
        flatlines(frame, **options).withColumn("kept", F.when(~F.col("is_flat"), F.col("value")))
    )
    return outliers(flat, zscore, "kept").withColumn(
        "kept", F.when(~F.col("is_outlier"), F.col("kept"))
    )


def clean(frame: DataFrame, **options) -> DataFrame:
    """Cleaned frame ``(ts, pos, node, metric, value)`` without fully missing channels.

    After interpolation a channel is null everywhere or nowhere, so dropping the dead channels is
    a filter, not a second pass.
    """
    return _cleaned(_filled(flagged(frame, **options), options))


def _filled(flags: DataFrame, options: dict) -> DataFrame:
    return interpolate(flags, value="kept", block_rows=options.get("block_rows", BLOCK_ROWS))


def _cleaned(filled: DataFrame) -> DataFrame:
    return filled.filter(F.col("filled").isNotNull()).select(
        "ts", "pos", *KEYS, F.col("filled").alias("value")
    )


def gated_clean(frame: DataFrame, min_rows: int = MIN_ROWS, **options) -> DataFrame:
    """``clean`` behind the gate: ``DataQualityError`` on an empty frame, on too few rows and where no
    channel is usable. Flags and fills are worked out once, for the report and the result."""
    filled = materialise(_filled(flagged(frame, **options), options))
    require_quality(_report(filled, min_rows))
    return _cleaned(filled)


def dead_channels(frame: DataFrame, value: str = "value") -> DataFrame:
    return (
        frame.groupBy(*KEYS)
        .agg(F.count(value).alias("_n"))
        .filter("_n = 0")
        .drop("_n")
    )


def drop_dead_channels(frame: DataFrame, value: str = "value") -> DataFrame:
    return frame.join(dead_channels(frame, value), KEYS, "left_anti")


def quality_report(frame: DataFrame, min_rows: int = MIN_ROWS, **options) -> DataFrame:
    """One row per channel: what came in, what each step removed, what was filled, and what is still
    missing after that in a channel that stays."""
    return _report(_filled(flagged(frame, **options), options), min_rows)


def _report(filled: DataFrame, min_rows: int) -> DataFrame:
    return (
        filled.groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("value").alias("n_in"),
            F.count_if("is_flat").alias("n_flat"),
            F.count_if("is_outlier").alias("n_outlier"),
            F.count("kept").alias("n_kept"),
            F.count("filled").alias("_n_after"),
        )
        .withColumn("dropped", F.col("n_kept") == 0)
        .withColumn("n_filled", F.when(F.col("dropped"), 0).otherwise(F.col("_n_after") - F.col("n_kept")))
        .withColumn("n_missing_after", F.when(F.col("dropped"), 0).otherwise(F.col("n_rows") - F.col("_n_after")))
        .withColumn("enough_rows", F.col("n_rows") >= min_rows)
        .drop("_n_after")
    )


def row_gate(frame: DataFrame, min_rows: int = MIN_ROWS, by: list[str] = []) -> DataFrame:
    """Timestamps in the frame and whether they suffice: one row, or one for each group of ``by``."""
    return (
        frame.select(*by, "ts")
        .distinct()
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("enough_rows", F.col("n_rows") >= min_rows)
    )


def require_quality(report: DataFrame) -> None:
    """Raises where the gate must stop: one small aggregate over the report."""
    row = report.agg(
        F.max("n_rows").alias("rows"),
        F.bool_or("enough_rows").alias("enough"),
        F.count_if(~F.col("dropped")).alias("usable"),
    ).first()
    if not row["rows"]:
        raise DataQualityError("Input is empty.")
    if not row["enough"]:
        raise DataQualityError(f"Too few rows: {row['rows']}.")
    if not row["usable"]:
        raise DataQualityError("No channel is left after cleaning.")
