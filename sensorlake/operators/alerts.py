"""Threshold breaches, hysteresis, episodes, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sensorlake import schema
from sensorlake.functions.times import SECOND_US, from_micros, micros
from sensorlake.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    block_windows,
    earlier_blocks,
    with_row_block,
)
from sensorlake.operators.cooldown import greedy_accept
from sensorlake.session import materialise

KEYS = ["node", "metric"]


def with_bounds(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings of a metric without thresholds stay, with null bounds, and never breach."""
    return readings.join(thresholds, "metric", "left")


def score_breaches(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds direction (HIGH / LOW / null), severity (distance beyond the bound) and reason."""
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    scored = with_bounds(readings, thresholds).withColumn(
        "direction", F.when(value > hi, "HIGH").when(value < lo, "LOW")
    )
    high, low = F.col("direction") == "HIGH", F.col("direction") == "LOW"
    return scored.withColumn(
        "severity", F.when(high, value - hi).when(low, lo - value).otherwise(0.0)
    ).withColumn("reason", F.when(high, F.col("hi_reason")).when(low, F.col("lo_reason")))


def breaches(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    return (
        score_breaches(readings, thresholds)
        .filter(F.col("direction").isNotNull())
        .drop("lo", "hi", "margin", "lo_reason", "hi_reason")
    )


def breach_state(
    readings: DataFrame, thresholds: DataFrame, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``is_breach``, ``active``, ``onset`` and ``started`` in time order of each channel.

    A breach switches the channel on. A value well inside the bounds, or a missing one, switches
    it off; a value within the margin keeps the state. ``started`` is the onset time of the episode
    an active row belongs to.

    Windows see one block of a channel. A block knows its own switches; from outside it needs
    only the state and the last onset before it, both of which follow from a per-block summary.
    """
    scored = score_breaches(readings, thresholds)
    value = F.col("value")
    inside_hi = F.col("hi").isNull() | (value <= F.col("hi") - F.col("margin"))
    inside_lo = F.col("lo").isNull() | (value >= F.col("lo") + F.col("margin"))
    flag = (
        F.when(F.col("direction").isNotNull(), 1)
        .when(value.isNull(), 0)
        .when(inside_hi & inside_lo, 0)
    )
    df = with_row_block(
        scored.withColumn("_flag", flag).withColumn("_at", micros("ts")), KEYS, "_at", block_rows
    )
    upto, _, base = block_windows(KEYS, "ts")
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    known_ts = F.when(F.col("_flag").isNotNull(), F.col("ts"))
    df = (
        df.withColumn("_prev", F.last("_flag", True).over(before))
        .withColumn("_now", F.last("_flag", True).over(upto))
        .withColumn("_first", F.first("_flag", True).over(upto))
        .withColumn("_first_ts", F.min(known_ts).over(upto))
        .withColumn("_switch", F.when((F.col("_flag") == 1) & (F.col("_prev") == 0), F.col("ts")))
        .withColumn("_switched", F.max("_switch").over(upto))
    )
    # A block that opens with a breach starts an episode unless the channel was already on.
    opens = (F.col("_first") == 1) & (F.coalesce("_flag_in", F.lit(0)) == 0)
    outside = earlier_blocks(KEYS)
    carried = (
        df.groupBy(*KEYS, BLOCK)
        .agg(
            F.max_by("_flag", known_ts).alias("_last"),
            F.min_by("_flag", known_ts).alias("_first"),
            F.min(known_ts).alias("_first_ts"),
            F.max("_switch").alias("_switch"),
        )
        .withColumn("_flag_in", F.last("_last", True).over(outside))
        .withColumn("_start", F.coalesce("_switch", F.when(opens, F.col("_first_ts"))))
        .select(*KEYS, BLOCK, "_flag_in", F.max("_start").over(outside).alias("_start_in"))
    )
    entering = F.coalesce("_flag_in", F.lit(0))
    started = F.coalesce("_switched", F.when(opens, F.col("_first_ts")), "_start_in")
    return (
        df.join(carried, [*KEYS, BLOCK], "left")
        .withColumn("active", F.coalesce("_now", entering))
        .withColumn("onset", (F.col("active") == 1) & (F.coalesce("_prev", entering) == 0))
        .withColumn("started", F.when(F.col("active") == 1, started))
        .withColumn("is_breach", F.col("direction").isNotNull())
        .select(
            *readings.columns, "direction", "severity", "reason", "is_breach", "active", "onset",
            "started",
        )
    )


def episodes(state: DataFrame) -> DataFrame:
    """One row per breach episode: begin, end, length, readings, greatest severity."""
    return (
        state.filter("active = 1")
        .groupBy(*KEYS, "started")
        .agg(
            F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("n_readings"),
            F.max("severity").alias("peak_severity"),
        )
        .withColumn("duration_us", micros("ended") - micros("started"))
    )


def notifications(
    state: DataFrame,
    cooldown_s: int = schema.ALERT_COOLDOWN_S,
    reminder_s: int = schema.REMINDER_S,
) -> DataFrame:
    """New, suppressed and reminder notices ``(ts, node, metric, kind, value, severity, ...)``.

    An onset is sent unless the channel's last sent onset is under ``cooldown_s`` old. A channel
    still in breach is sent again once more than ``reminder_s`` passed since its last notice.
    """
    rows = state.filter("onset OR (active = 1 AND is_breach)").select(
        "ts", *KEYS, "value", "severity", "direction", "reason", "onset", "is_breach", "started",
        micros("ts").alias("at_us"),
    )
    # Used three times below, and far smaller than the readings.
    rows = materialise(rows)
    content = ["ts", *KEYS, "value", "severity", "direction", "reason"]
    onsets = greedy_accept(
        rows.filter("onset").select(*content, "at_us"), KEYS, "at_us", cooldown_s * SECOND_US
    )
    noticed = materialise(
        onsets.withColumn(
            "kind", F.when(F.col("accepted"), "new").otherwise("suppressed")
        ).withColumn("base_us", F.col("last_us"))
    )

    # Reminders: only episodes that outlast the reminder gap have any, so the rest drop out first.
    bases = noticed.select(*KEYS, F.col("ts").alias("started"), "base_us")
    late = (
        rows.filter(F.col("is_breach") & ~F.col("onset"))
        .join(bases, [*KEYS, "started"])
        .filter(F.col("at_us") - F.col("base_us") > reminder_s * SECOND_US)
    )
    reminded = greedy_accept(
        late.select(*content, "at_us", "started", "base_us"),
        [*KEYS, "started"],
        "at_us",
        reminder_s * SECOND_US,
        strict=True,
        start="base_us",
    ).filter("accepted")
    return noticed.select(*content, "at_us", "kind").unionByName(
        reminded.select(*content, "at_us", F.lit("reminder").alias("kind"))
    )


def cooldown(
    events: DataFrame, keys: list[str], cooldown_s: int, ts: str = "ts"
) -> DataFrame:
    """Events of ``keys`` that pass a plain cooldown (no reminders)."""
    timed = events.withColumn("at_us", micros(ts))
    marked = greedy_accept(timed, keys, "at_us", cooldown_s * SECOND_US)
    return marked.filter("accepted").drop("accepted", "prev_us", "last_us", "at_us")


def most_severe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One breach per key: greatest severity, the later one when equal."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("severity", "ts"))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def notification_batches(
    notices: DataFrame, window_s: int = schema.BATCH_WINDOW_S
) -> DataFrame:
    """Groups sent notices into messages and keeps the most severe per channel and kind.

    A batch opens at its first notice and takes everything up to ``window_s`` later; it does not
    slide. The next notice opens a new one.
    """
    sent = notices.filter(F.col("kind") != "suppressed")
    opened = greedy_accept(sent, [], "at_us", window_s * SECOND_US, strict=True).withColumn(
        "batch_start", from_micros("last_us")
    )
    rows = opened.drop("accepted", "prev_us", "last_us", "at_us")
    return most_severe(rows, ["batch_start", "kind", *KEYS])


def resolved(previous: DataFrame, current: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Channels that were in breach before and are no longer; ``keys`` may hold a time as well."""
    return previous.select(*keys).distinct().join(
        current.select(*keys).distinct(), keys, "left_anti"
    )
