"""Alert notifications with per-channel state, in event time whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorlake import schema
from sensorlake.functions.times import SECOND_US, micros
from sensorlake.operators.alerts import score_breaches

NOTICE_TYPE = (
    "node string, metric string, at_us bigint, value double, severity double,"
    " direction string, reason string, kind string"
)
# active: in breach; sent_us: last sent onset; notice_us: last notice of the running episode.
STATE_TYPE = "active boolean, sent_us bigint, notice_us bigint"
WAITING = ["at_us", "value", "severity", "direction", "reason"]
WAITING_TYPE = "at_us bigint, value double, severity double, direction string, reason string"


class NoticeProcessor(StatefulProcessor):
    """Holds a channel's readings until the watermark has passed them, then takes them in time order.

    An event-time timer stands at the earliest reading that waits. The state is the readings within the
    allowed lateness and three values.
    """

    def __init__(self, cooldown_us: int, reminder_us: int):
        self.cooldown_us, self.reminder_us = cooldown_us, reminder_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", STATE_TYPE)
        self.waiting = handle.getListState("waiting", WAITING_TYPE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for batch in rows for r in _plain(batch)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[0] <= passed_us), key=lambda r: (r[0], str(r[1:])))
        if not due:
            return
        later = [r for r in held if r[0] > passed_us]
        if later:
            self.waiting.put(later)
            self._wake(min(r[0] for r in later))
        else:
            self.waiting.clear()
        kinds = self._kinds(due)
        out = pd.DataFrame(due, columns=WAITING).assign(node=key[0], metric=key[1], kind=kinds)
        out = out[out["kind"].notna()]
        if len(out):
            yield out[["node", "metric", *WAITING, "kind"]]

    def _wake(self, at_us: int) -> None:
        # The first whole millisecond at or after the reading.
        self.handle.registerTimer(-(-at_us // 1000))

    def _kinds(self, rows: list[tuple]) -> list[str | None]:
        active, sent, notice = self.rule.get() if self.rule.exists() else (False, None, None)
        kinds: list[str | None] = []
        for at, _, _, direction, _ in rows:
            kind = None
            if direction is None:
                active, notice = False, None
            elif not active:
                active = True
                if sent is None or at - sent >= self.cooldown_us:
                    kind, sent = "new", at
                else:
                    kind = "suppressed"
                notice = sent
            elif at - notice > self.reminder_us:
                kind, notice = "reminder", at
            kinds.append(kind)
        self.rule.update((active, sent, notice))
        return kinds

    def close(self) -> None:
        pass


def _plain(batch: pd.DataFrame) -> Iterator[list]:
    """Rows with Python values, null as ``None``."""
    batch = batch[WAITING].astype(object)
    return iter(batch.where(batch.notna(), None).to_numpy().tolist())


def use_timers(spark: SparkSession) -> None:
    """Timers need the state store that can hold several states per key."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def stream_notifications(
    readings: DataFrame,
    thresholds: DataFrame,
    cooldown_s: int = schema.ALERT_COOLDOWN_S,
    reminder_s: int = schema.REMINDER_S,
    late: str = "10 minutes",
) -> DataFrame:
    """The notices of ``operators.alerts.notifications`` for a stream, same rules.

    Readings may arrive in any order within ``late`` of the newest one; a notice is given once the
    watermark has passed its reading, so never too early. Later readings are dropped and counted in
    the query's progress (``numRowsDroppedByWatermark``). Only rows that can change a channel's state
    reach Python.
    """
    use_timers(readings.sparkSession)
    value = F.col("value")
    # Watermarks need an instant, not a zone-less label; all rows move it, also those left out below.
    timed = readings.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", late)
    scored = score_breaches(timed, thresholds)
    inside = (F.col("hi").isNull() | (value <= F.col("hi") - F.col("margin"))) & (
        F.col("lo").isNull() | (value >= F.col("lo") + F.col("margin"))
    )
    relevant = scored.filter(F.col("direction").isNotNull() | value.isNull() | inside).select(
        "node", "metric", "_time", micros("ts").alias("at_us"), "value", "severity", "direction", "reason"
    )
    return relevant.groupBy("node", "metric").transformWithStateInPandas(
        NoticeProcessor(cooldown_s * SECOND_US, reminder_s * SECOND_US), NOTICE_TYPE, "append", "EventTime"
    )
