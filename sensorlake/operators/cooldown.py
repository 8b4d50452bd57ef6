"""Greedy cooldown chains: accept an event unless the last accepted one is too recent.

Each decision depends on the one before, so this is no window function. It still splits, whatever the
number of events under a key: blocks of counted rows are reduced to step functions (last accepted
time before -> last accepted time after), neighbouring functions are merged into one, a few at a time
and level by level, as an associative merge allows, and the entering times are handed down the same
tree. No step gathers a key's blocks. A merged function has no more steps than there are events within
one gap: an earlier time lets the first event through anyway.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from sensorlake.operators.blocks import BLOCK, BLOCK_ROWS, with_row_block
from sensorlake.session import materialise

#: "Nothing accepted before". Far enough from the limit for sums.
UNSET = -(1 << 62)
#: Neighbouring step functions that one task merges.
FAN_IN = 16


class Steps:
    """A step function of the last accepted time: the first of ``upto`` that is a gap later decides, and
    its ``leave`` is accepted last; without one the time stays."""

    def __init__(self, upto, leave, opening: int, gap_us: int, side: str):
        self.upto, self.leave = np.asarray(upto, np.int64), np.asarray(leave, np.int64)
        self.opening, self.gap_us, self.side = opening, gap_us, side

    @classmethod
    def of_events(cls, times: np.ndarray, opening: int, gap_us: int, side: str) -> Steps:
        following = np.searchsorted(times, times + gap_us, side=side).tolist()
        leave, n = times.tolist(), len(times)
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                leave[i] = leave[following[i]]
        return cls(times, leave, opening, gap_us, side).trimmed()

    def trimmed(self) -> Steps:
        """Without the steps that no time up to ``opening`` can reach, and equal neighbours as one."""
        end = int(np.searchsorted(self.upto, self.opening + self.gap_us, side=self.side)) + 1
        upto, leave = self.upto[:end], self.leave[:end]
        keep = np.append(leave[1:] != leave[:-1], True)
        return Steps(upto[keep], leave[keep], self.opening, self.gap_us, self.side)

    def __call__(self, last: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, last + self.gap_us, side=self.side)
        return np.where(at < len(self.upto), self.leave[np.minimum(at, len(self.upto) - 1)], last)

    def then(self, later: Steps) -> Steps:
        return Steps(
            np.concatenate([self.upto, later.upto]),
            np.concatenate([later(self.leave), later.leave]),
            self.opening,
            self.gap_us,
            self.side,
        ).trimmed()


def greedy_accept(
    events: DataFrame,
    keys: list[str],
    at: str,
    gap_us: int,
    strict: bool = False,
    start: str | None = None,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Marks the events a cooldown of ``gap_us`` lets through, per key in order of ``at``.

    An event passes when ``at - last accepted >= gap_us`` (``>`` if ``strict``) or nothing was
    accepted before; ``start`` names a column with the key's initial last-accepted time. Without
    ``keys`` all events are one chain. Of events at one time that could pass one does, always the same.
    Adds ``accepted``, ``prev_us`` (last accepted before the row) and ``last_us`` (including it).
    """
    side = "right" if strict else "left"
    columns = events.columns
    if not keys:
        keys, events = ["_all"], events.withColumn("_all", F.lit(1))
    # Read for the sizes, the functions, their numbers and the decisions.
    rows = materialise(
        events.withColumn("_start", F.coalesce(F.col(start), F.lit(UNSET)) if start else F.lit(UNSET))
        .withColumn("_tie", F.xxhash64(F.lit(0), *[c for c in columns if c != at]))
    )
    if (_greatest(rows.groupBy(*keys).count(), "count") or 0) <= block_rows:
        whole = rows.withColumn(BLOCK, F.lit(0).cast("long")).withColumn("_enter", F.col("_start"))
        return _decided(whole, columns, keys, at, gap_us, side)
    blocked = materialise(with_row_block(rows, keys, at, block_rows))
    blocks = blocked.groupBy(*keys, BLOCK).agg(F.max("_start").alias("_start"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)) - 1
    numbered = materialise(blocks.withColumn("_node", number.cast("long")))
    entries = _entries(
        blocked, numbered, keys, at, gap_us, side, _greatest(numbered, "_node") + 1, fan_in
    )
    return _decided(blocked.join(entries, [*keys, BLOCK]), columns, keys, at, gap_us, side)


def _greatest(rows: DataFrame, column: str) -> int | None:
    return rows.agg(F.max(column)).first()[0]


def _entries(blocked, numbered, keys, at, gap_us, side, size, fan_in) -> DataFrame:
    """``keys, BLOCK, _enter``: the last accepted time before each block."""
    key_fields = [blocked.schema[k] for k in keys]
    long, longs = LongType(), ArrayType(LongType())
    node_type = StructType(
        [*key_fields, *(StructField(n, long) for n in ("_node", "_open", "_start")),
         StructField("_upto", longs), StructField("_leave", longs)]
    )

    def node(pdf: pd.DataFrame, number: int, steps: Steps) -> pd.DataFrame:
        out = pdf[keys].iloc[:1].reset_index(drop=True)
        out["_node"], out["_open"], out["_start"] = number, steps.opening, int(pdf["_start"].max())
        out["_upto"], out["_leave"] = [steps.upto.tolist()], [steps.leave.tolist()]
        return out

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf[at].to_numpy(np.int64))
        opening = max(int(times[0]), int(pdf["_start"].max()))
        return node(pdf, int(pdf["_node"].iloc[0]), Steps.of_events(times, opening, gap_us, side))

    def steps_of(row) -> Steps:
        return Steps(row["_upto"], row["_leave"], row["_open"], gap_us, side)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_node").to_dict("records")
        whole = steps_of(rows[0])
        for row in rows[1:]:
            whole = whole.then(steps_of(row))
        return node(pdf, int(rows[0]["_node"]) // fan_in, whole)

    def handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_node", ignore_index=True)
        last, enter = np.int64(pdf["_enter"].iloc[0]), []
        for row in pdf.to_dict("records"):
            enter.append(int(last))
            last = steps_of(row)(np.array([last]))[0]
        return pdf[[*keys, "_node"]].assign(_enter=enter)

    # Only the first block of a key can be entered with the start value.
    rows = blocked.drop("_start").join(numbered, [*keys, BLOCK]).select(*keys, "_node", "_start", at)
    levels = [materialise(rows.groupBy(*keys, "_node").applyInPandas(of_block, node_type))]
    while size > fan_in:
        parent = F.floor(F.col("_node") / fan_in).alias("_parent")
        levels.append(materialise(levels[-1].groupBy(*keys, parent).applyInPandas(merged, node_type)))
        size = -(-size // fan_in)
    enter_type = StructType([*key_fields, StructField("_node", long), StructField("_enter", long)])
    down = levels[-1].withColumn("_enter", F.col("_start")).groupBy(*keys).applyInPandas(handed_down, enter_type)
    for level in reversed(levels[:-1]):
        above = materialise(down).withColumnRenamed("_node", "_parent")
        children = level.withColumn("_parent", F.floor(F.col("_node") / fan_in)).join(above, [*keys, "_parent"])
        down = children.groupBy(*keys, "_parent").applyInPandas(handed_down, enter_type)
    return numbered.join(down, [*keys, "_node"]).select(*keys, BLOCK, "_enter")


def _decided(rows: DataFrame, columns, keys, at, gap_us, side) -> DataFrame:
    """Every block on its own, from its entering time."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, "_tie"], ignore_index=True)
        times = pdf[at].to_numpy(np.int64)
        enter, n = int(pdf["_enter"].iloc[0]), len(times)
        accepted = np.zeros(n, bool)
        following = np.searchsorted(times, times + gap_us, side=side)
        i = int(np.searchsorted(times, enter + gap_us, side=side))
        while i < n:
            accepted[i] = True
            i = int(following[i])
        # Accepted times only grow, so the last one so far is a running maximum.
        last = np.maximum(np.maximum.accumulate(np.where(accepted, times, UNSET)), enter)
        return pdf[columns].assign(accepted=accepted, prev_us=np.concatenate([[enter], last[:-1]]), last_us=last)

    fields = [rows.schema[c] for c in columns]
    marks = [StructField("accepted", BooleanType()), StructField("prev_us", LongType()), StructField("last_us", LongType())]
    decided = rows.groupBy(*keys, BLOCK).applyInPandas(decide, StructType([*fields, *marks]))
    return decided.withColumns(
        {name: F.nullif(F.col(name), F.lit(UNSET)) for name in ("prev_us", "last_us")}
    )
