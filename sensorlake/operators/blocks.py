"""Ordered windows that do not put one channel into one task.

A window over ``partitionBy(channel)`` gives each channel a single task, so a channel with a
third of all rows is the whole job. Here every channel is cut along its order into blocks, and
windows run over ``(channel, block)``:

* fixed row frames get the few neighbouring rows they need copied into the block
  (:func:`rows_frame`), with blocks of equally many rows;
* unbounded frames take what they need from outside the block as one carried value per block
  (:func:`carry`), found from a per-block aggregate. That aggregate has
  one row per block, so the window over it is small however many rows the channel has.

Both are exact. Blocks are cut by counted rows, never by the clock (:func:`with_row_block`), so they
stay small however unevenly the rows lie in time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorlake.functions.times import HOUR_US, block_of, micros

BLOCK = "_block"
BLOCK_ROWS = 50_000
#: Rows are counted per slot of this length; the rows of one slot stay together.
SLOT_US = 1_000
#: More than the slots of an hour, so that hour and piece make one number.
_PIECES = 1 << 22


def with_row_block(
    df: DataFrame, keys: list[str], at: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``BLOCK``, which rises with ``at`` (microseconds) within ``keys``.

    A block has at most about ``block_rows`` rows, or the rows of one slot if those are more. Rows
    of equal ``at`` share a block. Slots are counted map-side; the cuts inside an hour come from the
    slots of that hour, and hours with few rows share a block. So no window here sees more than the
    slots of an hour or the hours of a key, whatever the number of rows. A row finds its block by a
    binary search among the cuts of its hour.
    """
    # The last pieces of an hour, and the hours before it, may add up: each gets half.
    step = max(block_rows // 2, 1)
    in_hour = Window.partitionBy(*keys, "_hour").orderBy("_slot")
    hours = (
        df.groupBy(*keys, block_of(F.col(at), SLOT_US).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hour", F.floor(F.col("_slot") / (HOUR_US // SLOT_US)))
        .withColumn("_piece", F.floor((F.sum("_n").over(in_hour) - F.col("_n")) / step))
        .groupBy(*keys, "_hour", "_piece")
        .agg(F.min("_slot").alias("_from"), F.sum("_n").alias("_n"))
        .groupBy(*keys, "_hour")
        .agg(F.sort_array(F.collect_list("_from")).alias("_cuts"), F.sum("_n").alias("_n"))
    )
    in_key = Window.partitionBy(*keys).orderBy("_hour")
    shared = hours.withColumn(
        "_group", F.floor((F.sum("_n").over(in_key) - F.col("_n")) / step)
    ).select(
        *keys, "_hour", "_cuts", F.min("_hour").over(Window.partitionBy(*keys, "_group")).alias("_opens")
    )
    slot = block_of(F.col(at), SLOT_US)
    halves = F.array(*[F.lit(_PIECES >> i) for i in range(1, 23)])
    piece = F.when(F.size("_cuts") == 1, 0).otherwise(
        F.aggregate(
            halves,
            F.lit(0),
            lambda i, half: F.when(F.get("_cuts", i + half) <= slot, i + half).otherwise(i),
        )
    )
    return (
        df.withColumn("_hour", block_of(F.col(at), HOUR_US))
        .join(shared, [*keys, "_hour"], "left")
        .withColumn(BLOCK, F.col("_opens") * _PIECES + piece)
        .drop("_hour", "_cuts", "_opens")
    )


def with_position(
    df: DataFrame, keys: list[str], ts: str = "ts", pos: str = "pos", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """0-based position in ``ts`` order within ``keys``; ``(keys, ts)`` must be unique.

    Row numbers inside a block plus the row count of all earlier blocks.
    """
    blocked = with_row_block(df.withColumn("_at", micros(ts)), keys, "_at", block_rows).drop("_at")
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ts)
    return (
        blocked.join(offsets, [*keys, BLOCK])
        .withColumn(pos, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop(BLOCK, "_offset")
    )


def rows_frame(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, Callable[[Window], Column]],
    before: int,
    after: int,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds columns computed over the frame ``[pos - before, pos + after]`` of each key.

    ``pos`` is a dense position. ``columns`` maps a name to a function of the ordered window,
    on which it sets its own row frame within the stated reach.
    """
    size = max(block_rows, before + after, 1)
    block = F.floor(F.col(pos) / size).cast("bigint")
    offset = F.col(pos) - block * size
    homes = [block]
    if before:
        homes.append(F.when(offset >= size - before, block + 1))
    if after:
        homes.append(F.when(offset < after, block - 1))
    spread = df.withColumn("_home", block).withColumn(
        BLOCK, F.explode(F.array_compact(F.array(*homes)))
    )
    window = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    for name, make in columns.items():
        spread = spread.withColumn(name, make(window))
    return spread.filter(F.col("_home") == F.col(BLOCK)).drop("_home", BLOCK)


def earlier_blocks(keys: list[str]):
    """Window over a per-block summary: all blocks before the row's."""
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def later_blocks(keys: list[str]):
    """All blocks after the row's, last one first: the nearest one is the ``last`` of this window.

    A frame that reaches to the end would be summed up anew for every row; over the falling order
    the same rows are a running frame.
    """
    return (
        Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    )


def carry(
    df: DataFrame,
    keys: list[str],
    order: str,
    last: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
) -> DataFrame:
    """Adds values from outside the block, each as ``{name: column}``.

    ``last`` takes the column's last non-null value in any earlier block of the key, ``first`` its
    first non-null value in any later block.
    """
    last, first = last or {}, first or {}

    def known(column):
        return F.when(F.col(column).isNotNull(), F.col(order))

    summary = df.groupBy(*keys, BLOCK).agg(
        *[F.max_by(c, known(c)).alias(name) for name, c in last.items()],
        *[F.min_by(c, known(c)).alias(name) for name, c in first.items()],
    )
    before, after = earlier_blocks(keys), later_blocks(keys)
    carried = summary.select(
        *keys,
        BLOCK,
        *[F.last(name, True).over(before).alias(name) for name in last],
        *[F.last(name, True).over(after).alias(name) for name in first],
    )
    return df.join(carried, [*keys, BLOCK], "left")


def block_windows(keys: list[str], order: str):
    """Windows of a block: up to the row, back from the block's end to the row, and the plain order.

    The second one falls, so the first value at or after a row is its ``last``; both are running
    frames, linear in the block's rows.
    """
    base = Window.partitionBy(*keys, BLOCK).orderBy(order)
    back = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(order))
    return (
        base.rowsBetween(Window.unboundedPreceding, 0),
        back.rowsBetween(Window.unboundedPreceding, 0),
        base,
    )


def with_previous(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, str],
    ts: str = "ts",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds, per ``{name: column}``, that column's value in the preceding row of the key.

    The first row of a block takes the last row of the block before, null or not.
    """
    blocked = with_row_block(df.withColumn("_at", micros(ts)), keys, "_at", block_rows)
    ends = blocked.groupBy(*keys, BLOCK).agg(
        *[F.max_by(c, ts).alias(f"_end_{n}") for n, c in columns.items()]
    )
    sequence = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = ends.select(
        *keys, BLOCK, *[F.lag(f"_end_{n}").over(sequence).alias(f"_in_{n}") for n in columns]
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ts)
    first = F.row_number().over(inside) == 1
    return blocked.join(carried, [*keys, BLOCK], "left").select(
        *df.columns,
        *[
            F.when(first, F.col(f"_in_{n}")).otherwise(F.lag(c).over(inside)).alias(n)
            for n, c in columns.items()
        ],
    )
