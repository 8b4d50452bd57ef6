"""As-of joins in one ordered pass instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sensorlake.functions.times import micros
from sensorlake.operators.blocks import BLOCK_ROWS, block_windows, carry, with_row_block
from sensorlake.session import materialise


def _merged(left: DataFrame, right: DataFrame, keys: list[str], ts: str, block_rows: int):
    """Both sides in one ordered set, the right side's times in ``_seen``.

    At equal times a right row sorts first, so it counts as at-or-before the left row.
    """
    at = micros(ts)
    left_rows = left.select(*keys, at.alias("_at"), F.lit(None).cast("bigint").alias("_seen"))
    right_rows = right.select(*keys, at.alias("_at"), at.alias("_seen"))
    # Read three times below: for the counts, the carried times and the pass itself.
    both = materialise(left_rows.distinct().unionByName(right_rows.distinct()))
    return with_row_block(both, keys, "_at", block_rows).withColumn(
        "_order", F.col("_at") * 2 + F.col("_seen").isNull().cast("int")
    )


def match_times(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | None = None,
    ts: str = "ts",
    direction: str = "backward",
    tolerance_us: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Maps every distinct ``(keys, ts)`` of ``left`` to a time of ``right``.

    ``backward`` takes the last time at or before, ``nearest`` the closer of both sides and the
    later one on ties; the tolerance is inclusive. Output: keys, ``at_us``, ``match_us``.
    Linear in the rows of both sides; a block only needs one carried time from each side.
    """
    keys = keys or []
    merged = _merged(left, right, keys, ts, block_rows)
    both = direction != "backward"
    merged = carry(
        merged, keys, "_order",
        last={"_before_in": "_seen"},
        first={"_after_in": "_seen"} if both else None,
    )
    upto, back_to, _ = block_windows(keys, "_order")
    before = F.coalesce(F.last("_seen", True).over(upto), F.col("_before_in"))
    if not both:
        matched = merged.withColumn("match_us", before)
    else:
        after = F.coalesce(F.last("_seen", True).over(back_to), F.col("_after_in"))
        near = merged.withColumn("_b", before).withColumn("_a", after)
        back, ahead = F.col("_at") - F.col("_b"), F.col("_a") - F.col("_at")
        # An exact hit is "before"; otherwise the later reading wins a tie.
        pick = (
            F.when(back == 0, F.col("_b"))
            .when(F.col("_b").isNull() | (ahead <= back), F.col("_a"))
            .otherwise(F.col("_b"))
        )
        matched = near.withColumn("match_us", pick)
    out = matched.filter(F.col("_seen").isNull()).select(
        *keys, F.col("_at").alias("at_us"), "match_us"
    )
    if tolerance_us is not None:
        within = F.abs(F.col("match_us") - F.col("at_us")) <= tolerance_us
        out = out.withColumn("match_us", F.when(within, F.col("match_us")))
    return out.filter(F.col("match_us").isNotNull())
