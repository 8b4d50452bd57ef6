"""Exact medians and percentiles without one task holding a whole group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float = 0.5, width: float = 1_000_000.0
) -> DataFrame:
    """Interpolated quantile ``q`` of ``value`` per key, as ``quantile``.

    Values collapse to counts first. Counts per bin of ``width`` locate the bins that hold the two
    middle ranks, and only the values of those bins are ordered. Choose ``width`` so that a bin
    has few distinct values; it changes the work, never the result.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col("_v") / width))
    )
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    in_order = Window.partitionBy(*keys).orderBy("_bin")
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = (
        bins.withColumn("_total", total)
        .withColumn("_below", F.sum("_n").over(in_order) - F.col("_n"))
        .withColumn("_rank", (F.col("_total") - 1) * F.lit(float(q)))
        .withColumn("_lo", F.floor("_rank"))
        .withColumn("_hi", F.ceil("_rank"))
    )

    def holds(rank, below, n):
        return (F.col(rank) >= below) & (F.col(rank) < below + n)

    wanted = ranked.filter(
        holds("_lo", F.col("_below"), F.col("_n")) | holds("_hi", F.col("_below"), F.col("_n"))
    ).drop("_n", "_total")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    values = (
        counts.join(wanted, [*keys, "_bin"])
        .withColumn("_from", F.col("_below") + F.sum("_n").over(inside) - F.col("_n"))
    )
    return (
        values.groupBy(*keys)
        .agg(
            F.max(F.when(holds("_lo", F.col("_from"), F.col("_n")), F.col("_v"))).alias("_vlo"),
            F.max(F.when(holds("_hi", F.col("_from"), F.col("_n")), F.col("_v"))).alias("_vhi"),
            F.max(F.col("_rank") - F.col("_lo")).alias("_part"),
        )
        .select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_part")).alias("quantile"))
    )
