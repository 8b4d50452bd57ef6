"""Multivariate anomaly scores: how badly each frame row is rebuilt by a linear model."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from sensorlake.operators.blocks import BLOCK_ROWS, rows_frame
from sensorlake.operators.quantile import exact_quantile

KEYS = ["node", "metric"]
WINDOW_ROWS = 20


def channel_scaler(frame: DataFrame) -> DataFrame:
    spread = F.stddev_pop("value")
    return frame.groupBy(*KEYS).agg(
        F.avg("value").alias("mu"), F.when(spread > 0, spread).otherwise(1.0).alias("sigma")
    )


def standardised(frame: DataFrame, scaler: DataFrame) -> DataFrame:
    return frame.join(scaler, KEYS).withColumn("z", (F.col("value") - F.col("mu")) / F.col("sigma"))


def channel_places(scaler: DataFrame) -> DataFrame:
    """``node, metric, place`` of the channels that the data have, whatever these are, from 0."""
    order = Window.orderBy(*KEYS)  # one row per sensor
    return scaler.select(*KEYS).withColumn("place", F.row_number().over(order) - 1)


def standardised_rows(frame: DataFrame, scaler: DataFrame) -> DataFrame:
    """One array per timestamp in order of ``channel_places``; a missing channel sits at its mean, zero."""
    places = channel_places(scaler)
    n = places.count()
    cells = standardised(frame, scaler).join(places, KEYS).filter("z IS NOT NULL")
    packed = cells.groupBy("ts", "pos").agg(F.map_from_entries(F.collect_list(F.struct("place", "z"))).alias("_z"))
    line = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    filled = F.transform(line, lambda i: F.coalesce(F.try_element_at("_z", i), F.lit(0.0)))
    return packed.select("ts", "pos", filled.alias("z"))


def fit_reconstruction(frame: DataFrame, scaler: DataFrame, components: int = 3) -> DataFrame:
    """``node, metric, loadings``: what each channel has in the leading principal components. A table,
    one row per channel, that can be stored and used again."""
    rows = standardised_rows(frame, scaler).select(array_to_vector("z").alias("v"))
    places = channel_places(scaler).orderBy("place").collect()
    if not places:
        raise ValueError("no channel to fit")
    pc = PCA(k=min(components, len(places)), inputCol="v", outputCol="p").fit(rows).pc.toArray()
    found = [(r["node"], r["metric"], [float(x) for x in line]) for r, line in zip(places, pc)]
    return frame.sparkSession.createDataFrame(found, "node string, metric string, loadings array<double>")


def reconstruction_errors(frame: DataFrame, scaler: DataFrame, loadings: DataFrame) -> DataFrame:
    """Squared error per timestamp and channel of rebuilding a row from its components.

    Long form throughout: a timestamp's components are sums over its channels. Channels without
    loadings add nothing to them and are rebuilt as zero.
    """
    cells = standardised(frame, scaler).join(loadings, KEYS, "left").select(
        "ts", "pos", *KEYS, F.coalesce("z", F.lit(0.0)).alias("z"), "loadings"
    )
    parts = cells.select("ts", F.posexplode("loadings").alias("k", "w"), "z")
    sums = parts.groupBy("ts", "k").agg(F.sum(F.col("w") * F.col("z")).alias("part"))
    components = sums.groupBy("ts").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]).alias("parts")
    )
    products = F.zip_with("loadings", "parts", lambda a, b: a * b)
    rebuilt = F.coalesce(F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))
    error = F.col("z") - rebuilt
    return cells.join(components, "ts", "left").select("ts", "pos", *KEYS, (error * error).alias("err"))


def mean_errors(frame: DataFrame, scaler: DataFrame) -> DataFrame:
    """Squared distance from the channel mean: the reconstruction with no component."""
    return standardised(frame, scaler).select(
        "ts", "pos", *KEYS, (F.col("z") * F.col("z")).alias("err")
    )


def window_errors(
    errors: DataFrame, window_rows: int = WINDOW_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean error of each channel over the trailing window; only full windows stay."""
    return rows_frame(
        errors,
        KEYS,
        {"window_err": lambda w: F.avg("err").over(w.rowsBetween(1 - window_rows, 0))},
        before=window_rows - 1,
        after=0,
        block_rows=block_rows,
    ).filter(F.col("pos") >= window_rows - 1)


def score(windowed: DataFrame, factor: float = 2.0, threshold: float | None = None) -> DataFrame:
    """Mean error over the channels per timestamp, against ``factor`` times its median."""
    scored = windowed.groupBy("ts").agg(F.avg("window_err").alias("score"))
    if threshold is None:
        limit = exact_quantile(scored, [], "score", 0.5, 0.001).select(
            (F.col("quantile") * factor).alias("t")
        )
        bound = limit.scalar()
    else:
        bound = F.lit(threshold)
    return scored.withColumn("threshold", bound).withColumn(
        "is_anomaly", F.col("score") > F.col("threshold")
    )


def top_contributors(windowed: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` channels with the greatest error per timestamp (at most one row per channel)."""
    order = Window.partitionBy("ts").orderBy(F.desc("window_err"), "node", "metric")
    return (
        windowed.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("ts", "rank", *KEYS, "window_err")
    )
