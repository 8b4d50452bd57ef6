"""Append tables with date partitions, retention, keyed merges, dimension files.

Tables that are merged by key over time are ``ledger.Ledger``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorlake.functions.text import short_hash
from sensorlake.operators.clean import latest_per_timestamp

HEARTBEAT_DAYS, ARTIFACT_DAYS = 3, 7

OUTDOOR_TYPE = (
    "campus_latlon struct<lat: double, lon: double>,"
    " nodes map<string, struct<type: string, sanity_thresholds: map<string, double>>>"
)


def load_outdoor(spark: SparkSession, path: str) -> DataFrame:
    """``(node, node_type, metric, max_dev)`` of a nested outdoor configuration file."""
    doc = spark.read.schema(OUTDOOR_TYPE).option("multiLine", True).json(path)
    return (
        doc.select(F.explode("nodes").alias("node", "cfg"))
        .select(
            "node",
            F.coalesce("cfg.type", F.lit("outdoor")).alias("node_type"),
            F.explode("cfg.sanity_thresholds").alias("metric", "max_dev"),
        )
    )


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """``(node, px, py)`` of a node-to-pixel map file."""
    doc = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string, array<double>>")
    return doc.select(F.explode(pairs).alias("node", "xy")).select(
        "node", F.col("xy")[0].alias("px"), F.col("xy")[1].alias("py")
    )


def anonymise(log: DataFrame, column: str = "username") -> DataFrame:
    """Replaces a user name by the first 16 hex digits of its SHA-256."""
    return log.withColumn(f"{column}_hash", short_hash(F.col(column))).drop(column)


def append_rows(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends by day. Rows are dealt to days by size, so that an append makes few files, not one for
    every task and day, and a large day is more than one task's work."""
    dated = rows.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
    dated.write.mode("append").partitionBy("day").parquet(path)


def retained(rows: DataFrame, days: int, as_of=None, ts: str = "ts") -> DataFrame:
    """Rows not older than ``days`` before ``as_of`` (the newest row by default)."""
    end = rows.agg(F.max(ts)).scalar() if as_of is None else as_of
    return rows.filter(F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS"))


def prune_days(spark: SparkSession, path: str, days: int, as_of: str) -> None:
    """Drops whole day partitions beyond the retention; no file of a kept day is rewritten."""
    table = spark.read.parquet(path)
    old = (
        table.select("day")
        .distinct()
        .filter(F.col("day") < F.date_sub(F.to_date(F.lit(as_of)), days))
    )
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in old.toLocalIterator():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(hadoop, f"day={row['day']}"), True)


def merge_rows(existing: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the new rows, one per key, and the existing rows whose key is not among them."""
    fresh = latest_per_timestamp(new, keys, order)
    if existing is None:
        return fresh
    return existing.join(fresh, keys, "left_anti").unionByName(fresh)
