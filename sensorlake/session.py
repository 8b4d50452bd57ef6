"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def build_session(master: str | None = None, app_name: str = "sensorlake", **conf) -> SparkSession:
    """Session with adaptive execution on and the zone fixed to UTC.

    Sensor times are zone-less local labels (``timestamp_ntz``); microsecond arithmetic on
    them is exact only while the session zone has no daylight saving, hence UTC.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a local temporary folder serves sessions of one machine;
    on a cluster that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = tempfile.mkdtemp(prefix="sensorlake-")
    path = f"{base.rstrip('/')}/sensorlake-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard_work(spark: SparkSession) -> None:
    """Deletes the working folders of this process; results that still read them become unusable."""
    for path in _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _made.clear()


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared working folder and reads it back.

    For results that several later steps use: they are computed once, survive lost executors,
    and give the following joins a true size to plan with.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
