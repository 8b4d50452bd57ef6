import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sensorlake.session import build_session, discard_work  # noqa: E402

START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    discard_work(session)


def at(minutes: float = 0, seconds: float = 0) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes, seconds=seconds)


def make_readings(spark, rows):
    """Rows of (time, node, metric, value)."""
    return spark.createDataFrame(
        rows, "ts timestamp_ntz, node string, metric string, value double"
    )


def make_frame(spark, series):
    """A frame of channels ``{(node, metric): [values]}`` at 3-minute steps."""
    rows = [
        (at(3 * i), i, node, metric, v)
        for (node, metric), values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "ts timestamp_ntz, pos bigint, node string, metric string, value double"
    )


def channel(df, column, node="M1", metric="Temp", order="pos"):
    rows = df.filter(f"node = '{node}' AND metric = '{metric}'").orderBy(order).collect()
    return [r[column] for r in rows]
