"""The registry, and a cross-section of the queries against their SQL on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
import __spark_entry__ as entry
from sensorlake.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "a06_channel_selection",
    "a09_telemetry_parse",
    "a12_hourly_forecast",
    "b08_legacy_history",
    "b13_question_windows",
    "c01_reconcile_forecasts",
    "c04_sensor_weather_drift",
    "clean_gate",
    "d06_half_hour_means",
    "d10_situation_summary",
    "e04_limited_interpolation",
    "e07_rolling_errors_per_channel",
    "e10_breach_state",
    "h02_notifications",
    "h02_stream_notifications",
    "h06_stream_half_hour_means",
]
# Operators that SQL cannot state: fitted models, and a text score.
ROWS_ONLY = {
    "c09_repeated_questions",
    "j01_fit_autoregression",
    "j02_predict_next_step",
    "j03_history_with_uncertainty",
    "j04_reconstruction_anomaly",
    "j05_forecast_snapshot",
    "j07_stored_prediction",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_texts_are_valid(duck):
    for sql in ORACLES.values():
        duck.execute("EXPLAIN " + sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
