import random

import numpy as np
import pandas as pd
import pytest
from conftest import at, channel, make_frame, make_readings

from sensorlake.operators import clean
from sensorlake.schema import CHANNELS

T = ("M1", "Temp")


def noisy(n, seed=3, gaps=0.2):
    rng = random.Random(seed)
    return [None if rng.random() < gaps else rng.gauss(25, 3) for _ in range(n)]


def as_series(values):
    return pd.Series([np.nan if v is None else v for v in values], dtype=float)


def same(got, want, tol=1e-9):
    got = as_series(got)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def messy():
    values = noisy(40) + [21.0 + 1e-4 * (i % 2) for i in range(30)] + noisy(30, 5)
    values[55] = None
    return values


@pytest.mark.parametrize("block_rows", [50_000, 23, 7])
def test_flatline_equals_rolling_variance(spark, messy, block_rows):
    out = clean.flatlines(make_frame(spark, {T: messy}), block_rows=block_rows)
    s = as_series(messy)
    var = s.rolling(20, min_periods=10).var(ddof=0)
    flat = (var < 1e-4) & s.notna()
    assert channel(out, "is_flat") == flat.tolist()
    assert flat.sum() > 5
    same(channel(out, "roll_var"), var, 1e-8)


@pytest.mark.parametrize("block_rows", [50_000, 9])
def test_interpolation_extends_both_ends(spark, block_rows):
    values = [None, None, 1.0, None, None, None, 5.0, 4.0, None, 2.0, None, None]
    out = clean.interpolate(make_frame(spark, {T: values}), block_rows=block_rows)
    same(channel(out, "filled"), as_series(values).interpolate("linear", limit_direction="both"))


@pytest.mark.parametrize("block_rows", [50_000, 11, 3])
def test_interpolation_on_random_gaps(spark, block_rows):
    values = noisy(120, 11, 0.6)
    out = clean.interpolate(make_frame(spark, {T: values}), block_rows=block_rows)
    same(channel(out, "filled"), as_series(values).interpolate("linear", limit_direction="both"))


@pytest.mark.parametrize("block_rows", [50_000, 4])
def test_limited_interpolation(spark, block_rows):
    values = [None, 1.0] + [None] * 6 + [8.0] + [None] * 7 + [2.0] + [None] * 9
    out = clean.interpolate_limited(make_frame(spark, {T: values}), block_rows=block_rows)
    s = as_series(values)
    s.index = pd.date_range("2024-01-01", periods=len(s), freq="30min")
    same(channel(out, "filled"), s.interpolate("time", limit=6))


def test_forward_then_backward_fill(spark):
    values = [None, 3.0, None, None, 1.0, None]
    out = clean.fill_forward_backward(make_frame(spark, {T: values}), block_rows=2)
    assert channel(out, "filled") == [3.0, 3.0, 3.0, 3.0, 1.0, 1.0]


def test_outliers_use_population_spread_and_skip_constant_channels(spark):
    spike = [1.0, 2.0] * 15 + [40.0]
    out = clean.outliers(make_frame(spark, {T: spike, ("M4", "Temp"): [7.0] * 31}))
    z = (as_series(spike) - np.mean(spike)) / np.std(spike)
    assert channel(out, "is_outlier") == (z.abs() > 3).tolist()
    assert channel(out, "zscore", node="M4") == [None] * 31


def test_gate_order_report_and_dead_channels(spark, messy):
    values = list(messy)
    values[10] = 500.0
    frame = make_frame(spark, {T: values, ("M4", "CO2"): [None] * len(values)})
    report = {(r.node, r.metric): r for r in clean.quality_report(frame).collect()}
    dead, live = report[("M4", "CO2")], report[T]
    assert dead.dropped and dead.n_in == 0
    assert live.n_outlier == 1 and live.n_flat > 0 and not live.dropped

    s = as_series(values)
    var = s.rolling(20, min_periods=10).var(ddof=0)
    s[(var < 1e-4) & s.notna()] = np.nan
    s[((s - s.mean()) / s.std(ddof=0)).abs() > 3] = np.nan
    cleaned = clean.clean(frame)
    same(channel(cleaned, "value"), s.interpolate("linear", limit_direction="both"))
    assert cleaned.filter("node = 'M4'").count() == 0
    assert clean.drop_dead_channels(frame).select("node").distinct().count() == 1


def test_gate_errors(spark):
    few = clean.quality_report(make_frame(spark, {T: [1.0, 2.0] * 5}))
    with pytest.raises(clean.DataQualityError, match="Too few"):
        clean.require_quality(few)
    empty = clean.quality_report(make_frame(spark, {T: [None] * 50}))
    with pytest.raises(clean.DataQualityError, match="No channel"):
        clean.require_quality(empty)
    clean.require_quality(clean.quality_report(make_frame(spark, {T: noisy(60)})))


def test_densify_gives_every_channel_a_row_per_time(spark):
    rows = [(at(0), "M1", "Temp", 1.0), (at(7), "M4", "CO2", 2.0), (at(60 * 30), "M1", "Temp", 3.0)]
    out = clean.densify(make_readings(spark, rows), [("M1", "Temp"), ("M4", "CO2")])
    assert channel(out, "value") == [1.0, None, 3.0]
    assert channel(out, "pos") == [0, 1, 2]
    assert channel(out, "value", "M4", "CO2") == [None, 2.0, None]


def test_densify_keeps_channels_beyond_the_fleet(spark):
    rows = [(at(0), "M1", "Temp", 1.0), (at(0), "Roof", "Noise", 4.0), (at(3), "Roof", "Noise", 5.0),
            (at(0), "Roof_x", "y", 6.0), (at(0), "Roof", "x_y", 7.0), (at(3), None, "Temp", 8.0), (at(3), None, "Temp", 9.0)]
    out = clean.densify(make_readings(spark, rows))
    assert channel(out, "value", "Roof", "Noise") == [4.0, 5.0]
    assert channel(out, "value", "Roof_x", "y") == [6.0, None]
    assert channel(out, "value", "Roof", "x_y") == [7.0, None]
    assert channel(out, "value") == [1.0, None]
    assert out.count() == 2 * (len(CHANNELS) + 3)
    assert clean.densify(make_readings(spark, [])).count() == 0


def test_last_source_row_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k int, o int, v string")
    got = {r.k: r.v for r in clean.latest_per_timestamp(df, ["k"], "o").collect()}
    assert got == {1: "c", 2: "x"}


def test_the_gate_stops_or_cleans(spark):
    for values in ([1.0, 2.0] * 5, [None] * 50, []):
        frame = make_frame(spark, {T: values})
        with pytest.raises(clean.DataQualityError):
            clean.gated_clean(frame)
    frame = make_frame(spark, {T: [*noisy(60), None], ("M4", "CO2"): [None] * 61})
    got = clean.gated_clean(frame)
    assert sorted(got.collect()) == sorted(clean.clean(frame).collect())
    assert got.select("node").distinct().count() == 1


def test_step_follows_the_readings(spark):
    rows = [(at(i), "M1", "Temp", 1.0) for i in range(61)] + [(at(i), "M4", "Temp", 1.0) for i in range(0, 61, 2)]
    # 92 readings of two channels in an hour.
    assert clean.reading_gap_us(make_readings(spark, rows)) == 3600 * 2 // 92 * 1_000_000
    assert clean.reading_gap_us(make_readings(spark, rows[:1])) == 1_000_000
    assert clean.reading_gap_us(make_readings(spark, [])) == 1_000_000


def test_row_gate_for_each_export(spark):
    rows = make_readings(spark, [(at(i), "M1", "Temp", 1.0) for i in range(3)] + [(at(0), "M4", "Temp", None)] * 2)
    got = {(r.node, r.n_rows, r.enough_rows) for r in clean.row_gate(rows, 3, ["node"]).collect()}
    assert got == {("M1", 3, True), ("M4", 1, False)}
    assert clean.row_gate(rows, 3).first()["n_rows"] == 3


def test_frame_of_a_wide_fleet(spark):
    wide = spark.range(1000).selectExpr(
        "timestamp_ntz '2024-03-01' + make_interval(0, 0, 0, 0, 0, cast(id % 3 AS int)) AS ts",
        "concat('N', id) AS node", "'Temp' AS metric", "cast(id AS double) AS value",
    )
    frame = clean.densify(wide)
    row = frame.agg({"*": "count", "value": "sum", "pos": "max"}).first()
    assert row["count(1)"] == 3 * (1000 + len(CHANNELS)) and row["sum(value)"] == 1000 * 999 / 2 and row["max(pos)"] == 2
    nameless = make_readings(spark, [(at(0), None, "Temp", 1.0), (at(3), "M1", None, 2.0)])
    assert clean.densify(nameless).filter("value IS NULL").count() == 2 * len(CHANNELS)
