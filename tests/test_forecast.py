import random

import numpy as np
import pandas as pd
import pytest
from conftest import at, channel, make_frame

from sensorlake.operators import anomaly, evaluate, forecast

T = ("M1", "Temp")


def autoregressive(n, seed=1, phi=-0.7):
    """Levels whose differences depend on the difference before."""
    rng = random.Random(seed)
    level, delta, out = 25.0, 0.0, []
    for _ in range(n):
        delta = phi * delta + rng.gauss(0, 0.3)
        level += delta
        out.append(level)
    return out


@pytest.fixture(scope="module")
def trained(spark):
    frame = make_frame(spark, {T: autoregressive(400), ("M4", "CO2"): autoregressive(400, 2, 0.5)}).cache()
    deltas = forecast.differences(frame)
    scaler = forecast.delta_scaler(deltas).cache()
    scaled = forecast.standardise(deltas, scaler)
    windows = forecast.lag_windows(scaled).cache()
    return frame, scaler, scaled, windows, forecast.fit(windows).cache()


def test_scaler_and_windows_equal_numpy(spark, trained):
    frame, scaler, _, windows, _ = trained
    deltas = np.diff(channel(frame, "value"))
    row = scaler.filter("node = 'M1'").first()
    assert (row.mu, row.sigma) == pytest.approx((deltas.mean(), deltas.std()))
    z = (deltas - deltas.mean()) / deltas.std()
    rows = windows.filter("node = 'M1'").orderBy("pos").collect()
    assert rows[0].pos == forecast.LAGS + 1 and len(rows) == len(z) - forecast.LAGS
    np.testing.assert_allclose(rows[5].x, z[5 : 5 + forecast.LAGS])
    assert rows[5].y == pytest.approx(z[5 + forecast.LAGS])


def test_constant_channel_scales_by_one(spark):
    frame = make_frame(spark, {T: [5.0] * 30})
    assert forecast.delta_scaler(forecast.differences(frame)).first().sigma == 1.0


def test_coefficients_equal_least_squares(spark, trained):
    *_, windows, model = trained
    rows = windows.filter("node = 'M1'").collect()
    x = np.array([[1.0, *r.x] for r in rows])
    y = np.array([r.y for r in rows])
    beta = model.filter("node = 'M1'").first().beta
    np.testing.assert_allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_next_step_and_snapshot(spark, trained):
    frame, scaler, scaled, _, model = trained
    out = forecast.predict_next(forecast.latest_window(scaled), model)
    row = out.filter("node = 'M1'").first()
    levels = np.array(channel(frame, "value"))
    s, beta = scaler.filter("node = 'M1'").first(), model.filter("node = 'M1'").first().beta
    z = (np.diff(levels)[-forecast.LAGS :] - s.mu) / s.sigma
    want = levels[-1] + (beta[0] + np.dot(beta[1:], z)) * s.sigma + s.mu
    assert row.predicted == pytest.approx(want) and row.current == levels[-1]
    snap = forecast.snapshot(out, frame).filter("node = 'M1'").first()
    assert (snap.issue_ts, snap.target_ts) == (at(3 * 399), at(3 * 400))
    payload = forecast.module_payloads(forecast.snapshot(out, frame)).collect()
    assert [p.node for p in payload] == ["M1", "M4"]
    assert payload[0].current == {"Temp": levels[-1]} and payload[0].features[0].name == "Temp"


def test_model_beats_persistence_on_autoregressive_data(spark, trained):
    frame, scaler, _, windows, _ = trained
    models = forecast.bagged_fit(windows, 3)
    history = forecast.predict_history(frame, models, scaler)
    assert history.groupBy("member").count().count() == 3
    assert history.agg({"pos": "min"}).first()[0] == forecast.LAGS + 1
    ensemble = forecast.ensemble(history)
    truth = frame.select("ts", "node", "metric", "value")
    joined = evaluate.align(
        truth, ensemble.withColumnRenamed("mean", "value"), ensemble.withColumnRenamed("std", "value")
    )
    model_error = joined.selectExpr("avg(residual * residual) e").first().e
    naive = forecast.naive(frame).selectExpr("avg((value - pred) * (value - pred)) e").first().e
    assert model_error < 0.8 * naive


def test_single_member_has_no_spread(spark):
    frame = make_frame(spark, {T: [1.0, 2.0, 4.0]})
    out = forecast.ensemble(forecast.persistence_members(frame, 1))
    assert [r["std"] for r in out.collect()] == [0.0, 0.0]


def test_retrain_decision(spark):
    a = make_frame(spark, {T: [1.0], ("M4", "CO2"): [1.0]})
    b = make_frame(spark, {T: [1.0], ("M6", "CO2"): [1.0]})
    drift = {(r.node, r.side) for r in forecast.channel_drift(a, b).collect()}
    assert drift == {("M4", "missing in data"), ("M6", "missing in model")}
    assert forecast.must_retrain(a, b) and forecast.must_retrain(None, b)
    assert forecast.must_retrain(a, a, force=True) and not forecast.must_retrain(a, a)
    with pytest.raises(forecast.ForecastError):
        forecast.require_rows(a)


def evaluated(spark, residuals):
    rows = [
        (at(3 * i), node, "Temp", r, 0.0, 1.0, r)
        for node, values in residuals.items()
        for i, r in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "ts timestamp_ntz, node string, metric string, truth double, mean double, std double, residual double"
    )


@pytest.mark.parametrize("block_rows", [5, 50_000])
def test_rolling_errors(spark, block_rows):
    data = {"M1": [1.0, -2.0, 3.0, 0.5, -1.0, 2.0], "M4": [0.0, 1.0, -1.0, 2.0, 2.0, -3.0]}
    ev = evaluated(spark, data)
    frame = pd.DataFrame(data)
    mae = frame.abs().mean(axis=1).rolling(3, min_periods=1).mean()
    rmse = np.sqrt((frame**2).mean(axis=1).rolling(3, min_periods=1).mean())
    rows = evaluate.rolling_errors(ev, 3, block_rows).orderBy("ts").collect()
    np.testing.assert_allclose([r.rolling_mae for r in rows], mae)
    np.testing.assert_allclose([r.rolling_rmse for r in rows], rmse)
    per = evaluate.rolling_errors_per_channel(ev, 3, block_rows)
    np.testing.assert_allclose(
        channel(per, "rolling_mae", "M4", order="ts"), frame["M4"].abs().rolling(3, min_periods=1).mean()
    )


def test_intervals_and_histogram(spark):
    ev = evaluated(spark, {"M1": [0.0, 1.0, 1.96, 1.97, 4.0], "M4": [2.0, 2.0]})
    assert {r.node: r.coverage for r in evaluate.coverage(ev).collect()} == {"M1": 0.6, "M4": 0.0}
    bins = {(r.node, r.bin): r.n for r in evaluate.residual_histogram(ev).collect()}
    assert bins[("M1", 1)] == 1 and bins[("M1", 40)] == 1 and bins[("M4", 1)] == 2
    assert sum(n for (node, _), n in bins.items() if node == "M1") == 5


def test_reconstruction_finds_the_broken_channel(spark):
    rng = random.Random(9)
    base = [rng.gauss(0, 1) for _ in range(120)]
    # Channels beyond the fleet's list count like any other.
    names = [("M1", "Temp"), ("M4", "Temp"), ("M6", "Temp"), ("Z9", "Dust")]
    series = {n: [b * k + rng.gauss(0, 0.05) for b in base] for n, k in zip(names, (1, 2, -1, 3))}
    series[names[2]][80:] = [9.0 + rng.gauss(0, 0.05) for _ in range(40)]
    frame = make_frame(spark, series)
    scaler = anomaly.channel_scaler(frame)
    loadings = anomaly.fit_reconstruction(frame, scaler, 1)
    z = np.array([r.z for r in anomaly.standardised_rows(frame, scaler).orderBy("pos").collect()])
    w = np.array([r.loadings for r in loadings.orderBy("node").collect()])
    _, _, axes = np.linalg.svd(z - z.mean(axis=0))
    assert abs(abs(axes[0] @ w[:, 0]) - 1) < 1e-9
    p = w @ w.T
    errors = anomaly.reconstruction_errors(frame, scaler, loadings).cache()
    got = np.array([r.err for r in errors.orderBy("pos", "node").collect()]).reshape(120, 4)
    np.testing.assert_allclose(got, (z - z @ p) ** 2, atol=1e-9)
    windowed = anomaly.window_errors(errors)
    scores = anomaly.score(windowed).orderBy("ts").collect()
    assert len(scores) == 101
    assert scores[0].threshold == pytest.approx(2 * np.median([r.score for r in scores]))
    top = anomaly.top_contributors(windowed).filter("rank = 1").orderBy("ts").collect()
    assert top[-1].node == "M6"
