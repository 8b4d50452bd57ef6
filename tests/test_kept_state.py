"""State that is kept between runs: reconciled logs, model sums, amended means."""

import random

import numpy as np
import pytest
from conftest import at, make_frame, make_readings
from pyspark.sql import functions as F

from sensorlake.functions.times import MINUTE_US
from sensorlake.operators import evaluate, forecast, kept_model, reconcile
from sensorlake.streaming import windows

LOG = "issue_ts timestamp_ntz, target_ts timestamp_ntz, node string, metric string, pred double"


def test_runs_end_where_one_run_would(spark, tmp_path):
    rng = random.Random(3)
    channels = [("M1", "Temp"), ("M1", "CO2")]
    times = sorted(rng.sample(range(0, 3000), 160))
    readings = [(at(t), *c, float(t)) for t in times for c in channels if rng.random() < 0.8]
    log = [(at(i), at(i + 30 + rng.randint(0, 20)), *c, 1.0) for i in range(0, 2900, 37) for c in channels]
    log += [(None, at(5), "M1", "Temp", 1.0), (at(5), None, "M1", "Temp", 1.0)]
    tolerance = 12 * MINUTE_US
    state = reconcile.reconciled_log(spark, str(tmp_path / "log"))
    for low in range(0, 3000, 500):
        now = [r for r in readings if at(low) <= r[0] < at(low + 500)]
        new = [r for r in log if r[0] is None or at(low) <= r[0] < at(low + 500)]
        # Earlier readings are gone; the same forecasts come twice.
        for _ in range(2):
            reconcile.reconcile_run(state, spark.createDataFrame(new, LOG), make_readings(spark, now), tolerance)
    columns = ["issue_ts", "target_ts", "node", "metric", "gt_ts", "gt", "matched", "ground_truth_matched"]
    got = reconcile.reconciled(state).select(columns).collect()
    whole = evaluate.reconcile(spark.createDataFrame(log[:-2], LOG), make_readings(spark, readings), tolerance)
    assert sorted(map(str, got)) == sorted(map(str, whole.select(columns).collect()))
    assert {r.ground_truth_matched for r in got} == {True, False} and {r.matched for r in got} == {True, False}


def test_settled_forecasts_are_not_written_again(spark, tmp_path):
    state = reconcile.reconciled_log(spark, str(tmp_path / "log"))
    log = spark.createDataFrame([(at(0), at(10), "M1", "Temp", 1.0), (at(0), at(100), "M1", "Temp", 1.0)], LOG)
    reconcile.reconcile_run(state, log, make_readings(spark, [(at(11), "M1", "Temp", 5.0), (at(40), "M1", "Temp", 6.0)]), 5 * MINUTE_US)
    assert {(r.target_ts, r.settled) for r in state.read().collect()} == {(at(10), True), (at(100), False)}
    before = state.snapshot()["deltas"]
    # A nearer reading for a settled forecast comes too late to count.
    reconcile.reconcile_run(state, log, make_readings(spark, [(at(10), "M1", "Temp", 9.0), (at(98), "M1", "Temp", 7.0), (at(200), "M1", "Temp", 7.0)]), 5 * MINUTE_US)
    rows = {r.target_ts: (r.gt, r.settled) for r in state.read().collect()}
    assert rows == {at(10): (5.0, True), at(100): (7.0, True)}
    delta = state.snapshot()["deltas"][-1]["name"]
    assert len(before) == 1 and spark.read.parquet(f"{state.path}/data/delta={delta}").count() == 1
    reconcile.reconcile_run(state, log.limit(0), make_readings(spark, []), 5 * MINUTE_US)
    assert state.read().count() == 2


def frame_of(spark, n, channels=2, seed=1):
    rng = np.random.default_rng(seed)
    names = [("M1", "Temp"), ("M4", "CO2"), ("M6", "Humid")][:channels]
    return make_frame(spark, {c: (20 + rng.standard_normal(n).cumsum()).tolist() for c in names})


@pytest.fixture(scope="module")
def full(spark):
    return frame_of(spark, 1500).cache()


def test_extended_model_equals_a_full_fit(spark, tmp_path, full):
    store = kept_model.model_store(spark, str(tmp_path / "m"))
    assert kept_model.refresh(store, full.filter("pos < 500")) == "fitted"
    first = store.snapshot()["version"]
    early = {tuple(r[:2]): r.beta for r in kept_model.kept_model(store).select("node", "metric", "beta").collect()}
    for upto in (900, 1500, 1500):
        assert kept_model.refresh(store, full.filter(F.col("pos") < upto)) == "extended"
    deltas = forecast.differences(full)
    scaler = forecast.delta_scaler(deltas)
    want = {r.node: r for r in scaler.join(forecast.fit(forecast.lag_windows(forecast.standardise(deltas, scaler))), ["node", "metric"]).collect()}
    got = {r.node: r for r in kept_model.kept_model(store).collect()}
    assert set(got) == set(want) == {"M1", "M4"}
    for node, r in got.items():
        assert r.n_windows == 1500 - forecast.LAGS - 1
        assert np.allclose([r.mu, r.sigma, *r.beta], [want[node].mu, want[node].sigma, *want[node].beta], atol=1e-8)
    # Earlier versions stay readable, and a model of the newest days differs.
    old = {tuple(r[:2]): r.beta for r in kept_model.kept_model(store, version=first).select("node", "metric", "beta").collect()}
    assert old == early
    assert kept_model.kept_model(store, days=1).first().n_windows < 600


def test_stored_prediction_equals_a_fitted_one(spark, tmp_path, full):
    store = kept_model.model_store(spark, str(tmp_path / "m"))
    kept_model.refresh(store, full)
    deltas = forecast.differences(full)
    scaled = forecast.standardise(deltas, forecast.delta_scaler(deltas))
    want = forecast.predict_next(forecast.latest_window(scaled), forecast.fit(forecast.lag_windows(scaled)))
    got = kept_model.predict_kept(full, kept_model.kept_model(store))
    a, b = ({r.node: (r.ts, r.current, r.predicted) for r in x.collect()} for x in (want, got))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1:], b[k][1:], atol=1e-8) for k in a)


def test_refit_only_on_drift_or_force(spark, tmp_path):
    store = kept_model.model_store(spark, str(tmp_path / "m"))
    two, three = frame_of(spark, 120), frame_of(spark, 120, channels=3)
    assert kept_model.refresh(store, two) == "fitted"
    assert kept_model.refresh(store, two) == "extended"
    assert kept_model.refresh(store, three) == "fitted"
    assert kept_model.kept_model(store).count() == 3
    assert kept_model.refresh(store, three, force=True) == "fitted"


def test_late_readings_change_the_mean(spark, tmp_path):
    rows = [[(at(1), "M1", "Temp", 10.0), (at(200), "M1", "Temp", 1.0)], [(at(600), "M1", "Temp", 2.0)], [(at(2), "M1", "Temp", 20.0), (at(601), "M1", "Temp", None)]]
    kind = make_readings(spark, rows[0]).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "t")
    seen = []
    for i, part in enumerate(rows):
        make_readings(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        windows.amend_means(stream, table, str(tmp_path / "cp")).awaitTermination()
        seen.append({r.ts: (r.value, r.n) for r in windows.means_table(spark, table).read().collect()})
    assert seen[0][at(0)] == (10.0, 1) and seen[1][at(0)] == (10.0, 1)
    assert seen[2] == {at(0): (15.0, 2), at(180): (1.0, 1), at(600): (2.0, 1)}
    batch = {r.ts: r.value for r in make_readings(spark, sum(rows, [])).groupBy(F.window("ts", "30 minutes").start.alias("ts")).agg(F.avg("value").alias("value")).collect()}
    assert {k: v for k, (v, _) in seen[2].items()} == {k.replace(tzinfo=None): v for k, v in batch.items()}
