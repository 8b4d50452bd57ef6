import json

import numpy as np
import pandas as pd
import pytest
from conftest import at, channel, make_frame, make_readings

from sensorlake import schema
from sensorlake.operators import series, spatial

T = ("M1", "Temp")


def test_latest_skips_missing_values(spark):
    df = make_readings(spark, [(at(0), *T, 1.0), (at(3), *T, 2.0), (at(6), *T, None)])
    row = series.latest(df).first()
    assert (row.value, row.ts) == (2.0, at(3))


def test_last_rows_counts_frame_times(spark):
    df = make_readings(spark, [(at(m), node, "Temp", 1.0) for m in range(5) for node in ("M1", "M4")])
    assert series.last_rows(df, 2).count() == 4


def test_rank_ties_keep_node_order(spark):
    df = make_readings(spark, [(at(0), n, "Temp", v) for n, v in (("M10", 5.0), ("M4", 5.0), ("M9", 7.0), ("M1", 1.0))])
    rows = series.rank_nodes(df, schema.nodes(spark)).orderBy("rank").collect()
    assert [(r.node, r.tag) for r in rows] == [("M9", "highest"), ("M4", None), ("M10", None), ("M1", "lowest")]


def test_module_filter_is_exact(spark):
    df = make_readings(spark, [(at(0), "M1", "Temp", 1.0), (at(0), "M10", "Temp", 1.0)])
    assert [r.node for r in series.require_module(df, "M1").collect()] == ["M1"]
    with pytest.raises(ValueError):
        series.require_module(df, "M7")


def test_trailing_cutoff_is_inclusive(spark):
    df = make_readings(spark, [(at(m), *T, 1.0) for m in (0, 1, 60, 61)])
    assert series.trailing(df, "hour").count() == 3
    assert series.trailing(df, "month").count() == 4


def test_silent_cutoff_is_inclusive_and_frozen_needs_forty(spark):
    df = make_readings(
        spark,
        [(at(0), "M1", "Temp", 1.0), (at(-1), "M4", "Temp", 1.0), (at(60), "M6", "Temp", 1.0), (at(59), "M7", "Temp", None)],
    )
    assert {r.node for r in series.active_nodes(df).collect()} == {"M1", "M6"}
    silent = {r.node for r in series.silent_nodes(df, schema.nodes(spark)).collect()}
    assert silent == set(schema.NODE_IDS) - {"M1", "M6"}
    frame = make_frame(
        spark,
        {
            T: [5.0] * 41, ("M4", "Temp"): [1.0] * 2 + [5.0] * 39,
            ("M6", "Temp"): [5.0] * 40 + [None], ("M7", "Temp"): [9.0] + [5.0] * 40,
        },
    )
    assert {r.node for r in series.frozen_channels(frame).collect()} == {"M1", "M7"}
    assert series.frozen_channels(make_frame(spark, {T: [5.0] * 39})).count() == 0


@pytest.mark.parametrize("block_rows", [4, 50_000])
def test_smoothing_with_and_without_missing_rows(spark, block_rows):
    values = [1.0, None, 4.0, 2.0, None, 8.0, 3.0, 1.0]
    frame = make_frame(spark, {T: values})
    s = pd.Series([np.nan if v is None else v for v in values])
    kept = series.smooth(frame, drop_missing=False, block_rows=block_rows)
    np.testing.assert_allclose(
        channel(kept, "smoothed"), s.rolling(5, center=True, min_periods=1).mean()
    )
    dropped = series.smooth(frame.drop("pos"), block_rows=block_rows)
    np.testing.assert_allclose(
        channel(dropped, "smoothed", order="ts"),
        s.dropna().rolling(5, center=True, min_periods=1).mean(),
    )


def test_day_frames_keep_empty_steps(spark):
    df = make_readings(spark, [(at(0), *T, 1.0), (at(10), *T, 3.0), (at(100), *T, 5.0), (at(60 * 25), *T, 7.0)])
    frames = series.day_frames(df)
    assert channel(frames, "value", order="ts") == [2.0, None, None, 5.0, 7.0]
    filled = series.filled_day_frames(frames)
    assert channel(filled, "filled", order="ts") == pytest.approx([2.0, 3.0, 4.0, 5.0, 7.0])


def test_sampling_step_and_default(spark):
    df = make_readings(spark, [(at(m), *T, 1.0) for m in (0, 3, 7, 9)])
    assert series.sampling_step(df).first().step_us == 180e6
    one = make_readings(spark, [(at(0), *T, 1.0)])
    assert series.sampling_step(one).first().step_us == schema.DEFAULT_STEP_US


def test_bands_and_summary(spark):
    df = make_readings(spark, [(at(0), "M1", "TVOC", 105.0), (at(0), "M4", "TVOC", 105.1), (at(0), "M6", "TVOC", 195.1)])
    bands = {r.node: r.band for r in series.value_bands(df, schema.metrics(spark)).collect()}
    assert bands == {"M1": "low", "M4": "mid", "M6": "high"}


def test_payloads(spark):
    frame = make_frame(spark, {T: [1.0, 28.705], ("M1", "Humid"): [60.125, None]})
    texts = {r.name: r.text for r in series.snapshot_texts(frame).collect()}
    assert texts == {"M1_Temp": "28.70", "M1_Hum": None, "Timestamp": "2024-03-01 00:03:00"}
    rows = [json.loads(r.payload) for r in series.history_json(frame, 5).orderBy("ts").collect()]
    assert rows == [
        {"M1_Hum": "60.12", "M1_Temp": "1.00", "created": "00:00:00"},
        {"M1_Temp": "28.70", "created": "00:03:00"},
    ]
    whole = series.history_envelope(frame, 5).first()
    assert (whole.date, whole["count"], len(whole.data)) == ("2024-03-01", 2, 2)
    assert json.loads(series.snapshot_json(frame).first().payload)["M1_Temp"] == "28.70"


def test_node_table_marks_unknown(spark):
    df = make_readings(spark, [(at(0), "M1", "CO2", 812.5)])
    rows = {r.node: r for r in series.node_table(df, schema.nodes(spark)).collect()}
    assert (rows["M1"].co2, rows["M1"].temp, rows["M4"].co2) == ("812", "--", "--")


def test_freshness_limits(spark):
    df = make_readings(spark, [(at(seconds=s), n, "Temp", 1.0) for s, n in ((0, "M1"), (1, "M4"), (601, "M6"), (602, "M7"), (901, "M8"))])
    got = {r.node: r.status for r in series.freshness(df, schema.nodes(spark)).collect()}
    assert got["M1"] == "unhealthy" and got["M4"] == "degraded"
    assert got["M6"] == "degraded" and got["M7"] == "ok" and got["M8"] == "ok" and got["M9"] == "degraded"


def test_compare_two_nodes(spark):
    frame = make_frame(spark, {T: [1.0, 2.0, 3.0], ("M4", "Temp"): [2.0, 2.0, 2.0]})
    rows = series.compare_nodes(frame, "M1", "M4").orderBy("ts").collect()
    assert [r.a for r in rows] == [2.0, 2.0, 2.0] and rows[0].above == "M4" and rows[0].last_delta == 0.0


@pytest.mark.parametrize("kind", ["heat", "frame"])
def test_surfaces_equal_numpy(spark, kind):
    positions = [("M1", 1.0, 5.5), ("M4", 4.5, 5.5), ("M6", 0.0, 0.0)]
    rows = [(at(0), "M1", "Temp", 20.0), (at(0), "M4", "Temp", None), (at(0), "M6", "Temp", 30.0)]
    make = spatial.heat_grid if kind == "heat" else spatial.frame_grid
    got = make(make_readings(spark, rows), positions, ["ts", "metric"], 7, 5).orderBy("row", "col").collect()
    gx, gy = np.meshgrid(np.linspace(0, 7.5, 7), np.linspace(0, 6.8, 5))
    top = bottom = 0
    for (_, px, py), v in zip(positions, (20.0, None, 30.0)):
        if v is None:
            continue
        d2 = (gx - px) ** 2 + (gy - py) ** 2
        w = 1 / (np.sqrt(d2) + 1e-6) ** 2 if kind == "heat" else 1 / np.maximum(d2, 1e-10)
        top, bottom = top + w * v, bottom + w
    np.testing.assert_allclose([r.z for r in got], (top / bottom).ravel(), rtol=1e-9)
    assert got[0].z == pytest.approx(30.0)


@pytest.mark.parametrize("kind", ["heat", "frame"])
def test_surfaces_of_many_nodes_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    n, nx, ny = 5000, 9, 11
    px, py, v = rng.uniform(0, 7.5, n), rng.uniform(0, 6.8, n), rng.normal(25, 5, n)
    known = rng.random(n) < 0.9
    positions = spark.createDataFrame([(f"N{i}", float(px[i]), float(py[i])) for i in range(n)], "node string, px double, py double")
    rows = [(at(0), f"N{i}", "Temp", float(v[i]) if known[i] else None) for i in range(n)]
    rows.append((at(0), "nowhere", "Temp", 99.0))
    make = spatial.heat_grid if kind == "heat" else spatial.frame_grid
    got = make(make_readings(spark, rows), positions, ["ts", "metric"], nx, ny)
    gx, gy = np.meshgrid(np.linspace(0, 7.5, nx), np.linspace(0, 6.8, ny))
    d2 = (gx[..., None] - px[known]) ** 2 + (gy[..., None] - py[known]) ** 2
    w = 1 / (np.sqrt(d2) + 1e-6) ** 2 if kind == "heat" else 1 / np.maximum(d2, 1e-10)
    want = (w * v[known]).sum(-1) / w.sum(-1)
    np.testing.assert_allclose([r.z for r in got.orderBy("row", "col").collect()], want.ravel(), rtol=1e-9)
    # Cells are summed where the tiles already are: nothing but blocks and their numbers is shuffled.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ts") <= 3 and "hashpartitioning(row" not in plan
