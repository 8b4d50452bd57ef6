import random
import time

import numpy as np
import pandas as pd
import pytest
from conftest import at, make_readings

from sensorlake.functions.times import MINUTE_US
from sensorlake.operators import clean, evaluate
from sensorlake.operators.asof import match_times
from sensorlake.operators.blocks import BLOCK, rows_frame, with_position, with_previous, with_row_block
from sensorlake.operators.quantile import exact_quantile
from pyspark.sql import functions as F


def times(spark, minutes):
    return spark.createDataFrame([(at(m),) for m in minutes], "ts timestamp_ntz")


def matched(df):
    base = np.datetime64(at(), "us").astype("int64")
    return {
        (r.at_us - base) / MINUTE_US: (r.match_us - base) / MINUTE_US for r in df.collect()
    }


def test_nearest_ties_go_to_the_later_time_and_tolerance_is_inclusive(spark):
    frame = times(spark, [0, 10, 20, 40])
    targets = times(spark, [-2, 0, 5, 4, 22, 23, 38, 42, 43])
    out = match_times(targets, frame, direction="nearest", tolerance_us=5 * MINUTE_US)
    assert matched(out) == {-2: 0, 0: 0, 5: 10, 4: 0, 22: 20, 23: 20, 38: 40, 42: 40, 43: 40}
    out = match_times(targets, frame, direction="nearest", tolerance_us=2 * MINUTE_US)
    assert matched(out) == {-2: 0, 0: 0, 22: 20, 38: 40, 42: 40}


@pytest.mark.parametrize("block_rows", [1, 7, 60, 100_000])
def test_nearest_equals_pandas(spark, block_rows):
    rng = random.Random(7)
    frame = sorted(rng.sample(range(0, 3000), 90))
    targets = sorted(rng.sample(range(-50, 3100), 200))
    index = pd.Index(frame)
    want = {t: frame[i] for t, i in zip(targets, index.get_indexer(targets, method="nearest"))}
    out = match_times(
        times(spark, targets), times(spark, frame), direction="nearest", block_rows=block_rows
    )
    assert matched(out) == want


def test_backward_takes_the_last_at_or_before(spark):
    out = match_times(times(spark, [-1, 0, 59, 60, 200]), times(spark, [0, 60, 120]))
    assert matched(out) == {0: 0, 59: 0, 60: 60, 200: 120}


def test_reconcile_needs_every_channel(spark):
    readings = make_readings(
        spark,
        [(at(3), "M1", "Temp", 20.0), (at(3), "M1", "CO2", 500.0), (at(9), "M1", "Temp", 21.0)],
    )
    log = spark.createDataFrame(
        [
            (at(0), at(2), "M1", "Temp", 19.0),
            (at(0), at(2), "M1", "CO2", 510.0),
            (at(6), at(9), "M1", "Temp", 22.0),
            (at(6), at(9), "M1", "CO2", 500.0),
            (at(20), at(23), "M1", "Temp", 22.0),
            (at(30), None, "M1", "Temp", 22.0),
        ],
        "issue_ts timestamp_ntz, target_ts timestamp_ntz, node string, metric string, pred double",
    )
    rows = {
        (r.issue_ts, r.metric): r
        for r in evaluate.reconcile(log, readings, evaluate.tolerance_us(MINUTE_US)).collect()
    }
    full, part = rows[(at(0), "CO2")], rows[(at(6), "Temp")]
    assert (full.gt, full.residual, full.abs_error) == (500.0, -10.0, 10.0)
    assert full.gt_ts == at(3) and full.ground_truth_matched
    assert part.matched and not part.ground_truth_matched
    assert not rows[(at(20), "Temp")].matched and rows[(at(20), "Temp")].gt_ts is None


def test_tolerance_is_half_a_step_but_a_minute_at_least():
    assert evaluate.tolerance_us(3 * MINUTE_US) == 90_000_000
    assert evaluate.tolerance_us(MINUTE_US) == MINUTE_US


@pytest.mark.parametrize("q", [0.5, 0.95, 0.0, 1.0])
@pytest.mark.parametrize("width", [1.0, 10.0, 1e6])
def test_quantile_is_exact_for_any_bin_width(spark, q, width):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(0, 40)) for _ in range(300)] + [("b", v) for v in (3, 9)] + [("c", 5)]
    got = exact_quantile(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", q, width)
    frame = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].quantile(q)
    assert {r.k: r.quantile for r in got.collect()} == pytest.approx(frame.to_dict())


def test_blocks_stay_small_when_one_hour_of_one_channel_holds_most_rows(spark):
    """27,000 of 30,000 rows lie in one hour of channel ``a``; 100 more share one instant."""
    hot = spark.range(27_000).selectExpr("'a' AS k", "36e8 * 5 + id * 100003 AS at")
    rest = spark.range(2_900).selectExpr("IF(id % 3 = 0, 'a', 'b') AS k", "36e8 * (id DIV 3 % 200) + id AS at")
    instant = spark.range(100).selectExpr("'b' AS k", "36e8 * 300 AS at")
    rows = hot.union(rest).union(instant).selectExpr("k", "CAST(at AS BIGINT) AS at")
    blocked = with_row_block(rows, ["k"], "at", 500)
    assert blocked.count() == 30_000 and blocked.filter(f"{BLOCK} IS NULL").count() == 0
    blocks = blocked.groupBy("k", BLOCK).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"), F.max("at").alias("end")
    ).orderBy("k", BLOCK).collect()
    assert max(b.n for b in blocks) <= 500
    assert len(blocks) < 200
    for x, y in zip(blocks, blocks[1:]):
        assert x.k != y.k or x.end < y.begin


@pytest.mark.parametrize("block_rows", [1, 5, 50_000])
def test_positions_and_previous_rows_cross_blocks(spark, block_rows):
    rng = random.Random(5)
    rows = []
    for key, n in (("a", 200), ("b", 3)):
        rows += [(at(m), key, None if i % 4 == 0 else float(i)) for i, m in enumerate(sorted(rng.sample(range(900), n)))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")
    got = with_position(df, ["k"], block_rows=block_rows).orderBy("k", "ts").collect()
    assert [r.pos for r in got] == [*range(200), *range(3)]
    got = with_previous(df, ["k"], {"p": "v"}, block_rows=block_rows).orderBy("k", "ts").collect()
    for before, row in zip(got, got[1:]):
        if before.k == row.k:
            assert row.p == before.v
    assert got[0].p is None and got[200].p is None


@pytest.mark.parametrize("block_rows", [6, 17, 1000])
def test_row_frames_do_not_depend_on_blocks(spark, block_rows):
    values = [float((i * 37) % 11) for i in range(100)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, pos bigint, v double")
    out = rows_frame(
        df, ["k"], {"s": lambda w: F.sum("v").over(w.rowsBetween(-4, 2))}, 4, 2, block_rows=block_rows
    )
    got = [r.s for r in out.orderBy("pos").collect()]
    assert got == [sum(values[max(0, i - 4) : i + 3]) for i in range(100)]


def test_drift_meets_the_last_weather_entry(spark):
    readings = make_readings(
        spark,
        [
            (at(59), "M7", "Temp", 26.0), (at(60), "M7", "Temp", 26.0), (at(61), "M7", "Humid", 80.0),
            (at(70), "M4", "Temp", 99.0), (at(-5), "M7", "Temp", 99.0), (at(65), "M1", "Temp", 38.0),
        ],
    )
    weather = spark.createDataFrame(
        [(at(0), "Temp", 30.0), (at(60), "Temp", 20.0), (at(0), "Humid", 64.9)],
        "ts timestamp_ntz, metric string, value double",
    )
    from sensorlake import schema

    got = evaluate.sensor_drift(readings, weather, schema.outdoor(spark)).collect()
    assert {(r.ts, r.node, r.metric, round(r.deviation, 6)) for r in got} == {
        (at(60), "M7", "Temp", 6.0),
        (at(61), "M7", "Humid", 15.1),
        (at(65), "M1", "Temp", 18.0),
    }


def test_look_ahead_is_linear_in_a_block(spark):
    """50,000 rows of one block, from which every row looks ahead; both ways of doing it agree."""
    rows = spark.range(0, 50_000, 1, 1).select(
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.col("id").alias("pos"),
        F.lit("M1").alias("node"), F.lit("Temp").alias("metric"),
        F.when(F.col("id") % 997 == 0, F.col("id").cast("double")).alias("value"),
    )
    begun = time.monotonic()
    out = clean.interpolate(rows, block_rows=50_000).agg(F.sum("filled"), F.count("filled")).first()
    took = time.monotonic() - begun
    last = 49_999 // 997 * 997
    assert out[1] == 50_000 and abs(out[0] - (sum(range(last + 1)) + last * (49_999 - last))) < 1
    targets = rows.select((F.col("ts") + F.expr("INTERVAL 7 SECONDS")).alias("ts"))
    begun = time.monotonic()
    near = match_times(targets, rows.filter("pos % 2 = 0").select("ts"), direction="nearest", block_rows=200_000)
    assert near.agg(F.sum(F.abs(F.col("match_us") - F.col("at_us")))).scalar() is not None
    assert near.count() == 50_000
    assert took < 8 and time.monotonic() - begun < 20
