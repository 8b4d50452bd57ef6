import random

import numpy as np
import pytest
from conftest import at, channel, make_readings

from pyspark.sql import functions as F

from sensorlake import schema
from sensorlake.operators import alerts
from sensorlake.operators.cooldown import UNSET, Steps, greedy_accept

BOUNDS = {t[0]: t for t in schema.THRESHOLDS}


def channel_rows(values, metric="Temp", node="M1", step=3):
    return [(at(step * i), node, metric, v) for i, v in enumerate(values)]


def loop_states(values, metric="Temp"):
    """The state machine as a plain loop."""
    _, lo, hi, margin, *_ = BOUNDS[metric]
    active, out = False, []
    for v in values:
        if v is not None and ((hi is not None and v > hi) or (lo is not None and v < lo)):
            active = True
        elif v is None:
            active = False
        elif not ((hi is not None and v > hi - margin) or (lo is not None and v < lo + margin)):
            active = False
        out.append(int(active))
    return out


def loop_notices(rows, metric="Temp", cooldown=3600, reminder=43200):
    _, lo, hi, margin, *_ = BOUNDS[metric]
    active, sent, notice, out = False, None, None, []
    for ts, _, _, v in rows:
        t = (ts - at()).total_seconds()
        breach = v is not None and ((hi is not None and v > hi) or (lo is not None and v < lo))
        if breach and not active:
            active = True
            if sent is None or t - sent >= cooldown:
                out.append((t, "new"))
                sent = t
            else:
                out.append((t, "suppressed"))
            notice = sent
        elif breach and t - notice > reminder:
            out.append((t, "reminder"))
            notice = t
        elif not breach:
            hold = v is not None and (
                (hi is not None and v > hi - margin) or (lo is not None and v < lo + margin)
            )
            if not hold:
                active, notice = False, None
    return sorted(out)


def notices_of(df):
    base = int(at().timestamp() * 1_000_000)
    return sorted(((r.at_us - base) / 1e6, r.kind) for r in df.collect())


@pytest.fixture(autouse=True)
def _utc(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


def test_breach_is_strict_and_directed(spark):
    rows = channel_rows([33.0, 33.01, 18.0, 17.99, None])
    rows += channel_rows([301.0, 5.0], "TVOC")
    out = alerts.score_breaches(make_readings(spark, rows), schema.thresholds(spark))
    assert channel(out, "direction", order="ts") == [None, "HIGH", None, "LOW", None]
    assert channel(out, "direction", metric="TVOC", order="ts") == ["HIGH", None]
    assert channel(out, "severity", order="ts") == pytest.approx([0, 0.01, 0, 0.01, 0])


def test_hysteresis_edges(spark):
    values = [34.0, 32.6, 32.5, 32.6, 17.0, 18.4, 18.5, 34.0, None, 32.9, 34.0, 20.0]
    state = alerts.breach_state(make_readings(spark, channel_rows(values)), schema.thresholds(spark))
    assert channel(state, "active", order="ts") == loop_states(values)
    assert loop_states(values) == [1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0]


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_states_do_not_depend_on_blocks(spark, block_rows):
    rng = random.Random(4)
    values = [None if rng.random() < 0.1 else rng.choice([25.0, 32.7, 34.0, 33.0]) for _ in range(300)]
    state = alerts.breach_state(
        make_readings(spark, channel_rows(values)), schema.thresholds(spark),
        block_rows,
    )
    want = loop_states(values)
    assert channel(state, "active", order="ts") == want
    onsets = [bool(b and not a) for a, b in zip([0, *want], want)]
    assert channel(state, "onset", order="ts") == onsets
    begun, started = None, []
    for i, (on, active) in enumerate(zip(onsets, want)):
        begun = at(3 * i) if on else begun
        started.append(begun if active else None)
    assert channel(state, "started", order="ts") == started
    assert alerts.episodes(state).count() == sum(onsets)


def test_episode_summary(spark):
    values = [25.0, 34.0, 36.0, 32.8, 25.0, 35.0]
    state = alerts.breach_state(make_readings(spark, channel_rows(values)), schema.thresholds(spark))
    first, second = alerts.episodes(state).orderBy("started").collect()
    assert (first.started, first.ended, first.n_readings) == (at(3), at(9), 3)
    assert first.peak_severity == 3.0 and first.duration_us == 360_000_000
    assert second.started == second.ended == at(15)


@pytest.mark.parametrize("seed,step,count", [(1, 3, 400), (2, 20, 400), (3, 61, 300), (5, 240, 200)])
def test_notifications_equal_the_loop(spark, seed, step, count):
    rng = random.Random(seed)
    values = []
    while len(values) < count:
        values += [rng.choice([25.0, 34.0, 32.8, None])] * rng.choice([1, 1, 2, 5, 30])
    rows = channel_rows(values, step=step)
    state = alerts.breach_state(make_readings(spark, rows), schema.thresholds(spark))
    assert notices_of(alerts.notifications(state)) == loop_notices(rows)


def test_cooldown_and_reminder_boundaries(spark):
    def rows(*pairs):
        return [(at(seconds=s), "M1", "Temp", v) for s, v in pairs]

    hit, ok = 34.0, 25.0
    exact = rows((0, hit), (10, ok), (3599, hit), (3599.5, ok), (3600, hit))
    state = alerts.breach_state(make_readings(spark, exact), schema.thresholds(spark))
    assert notices_of(alerts.notifications(state)) == [(0, "new"), (3599, "suppressed"), (3600, "new")]
    long = rows((0, hit), (43200, hit), (43201, hit), (86401, hit), (86402, hit))
    state = alerts.breach_state(make_readings(spark, long), schema.thresholds(spark))
    assert notices_of(alerts.notifications(state)) == [(0, "new"), (43201, "reminder"), (86402, "reminder")]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block,fan_in", [(40, 3), (1000, 16)])
def test_greedy_chain_equals_the_loop(spark, strict, block, fan_in):
    rng = random.Random(block)
    rows, unit = [], 10_000
    for key in "abcde":
        # "a" is a hot key: most of the rows, packed tightly.
        n = 400 if key == "a" else 30
        rows += [(key, t * unit, -5 * unit) for t in sorted(rng.sample(range(0, 900), n))]
    df = spark.createDataFrame(rows, "k string, t bigint, s bigint")
    for start in (None, "s"):
        got = greedy_accept(df, ["k"], "t", 10 * unit, strict, start, block, fan_in)
        got = {(r.k, r.t): (r.accepted, r.prev_us, r.last_us) for r in got.collect()}
        last = {k: (-5 * unit if start else None) for k in "abcde"}
        for k, t, _ in rows:
            before = last[k]
            gap = None if before is None else t - before
            passes = gap is None or (gap > 10 * unit if strict else gap >= 10 * unit)
            last[k] = t if passes else before
            assert got[(k, t)] == (passes, before, last[k])


def test_greedy_start_inside_the_block(spark):
    df = spark.createDataFrame([("a", t, 100) for t in (105, 111, 112, 121, 140)], "k string, t bigint, s bigint")
    got = greedy_accept(df, ["k"], "t", 10, True, "s", 1000).filter("accepted").orderBy("t").collect()
    assert [r.t for r in got] == [111, 140]


def test_merged_step_functions_equal_the_loop_and_stay_small():
    rng = random.Random(4)
    for side in ("left", "right"):
        for gap in (3, 40, 5000):
            times = np.array(sorted(rng.sample(range(10_000), 600)))
            blocks = [times[i : i + 37] for i in range(0, 600, 37)]
            steps = [Steps.of_events(b, int(b[0]), gap, side) for b in blocks]
            while len(steps) > 1:
                steps = [
                    steps[i].then(steps[i + 1]) if i + 1 < len(steps) else steps[i] for i in range(0, len(steps), 2)
                ]
            assert len(steps[0].upto) <= ((times >= times[0]) & (times <= times[0] + gap)).sum() + 1
            for before in (UNSET, -gap, -1, int(times[0]) - 1, int(times[0])):
                last = before
                for t in times.tolist():
                    if t - last > gap or (side == "left" and t - last == gap):
                        last = t
                assert steps[0](np.array([before]))[0] == last


def test_one_chain_over_many_blocks(spark):
    """A fleet-wide chain: no task of the tree sees more than a few small functions."""
    df = spark.range(60_000).select((F.col("id") * 7_000_000 + F.pmod(F.xxhash64("id"), F.lit(6_000_000))).alias("t"))
    got = greedy_accept(df, [], "t", 120_000_000, strict=True, block_rows=500, fan_in=4)
    times = sorted(r.t for r in df.collect())
    want, last = set(), None
    for t in times:
        if last is None or t - last > 120_000_000:
            want.add(t)
            last = t
    assert {r.t for r in got.filter("accepted").collect()} == want


def test_batches_open_once_and_keep_the_worst(spark):
    def notice(s, node, severity, kind="new"):
        us = int(at(seconds=s).timestamp() * 1_000_000)
        return (at(seconds=s), node, "Temp", 34.0, severity, "HIGH", "r", us, kind)

    df = spark.createDataFrame(
        [
            notice(0, "M1", 1.0), notice(100, "M1", 3.0), notice(120, "M4", 2.0),
            notice(121, "M1", 1.0), notice(130, "M6", 1.0, "reminder"), notice(131, "M6", 9.0, "suppressed"),
            notice(500, "M1", 2.0), notice(501, "M1", 2.0),
        ],
        "ts timestamp_ntz, node string, metric string, value double, severity double,"
        " direction string, reason string, at_us bigint, kind string",
    )
    out = alerts.notification_batches(df).collect()
    got = sorted((r.batch_start, r.kind, r.node, r.severity, r.ts) for r in out)
    assert got == sorted(
        [
            (at(), "new", "M1", 3.0, at(seconds=100)),
            (at(), "new", "M4", 2.0, at(seconds=120)),
            (at(seconds=121), "new", "M1", 1.0, at(seconds=121)),
            (at(seconds=121), "reminder", "M6", 1.0, at(seconds=130)),
            (at(seconds=500), "new", "M1", 2.0, at(seconds=501)),
        ]
    )


def test_resolved_channels(spark):
    before = make_readings(spark, channel_rows([1.0]) + channel_rows([1.0], node="M4"))
    now = make_readings(spark, channel_rows([1.0], node="M4"))
    assert [(r.node, r.metric) for r in alerts.resolved(before, now).collect()] == [("M1", "Temp")]


def test_metrics_without_thresholds_stay_and_never_breach(spark):
    high = BOUNDS["Temp"][2] + 5
    rows = channel_rows([1e9, None, -1e9], "Noise") + channel_rows([high])
    state = alerts.breach_state(make_readings(spark, rows), schema.thresholds(spark)).collect()
    assert sorted((r.metric, r.active, r.is_breach, r.started) for r in state if r.metric == "Noise") == [
        ("Noise", 0, False, None)
    ] * 3
    assert [r.active for r in state if r.metric == "Temp"] == [1]
    assert alerts.breaches(make_readings(spark, rows), schema.thresholds(spark)).count() == 1
