"""States of signals that are known by construction, and the grouped form against the direct one."""

import math
import random

import numpy as np
import pytest

from runsight.operators import series as S
from runsight.operators import stationarity as St


def noise(seed, n, mean, std):
    draw = random.Random(seed)
    return [mean + draw.gauss(0, std) for _ in range(n)]


def ar1(seed, n, phi):
    draw, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x = phi * x + draw.gauss(0, 1)
        out.append(x)
    return out


def sine(n, period, phase=0.0, amplitude=lambda i: 0.8, mean=lambda i: 4.0):
    return [mean(i) + amplitude(i) * math.sin(2 * math.pi * i / period + phase) for i in range(n)]


SIGNALS = {
    "noise": (noise(31, 600, 10, 0.05), {"plateau", "statistically_stationary"}),
    "ramp": ([2 + 0.002 * i for i in range(600)], {"evolving"}),
    "sine": (sine(800, 40), {"periodic"}),
    "short_sine": (sine(600, 6), {"periodic"}),
    "odd_sine": (sine(600, 7, 0.7), {"periodic"}),
    "prime_sine": (sine(600, 29, 1.1), {"periodic"}),
    "long_sine": (sine(12_000, 1200), {"periodic"}),
    "late_growth": (sine(12_000, 40, amplitude=lambda i: 0.8 if i < 11_000 else 0.8 + (i - 11_000) * 0.002), {"evolving"}),
    "growing": (sine(800, 40, amplitude=lambda i: 0.4 + 0.0015 * i), {"evolving"}),
    "drifting": (sine(800, 40, mean=lambda i: 4 + 0.001 * i), {"evolving"}),
    "tiny": (noise(101, 100, 0, 1e-15) * 2, {"plateau"}),
    "slow": (ar1(23, 60, 0.99), {"indeterminate"}),
    "constant": ([5.0] * 100, {"plateau"}),
    "gap": ([1.0] * 240, {"indeterminate"}),
}


def points_of(spark, signals):
    rows = []
    for name, values in signals.items():
        for i, v in enumerate(values):
            rows.append((name, float(i + (1000 if name == "gap" and i >= 200 else 0)), float(v), i))
    return spark.createDataFrame(rows, "series_id string, t double, v double, pos long")


@pytest.fixture(scope="module")
def found(spark):
    return {r.series_id: r for r in St.classify(points_of(spark, {k: v for k, (v, _) in SIGNALS.items()})).collect()}


@pytest.mark.parametrize("name", SIGNALS)
def test_states(found, name):
    assert found[name].state in SIGNALS[name][1], found[name]


def test_evidence(found):
    assert found["noise"].effective_samples >= 20 and found["sine"].period == pytest.approx(40, abs=1) and found["sine"].complete_cycles >= 3
    assert found["odd_sine"].period == pytest.approx(7, abs=1) and found["prime_sine"].period == pytest.approx(29, abs=1)
    assert found["long_sine"].period == pytest.approx(1200, abs=5) and found["short_sine"].period_variation <= 0.05
    assert found["gap"].discontinuous and found["gap"].segment_samples == 40
    assert all(math.isfinite(x) for x in (found["tiny"].mean_shift_standard_errors, found["tiny"].normalized_slope))


def test_stale_bad_and_overridden_series(spark):
    signals = {"a": SIGNALS["noise"][0], "b": SIGNALS["noise"][0], "c": [3.0] * 98 + [float("nan"), float("inf"), None], "d": [float("nan")]}
    rows = [(k, float(i), v, i) for k, values in signals.items() for i, v in enumerate(values)] + [("c", None, 3.0, 200), ("c", float("nan"), 3.0, 201)]
    points = spark.createDataFrame(rows, "series_id string, t double, v double, pos long")
    ages = spark.createDataFrame([("a", 121.0), ("b", 121.0)], "series_id string, age_seconds double")
    overrides = spark.createDataFrame([("b", 500.0)], "series_id string, stale_after_seconds double")
    out = {r.series_id: r for r in St.classify(points, overrides=overrides, ages=ages).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"].stale and out["a"].state == "indeterminate" and not out["b"].stale and out["b"].state != "indeterminate"
    assert out["c"].state == "plateau" and out["c"].raw_samples == 98


def test_views_are_bounded(spark):
    rows = S.latest_segment(S.dedup_latest(points_of(spark, {"long": SIGNALS["long_sine"][0]})))
    assert St.views(rows).count() <= 2 * S.MOST_SAMPLES
    taken = sorted(r.i for r in S.overview(rows).collect())
    assert taken == [k * 11_999 // 2047 for k in range(2048)]


def test_correlation_time_of_correlated_noise():
    v = np.array(ar1(17, 400, 0.98))
    assert St.decorrelation(np.arange(400.0), v) > 1
    assert St.decorrelation(np.arange(50.0), 3 + 2 * np.arange(50.0)) == 1


def test_envelope_keeps_extremes(spark):
    values = [0.0, 5.0, -5.0, 1.0, 8.0, -9.0, 0.0]
    rows = S.latest_segment(S.dedup_latest(points_of(spark, {"x": values})))
    got = {limit: sorted(r.t for r in S.envelope(rows, limit).collect()) for limit in (1, 2, 3, 4, 7, 9)}
    assert got[1] == [6] and got[2] == [0, 6] and got[3] == [0, 5, 6] and got[4] == [0, 4, 5, 6] and got[7] == got[9] == list(map(float, range(7)))


def test_nothing_selected(spark):
    none = spark.createDataFrame([], "pos int, series_id string")
    (row,) = St.aggregate_verdict(none, spark.createDataFrame([("a", "plateau")], "series_id string, state string")).collect()
    assert row.state == "indeterminate" and row.n_selected == 0


def test_envelope_fills_like_one_sort(spark):
    """Ties, flat stretches and few far points are cut as by one task that puts all of them in order."""
    draw = random.Random(5)
    signals = {"ties": [float(draw.randrange(3)) for _ in range(700)], "flat": [2.0] * 500, "spikes": [9.0 if i % 97 == 5 else 0.0 for i in range(900)], "noise": [draw.gauss(0, 1) for _ in range(641)], "short": [1.0, 2.0] * 9}
    rows = [(k, float(i), x, i, len(v)) for k, v in signals.items() for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "series_id string, t double, v double, i long, n long").repartition(5)
    for limit in (3, 4, 21, 50):
        want = set()
        for name, v in signals.items():
            n, buckets = len(v), (limit - 2) // 2
            taken = set(range(n)) if n <= limit else {0, n - 1}
            if n > limit:
                for b in range(buckets):
                    inside = [i for i in range(1, n - 1) if (i * buckets - 1) // (n - 2) == b]
                    taken |= {min(inside, key=lambda i: (v[i], i)), min(inside, key=lambda i: (-v[i], i))}
                far = sorted((i for i in range(n) if i not in taken), key=lambda i: (-abs(v[i] - (v[0] + (v[-1] - v[0]) * i / (n - 1))), i))
                taken |= set(far[: limit - len(taken)])
            want |= {(name, i) for i in taken}
        assert {(r.series_id, r.i) for r in S.envelope(table, limit).collect()} == want


def test_envelope_puts_no_whole_series_in_order(spark):
    """Points meet only written tables of bounds, and those far from every bound aren't put in order."""
    points = spark.range(200_000).selectExpr("'a' AS series_id", "CAST(id AS DOUBLE) AS t", "CAST(xxhash64(id) % 1000003 AS DOUBLE) AS v", "id AS i", "200000L AS n")
    out = S.envelope(points, 50)
    assert out.count() == 50
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bound" in plan and plan.count("Join LeftAnti") == plan.count("Join LeftSemi") == 0
