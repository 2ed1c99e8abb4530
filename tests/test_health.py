"""The running, still incomplete time isn't judged."""

import random

from pyspark.sql import functions as F

from runsight.operators import health as H
from runsight.operators import series as S

CONTINUITY = "continuity_local double, continuity_global double, continuity_cumulative double"


def test_running_time_is_left_out(spark):
    steps = spark.createDataFrame([(1, float(t), 0.5 if t < 4 else None, 1e-9, 1e-9, 1e-9) for t in (1, 2, 3, 4)] + [(0, 4.0, 0.5, 1e-9, 1e-9, 1e-9)], f"segment int, simulation_time double, courant_max double, {CONTINUITY}")
    fields = [(1, float(t), f, 1e-6, True) for t in (1, 2, 3) for f in ("p", "T")] + [(1, 4.0, "p", 1e-6, True)]
    residuals = spark.createDataFrame(fields, "segment int, simulation_time double, field string, initial double, converged boolean")
    now, none = (F.lit(1), F.lit(4.0)), (F.lit(1), F.lit(None).cast("double"))

    def judged(*of):
        late = H.healthy_steps(steps, residuals, 1.0, 20, *of)
        return late.count(), late.where("NOT healthy OR healthy IS NULL").count(), [r.passed for r in H.target_checks(residuals, [("T", 1e-3)], 3, *of).collect()]

    assert judged(now) == judged(now, F.lit(False)) == judged(now, F.lit(None).cast("boolean")) == (4, 0, [True])
    assert judged(now, F.lit(True)) == judged(none) == judged() == (5, 1, [False])


def test_all_three_continuity_errors_must_be_finite(spark):
    nan, inf = float("nan"), float("inf")
    errors = [(1e-9, 1e-9, 1e-9), (None, 1e-9, 1e-9), (1e-9, None, 1e-9), (1e-9, 1e-9, nan), (inf, 1e-9, 1e-9)]
    steps = spark.createDataFrame([(0, float(i), 0.5, *e) for i, e in enumerate(errors)], f"segment int, simulation_time double, courant_max double, {CONTINUITY}")
    residuals = spark.createDataFrame([], "segment int, simulation_time double, converged boolean")
    out = {r.simulation_time: r.healthy for r in H.healthy_steps(steps, residuals, 1.0).collect()}
    assert out == {0.0: True, 1.0: False, 2.0: False, 3.0: False, 4.0: False}


def test_verdicts_of_many_runs_are_those_of_each(spark):
    draw = random.Random(6)
    rows = [(r, s, float(t), f, draw.choice([0.001, 0.05, 0.2, float("nan")]) if draw.random() < 0.1 else 0.001 * (r + 1)) for r in range(6) for s in range(2) for t in range(1 if r == 4 else 4) for f in ("Ux", "p")]
    targets = [(0, 0, "U", 0.01), (1, 0, "U", 0.001), (1, 1, "p", 0.01), (2, 0, "(", 1.0), (4, 0, "p", 1.0), (5, 0, "p", 1.0)]
    said = [(r, r == 5 and None, "Fatal error" if r == 5 else None) for r in range(7)]
    residuals = spark.createDataFrame(rows, "run int, segment int, simulation_time double, field string, initial double")
    runs = spark.createDataFrame(said, "run int, declared boolean, failure string")
    out = {r.run: r.status for r in H.steady_verdicts(residuals, spark.createDataFrame(targets, "run int, pos int, pattern string, threshold double"), runs).collect()}
    for run, _, failure in said:
        own = residuals.where(F.col("run") == run)
        checks = H.target_checks(own, [(p, x) for r, _, p, x in targets if r == run])
        groups = own.select("segment", "simulation_time").distinct().count()
        assert out[run] == H.steady_verdict(checks, F.lit(groups), F.lit(False), F.lit(failure).cast("string")).first().status
    assert {out[3], out[4], out[5]} == {"not_configured", "insufficient_data", "failing"}

    steps = [(r, 0, float(t), None if draw.random() < 0.05 * r else 0.5, *[1e-9 * (90 if t > 22 and r == 2 else 1)] * 3) for r in range(5) for t in range(2 if r == 4 else 25)]
    steps = spark.createDataFrame(steps, f"run int, segment int, simulation_time double, courant_max double, {CONTINUITY}")
    solves = spark.createDataFrame([(1, 0, float(t), t != 20) for t in range(25)], "run int, segment int, simulation_time double, converged boolean")
    limits = [(r, None if r == 3 else 1.0, None) for r in range(6)]
    out = {r.run: tuple(r)[1:] for r in H.transient_verdicts(steps, solves, spark.createDataFrame(limits, "run int, limit double, failure string")).collect()}
    for run, limit, _ in limits:
        late = H.healthy_steps(steps.where(F.col("run") == run), solves.where(F.col("run") == run), limit if limit else -1.0)
        one = H.transient_verdict(late, H.continuity_trend(late.withColumnRenamed("simulation_time", "seq")), F.lit(None).cast("string"), limit is not None).first()
        assert out[run][-1] == one.status and out[run][0] == one.n_steps and out[run][3] == one.degraded
    assert out[4][-1] == out[5][-1] == "insufficient_data" and out[3][-1] == "not_configured"


def test_plots_and_points(spark):
    rows = [("p", 1.0, 0.5, 1), ("p", 1.0, 0.25, 2), ("p", 2.0, 0.0, 3), ("p", 3.0, float("nan"), 4), ("p", None, 1.0, 5), ("p", 4.0, -1.0, 6), ("U", 5.0, 2.0, 7)]
    out = H.plotted(spark.createDataFrame(rows, "field string, simulation_time double, initial double, line_no int"))
    assert sorted(tuple(r) for r in out.collect()) == [("U", 5.0, 2.0), ("p", 1.0, 0.25)]
    pairs = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), ("b", [], [1.0]), ("c", None, [1.0]), ("d", [1.0, 2.0], [3.0, None])], "series_id string, times array<double>, values array<double>")
    assert sorted(S.points_of(pairs).collect(), key=str) == sorted([("a", 1.0, 3.0, 0), ("d", 1.0, 3.0, 0), ("d", 2.0, None, 1)], key=str)
