"""Numerical health: residual targets of steady runs, limits and trends of transient ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.columns import at_most, finite
from runsight.operators import series as S

#: Groups of residuals that must meet the targets, and steps whose health counts.
LAST_GROUPS, LAST_STEPS, LEAST_STEPS = 3, 20, 3
#: A continuity error that grows by more than this factor, and by more than this much, is degraded.
DEGRADED, NEGLIGIBLE = 5.0, 1e-12


def finalized(rows: DataFrame, current: tuple[Column, Column] | None, completed: Column | None = None) -> DataFrame:
    """rows without those of the current (segment, simulation_time), which is still being written; all of them if the run
    has completed or no time is current."""
    if current is None:
        return rows
    segment, time = current
    running = rows["segment"].eqNullSafe(segment) & rows["simulation_time"].eqNullSafe(time)
    done = F.lit(False) if completed is None else F.coalesce(completed, F.lit(False))
    return rows.where(done | time.isNull() | ~running)


def last_groups(residuals: DataFrame, groups: int = LAST_GROUPS, current: tuple[Column, Column] | None = None, completed: Column | None = None) -> DataFrame:
    """residuals of the last so many finalized() (segment, simulation_time), with back: 1 for the last. Ranks are taken over
    the different groups, not over the rows."""
    residuals = finalized(residuals, current, completed)
    keys = residuals.select("segment", "simulation_time").distinct()
    last = keys.orderBy(F.desc("segment"), F.desc("simulation_time")).limit(groups)
    ranked = last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("segment"), F.desc("simulation_time"))))
    return residuals.join(F.broadcast(ranked), ["segment", "simulation_time"])


@F.pandas_udf(T.IntegerType())
def field_matches(pattern: pd.Series, field: pd.Series) -> pd.Series:
    """1 if the pattern matches the whole field, or is a plain name of which the field is a vector component; null for
    an invalid pattern. Called for pairs of targets and different fields, of which there are few."""
    out = []
    for p, f in zip(pattern, field, strict=True):
        try:
            hit = re.fullmatch(p, f) is not None
        except re.error:
            out.append(None)
            continue
        out.append(int(hit or (re.fullmatch(r"[A-Za-z_]\w*", p) is not None and f in (p + "x", p + "y", p + "z"))))
    return pd.Series(out, dtype="Int32")


def target_checks(residuals: DataFrame, targets: list[tuple[str, float]], groups: int = LAST_GROUPS, current: tuple[Column, Column] | None = None, completed: Column | None = None) -> DataFrame:
    """(pos, pattern, threshold, observed, complete, valid, passed) for each of the targets (pattern, threshold) over the
    last_groups(): passed if residuals match in each of them and all are finite and within the threshold."""
    window = last_groups(residuals, groups, current, completed)
    peaks = window.groupBy("field", "back").agg(F.max("initial").alias("most"), F.bool_and(finite(F.col("initial"))).alias("good"))
    spark = residuals.sparkSession
    rows = spark.createDataFrame([(i, p, float(t)) for i, (p, t) in enumerate(targets)], "pos int, pattern string, threshold double")
    # patterns meet the different fields, not the residuals
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("pattern")) for i, (p, _) in enumerate(targets)]) if targets else F.array().cast("array<struct<pos:int,pattern:string>>")
    matched = peaks.select("field").distinct().select("field", F.inline(entries)).withColumn("match", field_matches("pattern", "field"))
    hits = matched.where("match = 1").join(peaks, "field").groupBy("pos").agg(F.max("most").alias("observed"), F.count_distinct("back").alias("met"), F.bool_and("good").alias("good"))
    bad = matched.groupBy("pos").agg(F.bool_or(F.col("match").isNull()).alias("invalid"))
    out = rows.join(hits, "pos", "left").join(bad, "pos", "left")
    complete = F.coalesce(F.col("met") == groups, F.lit(False))
    valid = ~F.coalesce("invalid", F.lit(False))
    passed = complete & valid & F.coalesce("good", F.lit(False)) & at_most(F.col("observed"), F.col("threshold"))
    return out.select("pos", "pattern", "threshold", "observed", complete.alias("complete"), valid.alias("valid"), passed.alias("passed"))


def steady_verdict(checks: DataFrame, groups: Column, declared: Column, failure: Column) -> DataFrame:
    """One row (status) over target_checks(); groups: how many groups there are."""
    n = checks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all"))
    status = F.when(failure.isNotNull(), "failing").when(declared, "passing").when(F.col("n") == 0, "not_configured").when(groups < LAST_GROUPS, "insufficient_data")
    return n.select(status.when(F.col("all"), "passing").otherwise("failing").alias("status"))


def plotted(residuals: DataFrame, limit: int = 1000) -> DataFrame:
    """(field, t, v): what a plot of residuals shows: those with a finite time and a finite initial residual above zero, of each
    field, and of the same time the last by line, cut to the envelope of limit points."""
    shown = residuals.where(finite(F.col("simulation_time")) & finite(F.col("initial")) & (F.col("initial") > 0))
    points = shown.groupBy(F.col("field").alias("series_id"), F.col("simulation_time").alias("t")).agg(F.max_by("initial", "line_no").alias("v"))
    return S.envelope(S.gaps(points), limit).select(F.col("series_id").alias("field"), "t", "v")


def healthy_steps(steps: DataFrame, residuals: DataFrame, limit: float, last: int = LAST_STEPS, current: tuple[Column, Column] | None = None, completed: Column | None = None) -> DataFrame:
    """The last finalized() steps (segment, simulation_time, courant_max, continuity_local, continuity_global,
    continuity_cumulative, ...) with healthy: Courant number within the limit, all three continuity errors there and finite,
    and no solve of the step that didn't converge."""
    late = finalized(steps, current, completed).orderBy(F.desc("segment"), F.desc("simulation_time")).limit(last)
    unsolved = residuals.where("converged = false").select("segment", "simulation_time").distinct().withColumn("unsolved", F.lit(True))
    good = at_most(F.col("courant_max"), F.lit(limit))
    for part in ("local", "global", "cumulative"):
        good = good & finite(F.col(f"continuity_{part}"))
    return late.join(unsolved, ["segment", "simulation_time"], "left").withColumn("healthy", good & F.col("unsolved").isNull()).drop("unsolved")


def continuity_trend(steps: DataFrame) -> DataFrame:
    """(n, earlier, later, degraded): medians of the absolute error over the first half of (seq, continuity_global) and the rest;
    rows: those of healthy_steps(), of which there are few."""
    rows = steps.where(finite(F.col("continuity_global"))).select("seq", F.abs("continuity_global").alias("e"))
    placed = rows.withColumns({"i": F.row_number().over(Window.orderBy("seq")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    half = F.col("i") <= F.floor(F.col("n") / 2)
    out = placed.agg(F.count(F.lit(1)).alias("n"), F.median(F.when(half, F.col("e"))).alias("earlier"), F.median(F.when(~half, F.col("e"))).alias("later"))
    worse = (F.col("later") > DEGRADED * F.col("earlier")) & (F.col("later") - F.col("earlier") > NEGLIGIBLE)
    return out.withColumn("degraded", F.coalesce(worse, F.lit(False)))


def transient_verdict(steps: DataFrame, trend: DataFrame, failure: Column, configured: bool = True) -> DataFrame:
    """One row (n_steps, healthy_percent, courant_max, degraded, status) over healthy_steps() and continuity_trend()."""
    of = steps.agg(F.count(F.lit(1)).alias("n_steps"), F.sum(F.col("healthy").cast("int")).alias("good"), F.max(F.when(finite(F.col("courant_max")), F.col("courant_max"))).alias("courant_max"))
    of = of.withColumn("one", F.lit(1)).join(trend.select("degraded", F.lit(1).alias("one")), "one").withColumn("healthy_percent", F.when(F.col("n_steps") > 0, 100.0 * F.col("good") / F.greatest("n_steps", F.lit(1))))
    status = (
        F.when(failure.isNotNull(), "failing").when(~F.lit(configured), "not_configured").when(F.col("n_steps") < LEAST_STEPS, "insufficient_data")
        .when(F.col("healthy_percent") < 80, "failing").when(F.col("healthy_percent") < 95, "warning").when(F.col("degraded"), "warning").otherwise("passing")
    )
    return of.select("n_steps", "healthy_percent", "courant_max", "degraded", status.alias("status"))


def last_of_runs(rows: DataFrame, most: int) -> DataFrame:
    """(run, segment, simulation_time, back, n): the last most different times of each run, back 1 for the last; n: how many
    a run has. Ranks are limited within the tasks before they are shuffled."""
    times = rows.select("run", "segment", "simulation_time").distinct()
    n = times.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    back = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("segment"), F.desc("simulation_time")))
    return times.withColumn("back", back).where(F.col("back") <= most).join(n, "run")


def steady_verdicts(residuals: DataFrame, targets: DataFrame, runs: DataFrame, groups: int = LAST_GROUPS) -> DataFrame:
    """(run, targets, met, status) of each of runs (run, declared, failure), by residuals (run, segment, simulation_time,
    field, initial) and targets (run, pos, pattern, threshold): what target_checks and steady_verdict say of one run, for
    all in one plan. Patterns meet the different fields of their run. Times that still run are taken out before."""
    last = last_of_runs(residuals, groups)
    peaks = residuals.join(last, ["run", "segment", "simulation_time"]).groupBy("run", "field", "back").agg(F.max("initial").alias("most"), F.bool_and(finite(F.col("initial"))).alias("good"))
    matched = peaks.select("run", "field").distinct().join(targets, "run").withColumn("match", field_matches("pattern", "field"))
    hits = matched.where("match = 1").join(peaks, ["run", "field"]).groupBy("run", "pos").agg(F.max("most").alias("observed"), F.count_distinct("back").alias("met"), F.bool_and("good").alias("good"))
    bad = matched.groupBy("run", "pos").agg(F.bool_or(F.col("match").isNull()).alias("invalid"))
    checks = targets.join(hits, ["run", "pos"], "left").join(bad, ["run", "pos"], "left")
    passed = F.coalesce(F.col("met") == groups, F.lit(False)) & ~F.coalesce("invalid", F.lit(False)) & F.coalesce("good", F.lit(False)) & at_most(F.col("observed"), F.col("threshold"))
    of = checks.withColumn("passed", passed).groupBy("run").agg(F.count(F.lit(1)).alias("targets"), F.count_if("passed").alias("met"))
    out = runs.join(of, "run", "left").join(last.groupBy("run").agg(F.max("n").alias("n")), "run", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("targets", "met", "n")})
    status = F.when(F.col("failure").isNotNull(), "failing").when(F.coalesce("declared", F.lit(False)), "passing").when(F.col("targets") == 0, "not_configured").when(F.col("n") < groups, "insufficient_data")
    return out.select("run", "targets", "met", status.when(F.col("targets") == F.col("met"), "passing").otherwise("failing").alias("status"))


def transient_verdicts(steps: DataFrame, residuals: DataFrame, runs: DataFrame, most: int = LAST_STEPS) -> DataFrame:
    """(run, n_steps, healthy_percent, courant_max, degraded, status) of each of runs (run, limit, failure), limit null where
    none is configured: what healthy_steps, continuity_trend and transient_verdict say of one run, for all in one plan.
    After the last most steps of each run are found, a run is a few rows."""
    last = last_of_runs(steps, most).drop("n")
    unsolved = residuals.where("converged = false").select("run", "segment", "simulation_time").distinct().withColumn("unsolved", F.lit(True))
    good = at_most(F.col("courant_max"), F.col("limit"))
    for part in ("local", "global", "cumulative"):
        good = good & finite(F.col(f"continuity_{part}"))
    key = ["run", "segment", "simulation_time"]
    late = steps.join(last, key).join(unsolved, key, "left").join(runs.select("run", "limit"), "run").withColumn("healthy", good & F.col("unsolved").isNull())
    of = late.groupBy("run").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if("healthy").alias("good"), F.max(F.when(finite(F.col("courant_max")), F.col("courant_max"))).alias("courant_max"))
    errors = late.where(finite(F.col("continuity_global"))).select("run", F.abs("continuity_global").alias("e"), F.row_number().over(Window.partitionBy("run").orderBy(F.desc("back"))).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("run")).alias("m"))
    half = F.col("i") <= F.floor(F.col("m") / 2)
    trend = errors.groupBy("run").agg(F.median(F.when(half, F.col("e"))).alias("earlier"), F.median(F.when(~half, F.col("e"))).alias("later"))
    worse = (F.col("later") > DEGRADED * F.col("earlier")) & (F.col("later") - F.col("earlier") > NEGLIGIBLE)
    out = runs.join(of, "run", "left").join(trend, "run", "left").withColumns({"n_steps": F.coalesce("n_steps", F.lit(0)), "degraded": F.coalesce(worse, F.lit(False))})
    out = out.withColumn("healthy_percent", F.when(F.col("n_steps") > 0, 100.0 * F.col("good") / F.greatest("n_steps", F.lit(1))))
    status = (
        F.when(F.col("failure").isNotNull(), "failing").when(F.col("limit").isNull(), "not_configured").when(F.col("n_steps") < LEAST_STEPS, "insufficient_data")
        .when(F.col("healthy_percent") < 80, "failing").when((F.col("healthy_percent") < 95) | F.col("degraded"), "warning").otherwise("passing")
    )
    return out.select("run", "n_steps", "healthy_percent", "courant_max", "degraded", status.alias("status"))


def progress(rows: DataFrame) -> DataFrame:
    """(..., fraction, rate, eta_seconds) of rows (start, current, end, clock_time, execution_time): the fraction done, the
    simulated time a second of wall time, and the seconds left while there are some."""
    span = F.col("end") - F.col("start")
    fraction = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("current") - F.col("start")) / F.when(span > 0, span))))
    wall = F.coalesce(F.when(F.col("clock_time") > 0, F.col("clock_time")), F.col("execution_time"))
    rate = F.when(wall > 0, (F.col("current") - F.col("start")) / F.when(wall > 0, wall))
    out = rows.withColumn("fraction", fraction).withColumn("rate", rate)
    return out.withColumn("eta_seconds", F.when((F.col("current") < F.col("end")) & (F.col("rate") > 0), (F.col("end") - F.col("current")) / F.when(F.col("rate") > 0, F.col("rate"))))
