"""The state of each series: evolving, plateau, statistically_stationary, periodic or indeterminate, and verdicts over them."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.functions.columns import at_most, finite, ratio
from runsight.operators import series as S

STATES = ("evolving", "plateau", "statistically_stationary", "periodic", "indeterminate")
ACCEPTED = ("plateau", "statistically_stationary", "periodic")
#: Below this variation a stable series counts as a plateau.
FLAT = 0.01


@dataclasses.dataclass(frozen=True)
class Settings:
    minimum_effective_samples: float = 20.0
    max_mean_shift_fraction: float = 0.02
    max_mean_shift_standard_errors: float = 2.0
    max_normalized_slope: float = 0.02
    minimum_cycles: int = 3
    max_period_variation_fraction: float = 0.05
    max_amplitude_variation_fraction: float = 0.10
    absolute_floor: float = 1e-12
    stale_after_seconds: float = 120.0


NAMES = [f.name for f in dataclasses.fields(Settings)]


def effective_settings(ids: DataFrame, overrides: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """(series_id, each setting): an override's value where it isn't null, else the default. overrides: (series_id, some settings)."""
    defaults = {n: F.lit(getattr(settings, n)) for n in NAMES}
    if overrides is None:
        return ids.select("series_id", *[v.alias(n) for n, v in defaults.items()])
    has = set(overrides.columns)
    return ids.join(overrides, "series_id", "left").select("series_id", *[(F.coalesce(overrides[n], v) if n in has else v).alias(n) for n, v in defaults.items()])


def slope_of(t: np.ndarray, v: np.ndarray) -> float:
    d = t - t.mean()
    square = float(d @ d)
    return float(d @ (v - v.mean())) / square if square else 0.0


def correlations(x: np.ndarray, lags: int, variance: float) -> np.ndarray:
    """Mean products at distances 0 to lags over the variance."""
    n = len(x)
    return np.correlate(x, x, "full")[n - 1 : n + lags] / (n - np.arange(lags + 1)) / variance


def decorrelation(t: np.ndarray, v: np.ndarray) -> float:
    """The integrated autocorrelation time, in samples, of what a straight line leaves of v."""
    r = v - v.mean() - slope_of(t, v) * (t - t.mean())
    if np.abs(r).max() <= max(np.abs(v).max(), 1.0) * 1e-14:
        return 1.0
    x = r - r.mean()
    variance = float(x @ x) / len(x)
    if variance == 0:
        return 1.0
    c = correlations(x, min(S.MOST_LAGS, len(x) - 1), variance)[1:]
    sums = np.add.reduceat(c, np.arange(0, len(c), 2))
    stop = np.flatnonzero(sums <= 0)
    return max(1.0, 1.0 + 2.0 * float(sums[: stop[0] if len(stop) else len(sums)].sum()))


def variation(x: np.ndarray) -> float | None:
    if not len(x):
        return None
    mean = float(x.mean())
    if mean == 0:
        return None if x.any() else 0.0
    return float(x.std()) / abs(mean)


@dataclasses.dataclass(frozen=True)
class Cycle:
    """What a period of so many samples gives: period in time, complete cycles, and how period, amplitude and mean vary."""

    period: float | None = None
    count: int = 0
    of_period: float | None = None
    of_amplitude: float | None = None
    of_mean: float | None = None
    drift: float = 0.0

    def steady(self, s: Settings) -> tuple[bool, bool, bool]:
        ok = [x is not None and math.isfinite(x) and x <= limit for x, limit in ((self.of_period, s.max_period_variation_fraction), (self.of_amplitude, s.max_amplitude_variation_fraction), (self.of_mean, s.max_mean_shift_fraction))]
        return ok[0], ok[1], ok[2]

    def there(self, s: Settings) -> bool:
        return self.period is not None and self.count >= s.minimum_cycles


def cycle_of(t: np.ndarray, v: np.ndarray, lag: int, s: Settings) -> Cycle:
    count = len(v) // lag
    if count < s.minimum_cycles:
        return Cycle(count=count)
    ts, vs = (x[len(x) - count * lag :].reshape(count, lag) for x in (t, v))
    most = vs.max(axis=1, keepdims=True)
    top = most - vs <= np.maximum(np.abs(most), 1.0) * 1e-12
    gaps = np.diff((ts * top).sum(axis=1) / top.sum(axis=1))
    means = vs.mean(axis=1)
    of_mean = float(np.ptp(means)) / max(abs(float(means.mean())), float(means.std()), s.absolute_floor)
    period = float(gaps.mean()) if len(gaps) else lag * float(np.median(np.diff(t)))
    drift = abs(slope_of(np.arange(len(gaps), dtype=float), gaps)) * (len(gaps) - 1) / abs(period) if len(gaps) > 1 and period else 0.0
    return Cycle(period, count, variation(gaps), variation(np.ptp(vs, axis=1)), of_mean, drift)


def cycle_in(t: np.ndarray, v: np.ndarray, s: Settings) -> Cycle:
    """The first peak of the autocorrelation that gives a steady cycle, else the first peak; none if only its period is
    unsteady and doesn't drift in one direction."""
    n = len(v)
    if n < 2 * s.minimum_cycles:
        return Cycle()
    r = v - v.mean() - slope_of(t, v) * (t - t.mean())
    variance = float(r @ r) / n
    if not 0 < variance < math.inf:
        return Cycle()
    c = correlations(r, n // 2, variance)
    c[0] = 0.0
    at = np.arange(2, len(c) - 1)
    at = at[(c[at] > 0.5) & (c[at] >= c[at - 1]) & (c[at] >= c[at + 1])]
    if not len(at):
        return Cycle()
    first = None
    for lag in at:
        found = cycle_of(t, v, int(lag), s)
        if found.there(s) and all(found.steady(s)):
            return found
        first = first or found
    if first.there(s) and first.steady(s) == (False, True, True) and not first.drift > s.max_period_variation_fraction:
        return Cycle()
    return first


def cycle_between(overview: Cycle, recent: Cycle, s: Settings) -> Cycle:
    """Recent samples win over the overview if that has no steady cycle, or both agree, or a related one has begun to change."""
    if recent.period is None:
        return overview
    if not (overview.there(s) and all(overview.steady(s))):
        return recent
    if abs(recent.period - overview.period) / max(abs(recent.period), abs(overview.period), 1.0) <= 0.05:
        return recent
    changing = recent.there(s) and not all(recent.steady(s))
    return recent if changing and 0.5 <= recent.period / overview.period <= 2.0 else overview


KERNEL = "series_id string, earlier_tau double, latest_tau double, period double, complete_cycles int, period_variation double, amplitude_variation double, cycle_mean_variation double"


def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """The views of one series, at most 2 * MOST_SAMPLES rows, to KERNEL."""
    pdf = pdf.sort_values("i")
    s = Settings(**{n: pdf[n].iloc[0] for n in NAMES})
    n = int(pdf["n"].iloc[0])
    views = [(pdf.loc[pdf[c], "t"].to_numpy(), pdf.loc[pdf[c], "v"].to_numpy()) for c in ("in_overview", "in_horizon")]
    t, v = views[0]
    w, raw = len(v) // 2, n // 2
    taus = (np.nan, np.nan)
    if w:
        taus = tuple(min(float(S.MOST_LAGS), decorrelation(t[part], v[part]) * raw / w) for part in (slice(0, w), slice(len(v) - w, None)))
    overview = cycle_in(t, v, s)
    found = overview if n <= S.MOST_SAMPLES else cycle_between(overview, cycle_in(*views[1], s), s)
    row = (pdf["series_id"].iloc[0], *taus, found.period, found.count, found.of_period, found.of_amplitude, found.of_mean)
    return pd.DataFrame([row], columns=[c.split()[0] for c in KERNEL.split(", ")]).astype({c: "float64" for c in ("period", "period_variation", "amplitude_variation", "cycle_mean_variation")})


def views(segment: DataFrame) -> DataFrame:
    """The rows of a segment that are in the overview, the horizon or both; at most 2 * MOST_SAMPLES a series."""
    k = F.ceil(F.col("i") * (S.MOST_SAMPLES - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    spaced = F.floor(k * (F.col("n") - 1) / (S.MOST_SAMPLES - 1)) == F.col("i")
    short = F.col("n") <= S.MOST_SAMPLES
    return segment.withColumns({"in_overview": short | spaced, "in_horizon": short | (F.col("i") >= F.col("n") - S.MOST_SAMPLES)}).where("in_overview OR in_horizon")


def evidence(points: DataFrame, settings: DataFrame) -> DataFrame:
    """A row of evidence for each series of (series_id, t, v) without duplicates; settings: effective_settings().

    Means, deviations and slopes come from the windows of the last MOST_SAMPLES samples; autocorrelation times and
    standard errors from the whole segment, evenly sampled, and its half length. The grouped kernel gets only views.
    """
    segment = S.latest_segment(points)
    size = segment.groupBy("series_id").agg(F.first("n").alias("segment_samples"), F.first("raw_samples").alias("raw_samples"))
    moments = S.shift_and_slope(segment, 0.0).drop("mean_shift", "normalized_slope", "variation", "scale")
    line = S.window_moments(segment).where("half = 1").select("series_id", "slope", "duration")
    of_kernel = views(segment).join(settings, "series_id").groupBy("series_id").applyInPandas(kernel, KERNEL)
    e = size.join(moments, "series_id", "left").join(line, "series_id", "left").join(of_kernel, "series_id", "left").join(settings, "series_id")
    raw = F.floor(F.col("segment_samples") / 2)
    w = F.coalesce(F.col("window_samples"), F.lit(0)).cast("long")
    enough = w >= S.LEAST_WINDOW
    scale = F.greatest(F.abs("latest_mean"), "latest_std", "absolute_floor")
    shift = F.abs(F.col("latest_mean") - F.col("earlier_mean"))
    error = {h: F.col(f"{h}_std") * F.sqrt(F.col(f"{h}_tau") / F.greatest(raw, F.lit(1))) for h in ("earlier", "latest")}
    both = F.sqrt(error["latest"] * error["latest"] + error["earlier"] * error["earlier"])

    def when(x: Column) -> Column:
        return F.when(enough, x)

    return e.select(
        "series_id", "raw_samples", "segment_samples", w.alias("window_samples"), (F.col("segment_samples") < F.col("raw_samples")).alias("discontinuous"),
        when(F.col("earlier_mean")).alias("earlier_mean"), when(F.col("latest_mean")).alias("latest_mean"), when(F.col("latest_std")).alias("latest_std"),
        when(F.col("latest_std") / scale).alias("coefficient_of_variation"), when(shift / scale).alias("normalized_mean_shift"),
        when(F.abs("slope") * F.col("duration") / scale).alias("normalized_slope"),
        F.coalesce(when(F.col("latest_tau")), F.lit(1.0)).alias("autocorrelation_time"),
        F.when(enough, raw / F.col("latest_tau")).otherwise(w.cast("double")).alias("effective_samples"),
        when(error["latest"]).alias("standard_error"), when(ratio(shift, both)).alias("mean_shift_standard_errors"),
        when(F.col("period")).alias("period"), F.coalesce(when(F.col("complete_cycles")), F.lit(0)).alias("complete_cycles"),
        *[when(F.when(finite(F.col(c)), F.col(c))).alias(c) for c in ("period_variation", "amplitude_variation", "cycle_mean_variation")],
        *NAMES,
    )


def state_of(stale: Column) -> Column:
    """The state by a row of evidence() and whether the series is stale."""
    lacking = stale | (F.col("window_samples") < S.LEAST_WINDOW) | (F.col("effective_samples") < F.col("minimum_effective_samples"))
    cycle = F.col("period").isNotNull() & (F.col("complete_cycles") >= F.col("minimum_cycles"))
    steady = at_most(F.col("period_variation"), F.col("max_period_variation_fraction")) & at_most(F.col("amplitude_variation"), F.col("max_amplitude_variation_fraction")) & at_most(F.col("cycle_mean_variation"), F.col("max_mean_shift_fraction"))
    calm = at_most(F.col("normalized_mean_shift"), F.col("max_mean_shift_fraction")) & at_most(F.col("normalized_slope"), F.col("max_normalized_slope")) & at_most(F.col("mean_shift_standard_errors"), F.col("max_mean_shift_standard_errors"))
    return (
        F.when(lacking, "indeterminate")
        .when(cycle & steady, "periodic")
        .when(cycle, "evolving")
        .when(calm & at_most(F.col("coefficient_of_variation"), F.lit(FLAT)), "plateau")
        .when(calm & finite(F.col("coefficient_of_variation")), "statistically_stationary")
        .otherwise("evolving")
    )


def classify(points: DataFrame, *, settings: Settings = Settings(), overrides: DataFrame | None = None, ages: DataFrame | None = None) -> DataFrame:
    """evidence() with state and stale. points: (series_id, t, v, pos); ages: (series_id, age_seconds[, stale]), without
    them no series is stale. A series without a finite sample has no row."""
    clean = S.dedup_latest(points)
    found = evidence(clean, effective_settings(clean.select("series_id").distinct(), overrides, settings))
    if ages is not None:
        said = F.coalesce(ages["stale"], F.lit(False)) if "stale" in ages.columns else F.lit(False)
        found = found.join(ages.select("series_id", "age_seconds", said.alias("said")), "series_id", "left")
        stale = F.coalesce(F.col("said") | (F.col("age_seconds") > F.col("stale_after_seconds")), F.lit(False))
    else:
        stale = F.lit(False)
    found = found.withColumn("stale", stale)
    return found.withColumn("state", state_of(F.col("stale"))).drop("said", "age_seconds")


def _verdict_of(known: DataFrame, accepted: tuple[str, ...], by: list[str]) -> DataFrame:
    kinds = {
        "missing": F.col("state").isNull(),
        "indeterminate": F.col("state") == "indeterminate",
        "rejected": (F.col("state") != "indeterminate") & ~F.col("state").isin(*accepted),
    }
    ids = [F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "series_id")))), lambda x: x["series_id"]).alias(f"{k}_ids") for k, c in kinds.items()]
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_selected"), *ids)
    lacking = (F.col("n_selected") == 0) | (F.size("missing_ids") > 0) | (F.size("indeterminate_ids") > 0)
    return out.withColumn("state", F.when(lacking, "indeterminate").when(F.size("rejected_ids") > 0, "failing").otherwise("passing"))


def aggregate_verdict(selected: DataFrame, states: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """One row over the selected (pos, series_id) and (series_id, state): state, and the ids missing, indeterminate and
    rejected in order of selection. Nothing selected, anything missing or indeterminate is indeterminate."""
    once = selected.groupBy("series_id").agg(F.min("pos").alias("pos"))
    return _verdict_of(once.join(states.select("series_id", "state"), "series_id", "left"), accepted, [])


def case_verdicts(selected: DataFrame, states: DataFrame, cases: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """aggregate_verdict() of each of cases (case), over selected (case, pos, series_id), in one plan; a selection is bounded
    by its configuration. A case that selects nothing is indeterminate."""
    once = selected.groupBy("case", "series_id").agg(F.min("pos").alias("pos"))
    of = _verdict_of(once.join(states.select("series_id", "state"), "series_id", "left"), accepted, ["case"])
    none = F.array().cast("array<string>")
    return cases.join(of, "case", "left").select("case", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), *[F.coalesce(f"{k}_ids", none).alias(f"{k}_ids") for k in ("missing", "indeterminate", "rejected")], F.coalesce("state", F.lit("indeterminate")).alias("state"))
