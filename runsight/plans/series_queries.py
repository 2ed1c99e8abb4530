"""Queries over series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions.columns import series_id
from runsight.operators import series as S
from runsight.operators import stationarity as St
from runsight.plans.registry import query
from runsight.sources import fixtures as fx

# SQL of the series that the queries start from.
SHIP = "ship AS (SELECT 'ship' AS series_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"
FLAG = "flag AS (SELECT 'flag_' || l_returnflag AS series_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"
HOUR = "hour AS (SELECT 'hour' AS series_id, floor(epoch_us(ts) / 3600000000) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS v FROM events GROUP BY ALL)"
RAW = "raw AS (SELECT 'raw_' || event_type AS series_id, CAST(epoch_us(ts) AS DOUBLE) AS t, value AS v, event_id AS pos FROM events)"


def segment(name: str) -> str:
    """SQL: the latest segment of a series table, with i, n and raw_samples, under the name seg."""
    return f"""gap AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM {name}),
typical AS (SELECT series_id, median(CASE WHEN gap > 0 THEN gap END) AS typical, count(*) AS raw_samples FROM gap GROUP BY series_id),
begin_at AS (SELECT series_id, max(CASE WHEN gap > 5 * typical THEN t END) AS b, any_value(raw_samples) AS raw_samples FROM gap JOIN typical USING (series_id) GROUP BY series_id),
seg AS (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, raw_samples
  FROM {name} JOIN begin_at USING (series_id) WHERE b IS NULL OR t >= b)"""


WINDOWS = """win AS (SELECT *, CASE WHEN n - i <= w THEN 1 ELSE 0 END AS half FROM (SELECT *, least(n, 2048) // 2 AS w FROM seg) WHERE n - i <= 2 * w),
moments AS (SELECT series_id, half, CAST(any_value(w) AS BIGINT) AS w, avg(v) AS mean, stddev_pop(v) AS std, coalesce(regr_slope(v, t), 0) AS slope, max(t) - min(t) AS duration FROM win GROUP BY ALL)"""


def sized(points: DataFrame) -> DataFrame:
    return S.latest_segment(points)


def digits(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles that hang on the order of sums, rounded."""
    return df.withColumns({n: F.round(n, places) for n in names})


@query("series_daily", f"WITH {FLAG} SELECT series_id, t, v FROM flag")
def series_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ship_series(spark, sf_dir, by_flag=True).select("series_id", "t", "v")


@query("series_hourly", f"WITH {HOUR} SELECT series_id, t, round(v, 6) AS v FROM hour")
def series_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(fx.hour_series(spark, sf_dir).select("series_id", "t", "v"), "v")


@query("series_identity", "SELECT DISTINCT l_returnflag, substr(sha256('daily|sum|' || l_returnflag || '|price|||lineitem'), 1, 20) AS series_id FROM lineitem")
def series_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = fx.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    none = F.lit(None).cast("string")
    return flags.select("l_returnflag", series_id(F.lit("daily"), F.lit("sum"), F.col("l_returnflag"), F.lit("price"), none, none, F.lit("lineitem")).alias("series_id"))


DIRTY = f"""{RAW}, dirty AS (SELECT series_id, t, v, pos FROM raw UNION ALL SELECT series_id, t, v + 1, pos + 1000000000 FROM raw WHERE pos % 7 = 0
  UNION ALL SELECT series_id, t, CAST('nan' AS DOUBLE), pos + 2000000000 FROM raw WHERE pos % 11 = 0 UNION ALL SELECT series_id, NULL, v, pos FROM raw WHERE pos % 13 = 0)"""


@query("dedup_latest", f"WITH {DIRTY} SELECT series_id, t, round(arg_max(v, pos), 6) AS v FROM dirty WHERE isfinite(t) AND isfinite(v) GROUP BY series_id, t")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_series(spark, sf_dir)
    again = raw.where("pos % 7 = 0").selectExpr("series_id", "t", "v + 1 AS v", "pos + 1000000000 AS pos")
    bad = raw.where("pos % 11 = 0").selectExpr("series_id", "t", "double('nan') AS v", "pos + 2000000000 AS pos")
    lost = raw.where("pos % 13 = 0").selectExpr("series_id", "CAST(NULL AS DOUBLE) AS t", "v", "pos")
    return digits(S.dedup_latest(raw.unionByName(again).unionByName(bad).unionByName(lost)), "v")


@query("restart_upsert", f"""WITH {RAW}, files AS (SELECT series_id, t, v, pos AS row_no, 0.0 AS start, '0/a' AS path FROM raw WHERE pos % 3 < 2 UNION ALL SELECT series_id, t, v * 2, pos, 1.0, '1/a' FROM raw WHERE pos % 3 > 0)
SELECT series_id, t, round(arg_max(v, {{'s': start, 'p': path, 'r': row_no}}), 6) AS v FROM files GROUP BY series_id, t""")
def restart_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_series(spark, sf_dir)
    old = raw.where("pos % 3 < 2").selectExpr("series_id", "t", "v", "pos AS row_no", "0D AS start", "'0/a' AS path")
    new = raw.where("pos % 3 > 0").selectExpr("series_id", "t", "v * 2 AS v", "pos AS row_no", "1D AS start", "'1/a' AS path")
    return digits(S.restart_upsert(old.unionByName(new)), "v")


@query("gap_stats", f"WITH {RAW}, gap AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM raw) SELECT series_id, count(*) AS n, median(CASE WHEN gap > 0 THEN gap END) AS median_gap, max(CASE WHEN gap > 0 THEN gap END) AS largest_gap FROM gap GROUP BY series_id")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_stats(fx.raw_series(spark, sf_dir))


@query("latest_segment", f"WITH {RAW}, {segment('raw')} SELECT series_id, t, v, i, n, raw_samples FROM seg")
def latest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_segment(fx.raw_series(spark, sf_dir)).select("series_id", "t", "v", F.col("i").cast("long").alias("i"), "n", "raw_samples")


@query("analysis_horizon", f"WITH {SHIP}, {segment('ship')} SELECT series_id, t, v FROM seg WHERE i >= n - 2048")
def analysis_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.horizon(sized(fx.ship_series(spark, sf_dir))).select("series_id", "t", "v")


@query("analysis_overview", f"WITH {SHIP}, {segment('ship')} SELECT series_id, t, v FROM seg WHERE n <= 2048 OR i IN (SELECT k * ((SELECT max(n) FROM seg) - 1) // 2047 FROM range(2048) x(k))")
def analysis_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overview(sized(fx.ship_series(spark, sf_dir))).select("series_id", "t", "v")


@query("window_moments", f"WITH {FLAG}, {segment('flag')}, {WINDOWS} SELECT series_id, half, w, round(mean, 3) AS mean, round(std, 3) AS std, round(slope, 3) AS slope, duration FROM moments")
def window_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(S.window_moments(sized(fx.ship_series(spark, sf_dir, by_flag=True))).withColumn("w", F.col("w").cast("long")), "mean", "std", "slope", places=3)


SHIFT = """shifted AS (SELECT a.series_id, b.w AS window_samples, a.mean AS m0, b.mean AS m1, a.std AS s0, b.std AS s1, b.slope, b.duration, greatest(abs(b.mean), b.std, 1e-12) AS scale
  FROM moments a JOIN moments b ON a.series_id = b.series_id AND a.half = 0 AND b.half = 1)"""


@query("window_shift_slope", f"WITH {FLAG}, {segment('flag')}, {WINDOWS}, {SHIFT} SELECT series_id, window_samples, round(abs(m1 - m0) / scale, 6) AS mean_shift, round(abs(slope) * duration / scale, 6) AS normalized_slope, round(s1 / scale, 6) AS variation FROM shifted")
def window_shift_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = S.shift_and_slope(sized(fx.ship_series(spark, sf_dir, by_flag=True)))
    return digits(of.select("series_id", F.col("window_samples").cast("long").alias("window_samples"), "mean_shift", "normalized_slope", "variation"), "mean_shift", "normalized_slope", "variation")


REST = """line AS (SELECT series_id, coalesce(regr_slope(v, t), 0) AS slope, avg(t) AS mt, avg(v) AS mv FROM seg GROUP BY series_id),
rest AS (SELECT series_id, i, t, v - mv - slope * (t - mt) AS r FROM seg JOIN line USING (series_id))"""
ACF = """variance AS (SELECT series_id, avg(r * r) AS s2 FROM rest GROUP BY series_id),
acf AS (SELECT a.series_id, b.i - a.i AS lag, avg(a.r * b.r) / any_value(s2) AS c FROM rest a JOIN rest b ON a.series_id = b.series_id AND b.i > a.i AND b.i - a.i <= {lags} JOIN variance ON variance.series_id = a.series_id GROUP BY ALL)"""


@query("detrend_residuals", f"WITH {HOUR}, {segment('hour')}, {REST} SELECT series_id, t, round(r, 4) AS r FROM rest")
def detrend_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(S.detrended(sized(fx.hour_series(spark, sf_dir))).select("series_id", "t", "r"), "r", places=4)


@query("autocorrelation", f"WITH {HOUR}, {segment('hour')}, {REST}, {ACF.format(lags=50)} SELECT series_id, lag, round(c, 6) AS c FROM acf")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(S.autocorrelation(S.detrended(sized(fx.hour_series(spark, sf_dir))), 50).withColumn("lag", F.col("lag").cast("long")), "c")


@query("autocorr_time", f"""WITH {FLAG}, {segment('flag')}, {REST}, {ACF.format(lags=200)},
pairs AS (SELECT series_id, (lag - 1) // 2 AS pair, sum(c) AS s FROM acf GROUP BY ALL),
going AS (SELECT *, min(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pair) AS g FROM pairs)
SELECT series_id, round(greatest(1, 1 + 2 * sum(CASE WHEN g = 1 THEN s ELSE 0 END)), 6) AS tau FROM going GROUP BY series_id""")
def autocorr_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(S.autocorrelation_time(S.autocorrelation(S.detrended(sized(fx.ship_series(spark, sf_dir, by_flag=True))), S.MOST_LAGS)), "tau")


WAVE = f"{HOUR}, wave AS (SELECT 'wave' AS series_id, t, v + 3000 * abs(CAST(t AS BIGINT) % 24 - 12) AS v FROM hour)"


@query("acf_peaks", f"""WITH {WAVE}, {segment('wave')}, {REST}, {ACF.format(lags=200)}, near AS (SELECT *, lag(c) OVER (PARTITION BY series_id ORDER BY lag) AS a, lead(c) OVER (PARTITION BY series_id ORDER BY lag) AS b FROM acf)
SELECT series_id, lag, round(c, 6) AS c FROM near WHERE lag >= 2 AND c > 0.5 AND c >= a AND c >= b""")
def acf_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours' means with a daily wave: peaks at days."""
    hours = fx.hour_series(spark, sf_dir)
    wave = hours.select(F.lit("wave").alias("series_id"), "t", (F.col("v") + 3000 * F.abs(F.col("t").cast("long") % 24 - 12)).alias("v"))
    return digits(S.peaks(S.autocorrelation(S.detrended(sized(wave)), 200)).withColumn("lag", F.col("lag").cast("long")), "c")


CYCLES = """cyc AS (SELECT *, max(v) OVER (PARTITION BY series_id, cycle) AS most FROM (SELECT *, (i - (n - n // 37 * 37)) // 37 AS cycle FROM seg WHERE i >= n - n // 37 * 37)),
of_cycle AS (SELECT series_id, CAST(cycle AS BIGINT) AS cycle, max(v) - min(v) AS amplitude, avg(v) AS mean, avg(CASE WHEN most - v <= greatest(abs(most), 1) * 1e-12 THEN t END) AS peak_t FROM cyc GROUP BY ALL)"""


@query("cycle_stats", f"WITH {FLAG}, {segment('flag')}, {CYCLES} SELECT series_id, cycle, amplitude, round(mean, 3) AS mean, peak_t FROM of_cycle")
def cycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(S.cycles(sized(fx.ship_series(spark, sf_dir, by_flag=True)), 37).withColumn("cycle", F.col("cycle").cast("long")), "mean", places=3)


@query("cycle_periods", f"WITH {FLAG}, {segment('flag')}, {CYCLES} SELECT series_id, cycle, period FROM (SELECT series_id, cycle, peak_t - lag(peak_t) OVER (PARTITION BY series_id ORDER BY cycle) AS period FROM of_cycle) WHERE period IS NOT NULL")
def cycle_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cycle_periods(S.cycles(sized(fx.ship_series(spark, sf_dir, by_flag=True)), 37).withColumn("cycle", F.col("cycle").cast("long")))


def envelope_sql(limit: int) -> str:
    room = limit - 2
    half = room // 2
    return f"""WITH {SHIP}, {segment('ship')},
ends AS (SELECT series_id, arg_min(v, i) AS v0, arg_max(v, i) AS v1 FROM seg GROUP BY series_id),
placed AS (SELECT seg.*, v0, v1, CASE WHEN n > {limit} AND i BETWEEN 1 AND n - 2 THEN (i * {half} - 1) // (n - 2) END AS b FROM seg JOIN ends USING (series_id)),
ranked AS (SELECT *, b IS NOT NULL AND (row_number() OVER (PARTITION BY series_id, b ORDER BY v, i) = 1 OR row_number() OVER (PARTITION BY series_id, b ORDER BY v DESC, i) = 1) AS extreme FROM placed),
marked AS (SELECT *, n <= {limit} OR i = 0 OR i = n - 1 OR extreme AS kept FROM ranked),
far AS (SELECT *, row_number() OVER (PARTITION BY series_id, kept ORDER BY abs(v - (v0 + (v1 - v0) * i / (n - 1))) DESC, i) AS rank, count(*) FILTER (kept) OVER (PARTITION BY series_id) AS have FROM marked)
SELECT series_id, t, v FROM far WHERE kept OR rank <= {limit} - have"""


@query("envelope_minmax", envelope_sql(300))
def envelope_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.envelope(sized(fx.ship_series(spark, sf_dir)), 300).select("series_id", "t", "v")


@query("envelope_fill", envelope_sql(2001))
def envelope_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.envelope(sized(fx.ship_series(spark, sf_dir)), 2001).select("series_id", "t", "v")


@query("series_state", None)
def series_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series have settled: all evidence and the state of daily, hourly, raw and made series."""
    points = fx.ship_series(spark, sf_dir, by_flag=True)
    for more in (fx.ship_series(spark, sf_dir), fx.hour_series(spark, sf_dir), fx.raw_series(spark, sf_dir), fx.made_series(spark)):
        points = points.unionByName(more)
    return St.classify(points)


STATES_SQL = "states AS (SELECT * FROM (VALUES ('a', 'plateau'), ('b', 'periodic'), ('c', 'evolving'), ('d', 'indeterminate')) x(series_id, state))"


@query("aggregate_verdict", f"""WITH {STATES_SQL}, chosen AS (SELECT DISTINCT n_regionkey AS "case", chr(97 + CAST(n_nationkey % (n_regionkey + 2) AS INT)) AS series_id FROM nation WHERE n_regionkey <> 3),
known AS (SELECT "case", chosen.series_id, state FROM chosen LEFT JOIN states USING (series_id)),
of AS (SELECT "case", count(*) AS n, string_agg(series_id, ',' ORDER BY series_id) FILTER (state IS NULL) AS missing, string_agg(series_id, ',' ORDER BY series_id) FILTER (state = 'indeterminate') AS indeterminate, string_agg(series_id, ',' ORDER BY series_id) FILTER (state = 'evolving') AS rejected FROM known GROUP BY "case")
SELECT r_regionkey AS "case", coalesce(n, 0) AS n_selected, coalesce(missing, '') AS missing, coalesce(indeterminate, '') AS indeterminate, coalesce(rejected, '') AS rejected, CASE WHEN n IS NULL OR missing IS NOT NULL OR indeterminate IS NOT NULL THEN 'indeterminate' WHEN rejected IS NOT NULL THEN 'failing' ELSE 'passing' END AS state
FROM region LEFT JOIN of ON "case" = r_regionkey""")
def aggregate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as cases, which select series by their nations; one region selects none."""
    states = spark.createDataFrame([("a", "plateau"), ("b", "periodic"), ("c", "evolving"), ("d", "indeterminate")], "series_id string, state string")
    series = F.expr("CASE WHEN n_regionkey <> 3 THEN chr(97 + n_nationkey % (n_regionkey + 2)) END")
    chosen = fx.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("case"), series.alias("series_id"), F.ascii(series).alias("pos")).where("series_id IS NOT NULL")
    cases = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("case"))
    return St.case_verdicts(chosen, states, cases).select("case", "n_selected", *[F.array_join(f"{k}_ids", ",").alias(k) for k in ("missing", "indeterminate", "rejected")], "state")


@query("override_settings", f"""WITH {FLAG}, ids AS (SELECT DISTINCT series_id FROM flag), o AS (SELECT * FROM (VALUES ('flag_A', 0.5, NULL), ('flag_N', NULL, 5)) x(series_id, shift, cycles))
SELECT series_id, CAST(coalesce(shift, 0.02) AS DOUBLE) AS max_mean_shift_fraction, CAST(coalesce(cycles, 3) AS INT) AS minimum_cycles, CAST(0.02 AS DOUBLE) AS max_normalized_slope FROM ids LEFT JOIN o USING (series_id)""")
def override_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.ship_series(spark, sf_dir, by_flag=True).select("series_id").distinct()
    overrides = spark.createDataFrame([("flag_A", 0.5, None), ("flag_N", None, 5)], "series_id string, max_mean_shift_fraction double, minimum_cycles int")
    return St.effective_settings(ids, overrides).select("series_id", "max_mean_shift_fraction", "minimum_cycles", "max_normalized_slope")


@query("effective_samples", f"""WITH {FLAG}, {segment('flag')}, {WINDOWS}, {SHIFT},
ov AS (SELECT series_id, t, v, n, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY series_id) AS m FROM seg WHERE n <= 2048 OR (i * 2047 + n - 2) // (n - 1) * (n - 1) // 2047 = i),
halves AS (SELECT series_id, h, t, v, j, n, m // 2 AS w FROM ov, (VALUES (0), (1)) x(h) WHERE CASE h WHEN 0 THEN j < m // 2 ELSE j >= m - m // 2 END),
line AS (SELECT series_id, h, coalesce(regr_slope(v, t), 0) AS slope, avg(t) AS mt, avg(v) AS mv, max(abs(v)) AS most FROM halves GROUP BY ALL),
rest AS (SELECT series_id, h, j, v - mv - slope * (t - mt) AS r, most FROM halves JOIN line USING (series_id, h)),
centred AS (SELECT series_id, h, j, r - avg(r) OVER (PARTITION BY series_id, h) AS x FROM rest), variance AS (SELECT series_id, h, avg(x * x) AS s2, count(*) AS k FROM centred GROUP BY ALL),
acf AS (SELECT a.series_id, a.h, b.j - a.j AS lag, avg(a.x * b.x) / any_value(s2) AS c FROM centred a JOIN centred b ON a.series_id = b.series_id AND a.h = b.h AND b.j > a.j AND b.j - a.j <= 200 JOIN variance ON variance.series_id = a.series_id AND variance.h = a.h GROUP BY ALL),
pairs AS (SELECT series_id, h, (lag - 1) // 2 AS pair, sum(c) AS s FROM acf GROUP BY ALL), going AS (SELECT *, min(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, h ORDER BY pair) AS g FROM pairs),
raw_tau AS (SELECT series_id, h, greatest(1, 1 + 2 * sum(CASE WHEN g = 1 THEN s ELSE 0 END)) AS tau FROM going GROUP BY ALL),
tau AS (SELECT series_id, h, n // 2 AS half_n, least(200, any_value(tau) * (n // 2) / any_value(w)) AS tau FROM halves JOIN raw_tau USING (series_id, h) GROUP BY series_id, h, n),
errors AS (SELECT shifted.series_id, window_samples, m0, m1, s1, b.tau, b.half_n, s1 * sqrt(b.tau / b.half_n) AS e1, s0 * sqrt(a.tau / a.half_n) AS e0 FROM shifted JOIN tau a ON a.series_id = shifted.series_id AND a.h = 0 JOIN tau b ON b.series_id = shifted.series_id AND b.h = 1)
SELECT series_id, CAST(window_samples AS BIGINT) AS window_samples, round(tau, 6) AS autocorrelation_time, round(half_n / tau, 4) AS effective_samples, round(e1, 2) AS standard_error, round(abs(m1 - m0) / sqrt(e1 * e1 + e0 * e0), 6) AS mean_shift_standard_errors FROM errors""")
def effective_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent samples in the latest window, by the autocorrelation time of the whole segment."""
    found = St.classify(fx.ship_series(spark, sf_dir, by_flag=True))
    return found.select(
        "series_id", "window_samples", F.round("autocorrelation_time", 6).alias("autocorrelation_time"), F.round("effective_samples", 4).alias("effective_samples"),
        F.round("standard_error", 2).alias("standard_error"), F.round("mean_shift_standard_errors", 6).alias("mean_shift_standard_errors"),
    )
