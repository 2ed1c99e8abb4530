"""Series of (series_id, t, v): merging, segments, windows and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.columns import finite
from runsight.functions.staging import staged
from runsight.operators.ranks import exact_median, numbered

#: Most samples of a view, and the longest lag of an autocorrelation time.
MOST_SAMPLES, MOST_LAGS = 2048, 200
#: Samples of a block of lag products.
BLOCK = 4096
#: Fewest samples of a window.
LEAST_WINDOW = 30
#: A gap of more than so many median gaps begins a new segment.
GAP_FACTOR = 5.0


def dedup_latest(points: DataFrame) -> DataFrame:
    """(series_id, t, v): of (series_id, t, v, pos) with finite t and v the one of largest pos for each t. Null or
    non-finite samples go; the aggregation combines in the map tasks, so a hot series is no burden."""
    good = points.where(finite(F.col("t")) & finite(F.col("v")))
    return good.groupBy("series_id", "t").agg(F.max_by("v", "pos").alias("v"))


def restart_upsert(rows: DataFrame) -> DataFrame:
    """(series_id, t, v): rows of (series_id, start, path, row_no, t, v) by time, the file that started last wins, of
    one file the later row. Samples behind a restart that it doesn't write again survive."""
    return rows.groupBy("series_id", "t").agg(F.max_by("v", F.struct("start", "path", "row_no")).alias("v"))


def points_of(rows: DataFrame, times: str = "times", values: str = "values") -> DataFrame:
    """(series_id, t, v, pos) of rows (series_id, times, values): the arrays place by place, as far as the shorter one goes."""
    both = F.least(F.size(times), F.size(values))
    pairs = F.arrays_zip(F.slice(times, F.lit(1), both).alias("t"), F.slice(values, F.lit(1), both).alias("v"))
    return rows.where(both > 0).select("series_id", F.posexplode(pairs).alias("pos", "p")).select("series_id", F.col("p.t").cast("double").alias("t"), F.col("p.v").cast("double").alias("v"), F.col("pos").cast("long").alias("pos"))


def gaps(points: DataFrame) -> DataFrame:
    """points (series_id, t, v) with i from 0 in order of t, n and gap, the time since the sample in front; staged. A series
    is dealt over as many tasks as its size asks for."""
    return numbered(points.select("series_id", "t", "v"), "series_id", "t", previous=True).withColumn("gap", F.col("t") - F.col("before")).drop("before")


def median_gap(rows: DataFrame) -> DataFrame:
    """(series_id, median) of the gaps above zero."""
    return exact_median(rows.where("gap > 0").select("series_id", "gap"), "series_id", "gap")


def gap_stats(points: DataFrame) -> DataFrame:
    """(series_id, n, median_gap, largest_gap) over gaps above zero."""
    rows = gaps(points)
    of = rows.groupBy("series_id").agg(F.max("n").alias("n"), F.max(F.when(F.col("gap") > 0, F.col("gap"))).alias("largest_gap"))
    return of.join(median_gap(rows), "series_id", "left").select("series_id", "n", F.col("median").alias("median_gap"), "largest_gap")


def latest_segment(points: DataFrame) -> DataFrame:
    """(series_id, t, v, i, n, raw_samples): the samples behind the last gap of more than GAP_FACTOR median gaps,
    numbered from 0; n: how many, raw_samples: how many the series has. No task holds a whole series."""
    rows = gaps(points)
    wide = rows.join(median_gap(rows), "series_id").where(F.col("gap") > GAP_FACTOR * F.col("median"))
    begin = wide.groupBy("series_id").agg(F.max("i").alias("begin"))
    segment = rows.join(begin, "series_id", "left").withColumn("begin", F.coalesce("begin", F.lit(0))).where("i >= begin")
    return staged(segment.select("series_id", "t", "v", (F.col("i") - F.col("begin")).alias("i"), (F.col("n") - F.col("begin")).alias("n"), F.col("n").alias("raw_samples")), "segment")


def horizon(segment: DataFrame) -> DataFrame:
    """The last MOST_SAMPLES of each segment."""
    return segment.where(F.col("i") >= F.col("n") - MOST_SAMPLES)


def overview(segment: DataFrame) -> DataFrame:
    """MOST_SAMPLES of each segment, evenly spaced from the first to the last; all of a shorter one."""
    # sample i is taken if some k below MOST_SAMPLES has k * (n - 1) div (MOST_SAMPLES - 1) = i
    k = F.ceil(F.col("i") * (MOST_SAMPLES - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    taken = F.floor(k * (F.col("n") - 1) / (MOST_SAMPLES - 1)) == F.col("i")
    return segment.where((F.col("n") <= MOST_SAMPLES) | taken)


def windows(segment: DataFrame) -> DataFrame:
    """The horizon's rows with half (0: earlier, 1: latest) and w, the samples of a window; of an odd number the first goes."""
    m = F.least("n", F.lit(MOST_SAMPLES))
    w = F.floor(m / 2)
    back = F.col("n") - F.col("i")
    return horizon(segment).withColumn("w", w).where(back <= 2 * F.col("w")).withColumn("half", F.when(back <= F.col("w"), 1).otherwise(0))


def window_moments(segment: DataFrame) -> DataFrame:
    """(series_id, half, w, mean, std, slope, duration): population moments and least-squares slope of both windows."""
    return windows(segment).groupBy("series_id", "half").agg(
        F.first("w").alias("w"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.coalesce(F.regr_slope("v", "t"), F.lit(0.0)).alias("slope"),
        (F.max("t") - F.min("t")).alias("duration"),
    )


def shift_and_slope(segment: DataFrame, floor: float = 1e-12) -> DataFrame:
    """(series_id, window_samples, earlier_mean, latest_mean, earlier_std, latest_std, scale, mean_shift, normalized_slope, variation)."""
    of = window_moments(segment).groupBy("series_id").agg(
        F.first("w").alias("window_samples"),
        *[F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{name}_{c}") for h, name in ((0, "earlier"), (1, "latest")) for c in ("mean", "std")],
        F.max(F.when(F.col("half") == 1, F.col("slope"))).alias("slope"),
        F.max(F.when(F.col("half") == 1, F.col("duration"))).alias("duration"),
    )
    of = of.withColumn("scale", F.greatest(F.abs("latest_mean"), "latest_std", F.lit(floor)))
    return of.select(
        "series_id", "window_samples", "earlier_mean", "latest_mean", "earlier_std", "latest_std", "scale",
        (F.abs(F.col("latest_mean") - F.col("earlier_mean")) / F.col("scale")).alias("mean_shift"),
        (F.abs("slope") * F.col("duration") / F.col("scale")).alias("normalized_slope"),
        (F.col("latest_std") / F.col("scale")).alias("variation"),
    )


def detrended(points: DataFrame) -> DataFrame:
    """points with r, what a least-squares line of its series leaves; all zero where that is rounding alone."""
    line = points.groupBy("series_id").agg(F.coalesce(F.regr_slope("v", "t"), F.lit(0.0)).alias("slope"), F.avg("t").alias("mean_t"), F.avg("v").alias("mean_v"), F.max(F.abs("v")).alias("most"))
    rest = points.join(line, "series_id").withColumn("r", F.col("v") - F.col("mean_v") - F.col("slope") * (F.col("t") - F.col("mean_t")))
    largest = rest.groupBy("series_id").agg(F.max(F.abs("r")).alias("largest"))
    return rest.join(largest, "series_id").withColumn("r", F.when(F.col("largest") <= F.greatest("most", F.lit(1.0)) * 1e-14, 0.0).otherwise(F.col("r"))).select(*points.columns, "r")


def lag_products(lags: int, size: int):
    """Samples of a block and of the one behind it to (lag, total, pairs): sums of products at each distance."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = np.asarray(rows.column("i")) - key[1].as_py() * size
        r, there = np.zeros(size + lags), np.zeros(size + lags)
        r[at], there[at] = np.asarray(rows.column("r")), 1.0

        def products(x: np.ndarray) -> np.ndarray:
            # entry k is the sum over the block's own samples m of x[m] * x[m + k]
            return np.correlate(x, x[:size], "valid")

        total, pairs = products(r)[1:], np.rint(products(there)[1:]).astype(np.int64)
        k = np.flatnonzero(pairs)
        return pa.table({"series_id": pa.array([key[0].as_py()] * len(k), pa.string()), "lag": pa.array((k + 1).astype(np.int32)), "total": pa.array(total[k]), "pairs": pa.array(pairs[k])})

    return run


def autocorrelation(rows: DataFrame, lags: int) -> DataFrame:
    """(series_id, lag, c) for lags from 1: the mean product of r at that distance in i, over its mean square.

    Blocks of BLOCK samples, or of lags if that is more, are one task's each; a sample goes to its block, and the first
    lags of a block to the one in front too. So each is shuffled at most twice, whatever the lags, and a block gives a row
    for each lag.
    """
    size = max(BLOCK, lags)
    block = F.floor(F.col("i") / size)
    own = rows.select("series_id", block.alias("block"), F.col("i").cast("long").alias("i"), F.col("r").cast("double").alias("r"))
    halo = own.where((F.col("i") % size < lags) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    sums = own.unionByName(halo).groupBy("series_id", "block").applyInArrow(lag_products(lags, size), "series_id string, lag int, total double, pairs long")
    means = sums.groupBy("series_id", "lag").agg((F.sum("total") / F.sum("pairs")).alias("m"))
    square = rows.groupBy("series_id").agg(F.avg(F.col("r") * F.col("r")).alias("variance"))
    return means.join(square, "series_id").where("variance > 0").select("series_id", "lag", (F.col("m") / F.col("variance")).alias("c"))


def autocorrelation_time(correlations: DataFrame) -> DataFrame:
    """(series_id, tau): 1 and twice the correlations, by pairs of lags (1, 2), (3, 4) and so on until a pair's sum isn't above 0; at least 1."""
    pairs = correlations.groupBy("series_id", F.floor((F.col("lag") - 1) / 2).alias("pair")).agg(F.sum("c").alias("s"))
    going = F.min(F.when(F.col("s") > 0, 1).otherwise(0)).over(Window.partitionBy("series_id").orderBy("pair"))
    total = pairs.withColumn("going", going).groupBy("series_id").agg(F.sum(F.when(F.col("going") == 1, F.col("s")).otherwise(0.0)).alias("total"))
    return total.select("series_id", F.greatest(F.lit(1.0), 1 + 2 * F.col("total")).alias("tau"))


def peaks(correlations: DataFrame) -> DataFrame:
    """(series_id, lag, c): lags from 2, but the last, above 0.5 and not below either neighbour."""
    w = Window.partitionBy("series_id").orderBy("lag")
    near = correlations.select("series_id", "lag", "c", F.lag("c").over(w).alias("before"), F.lead("c").over(w).alias("behind"))
    return near.where("lag >= 2 AND c > 0.5 AND c >= before AND c >= behind").select("series_id", "lag", "c")


def cycles(segment: DataFrame, period: Column | int) -> DataFrame:
    """(series_id, cycle, amplitude, mean, peak_t): complete cycles of period samples, aligned to the end. The peak is
    the mean time of the values within 1e-12 of the largest."""
    rows = segment.withColumn("p", F.lit(period) if isinstance(period, int) else period)
    start = F.col("n") - F.floor(F.col("n") / F.col("p")) * F.col("p")
    rows = rows.where(F.col("i") >= start).withColumn("cycle", F.floor((F.col("i") - start) / F.col("p")))
    most = F.max("v").over(Window.partitionBy("series_id", "cycle"))
    rows = rows.withColumn("most", most).withColumn("top", F.col("most") - F.col("v") <= F.greatest(F.abs("most"), F.lit(1.0)) * 1e-12)
    return rows.groupBy("series_id", "cycle").agg((F.max("v") - F.min("v")).alias("amplitude"), F.avg("v").alias("mean"), F.avg(F.when(F.col("top"), F.col("t"))).alias("peak_t"))


def cycle_periods(of: DataFrame) -> DataFrame:
    """(series_id, cycle, period) between the peaks of neighbouring cycles."""
    period = F.col("peak_t") - F.lag("peak_t").over(Window.partitionBy("series_id").orderBy("cycle"))
    return of.select("series_id", "cycle", period.alias("period")).where("period IS NOT NULL")


def envelope(points: DataFrame, limit: int) -> DataFrame:
    """points of (series_id, t, v, i, n) cut to limit: the first and the last, of each of (limit - 2) div 2 stretches
    between them the least and the largest (the first of equal ones), and as many more of those furthest from the
    chord as fill it.

    Ends and extremes are sums of numbers that combine in the map tasks without being put in order. The points that may
    fill are those at least as far from the chord as the 2 * limit-th of the largest distances in parts of a series; a task
    passes on at most limit of them. Nothing is collected, and no task holds a series.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    last = F.col("n") - 1
    if limit <= 2:
        return points.where((F.col("n") <= limit) | (F.col("i") == last) | ((F.col("i") == 0) & F.lit(limit == 2)))
    buckets = (limit - 2) // 2
    at_ends = (F.col("i") == 0) | (F.col("i") == last)
    # the stretch b of i has 1 + b (n - 2) div buckets <= i < 1 + (b + 1) (n - 2) div buckets
    inner = F.floor((F.col("i") * buckets - 1) / (F.col("n") - 2)) if buckets else F.lit(0).cast("long")
    rows = points.withColumn("b", F.when(at_ends, F.lit(-1).cast("long")).otherwise(inner))
    large = rows.where(F.col("n") > limit)
    far = F.abs(F.col("v") - (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("i") / last))
    # written, so that their size is known before the points meet them
    chord = staged(large.where(at_ends).groupBy("series_id").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("i") == last, F.col("v"))).alias("v1")), "chord")
    parts = large.join(chord, "series_id").groupBy("series_id", "b", F.floor(F.col("i") * (4 * limit) / F.col("n")).alias("part")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or(F.col("v").isNull()).alias("gap"), F.max(far).alias("far"), F.max("v0").alias("v0"), F.max("v1").alias("v1")
    )
    # so many points are as far as that part's, so many are left without those that are taken anyway
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("far")))
    bound = F.max(F.when(F.col("rank") == 2 * limit, F.col("far"))).over(Window.partitionBy("series_id"))
    bounds = parts.withColumn("rank", rank).withColumn("bound", bound).groupBy("series_id", "b").agg(
        F.when(~F.bool_or("gap"), F.min("lo")).alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in ("bound", "v0", "v1")]
    )
    bounds = staged(bounds, "bounds")
    firsts = large.join(bounds, ["series_id", "b"]).where(F.col("v").eqNullSafe(F.col("lo")) | F.col("v").eqNullSafe(F.col("hi"))).groupBy("series_id", "b").agg(
        *[F.min(F.when(F.col("v").eqNullSafe(F.col(c)), F.col("i"))).alias(name) for c, name in (("lo", "least"), ("hi", "most"))], *[F.max(c).alias(c) for c in ("bound", "v0", "v1")]
    )
    firsts = staged(firsts, "firsts")
    taken = (F.col("n") <= limit) | at_ends
    if buckets:
        taken = taken | F.coalesce((F.col("i") == F.col("least")) | (F.col("i") == F.col("most")), F.lit(False))
    near = rows.join(firsts, ["series_id", "b"], "left").withColumns({"taken": taken, "far": far}).where(F.col("taken") | F.col("bound").isNull() | (F.col("far") >= F.col("bound")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("series_id", "taken").orderBy(F.desc("far"), "i"))).where(F.col("rank") <= limit)
    have = F.count_if("taken").over(Window.partitionBy("series_id"))
    return ranked.withColumn("have", have).where(F.col("taken") | (F.col("rank") <= limit - F.col("have"))).select(*points.columns)
