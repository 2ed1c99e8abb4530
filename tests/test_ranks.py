"""Orders, gaps, medians and lag products over many tasks give what one task gives."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.operators import ranks
from runsight.operators import series as S


@pytest.fixture
def many_ranges(spark):
    """Every shuffle keeps its partitions, so that small keys span ranges as large ones do."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def points(seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for name, n in (("one", 1), ("two", 2), ("small", 30), ("hot", 900), ("odd", 151)):
        t = np.cumsum(draw.integers(1, 4, n)).astype(float)
        for jump in sorted(draw.integers(1, n, 3)) if n > 5 else []:
            t[jump:] += 40
        rows += [(name, float(x), float(draw.normal())) for x in t]
    draw.shuffle(rows)
    return [(str(a), float(b), float(c)) for a, b, c in rows]


def plain_segment(rows):
    out = []
    for name in sorted({r[0] for r in rows}):
        own = sorted((t, v) for s, t, v in rows if s == name)
        gaps = [b[0] - a[0] for a, b in zip(own, own[1:], strict=False)]
        typical = statistics.median([g for g in gaps if g > 0]) if gaps else None
        begin = max([i + 1 for i, g in enumerate(gaps) if g > 5 * typical], default=0)
        out += [(name, t, v, i, len(own) - begin, len(own)) for i, (t, v) in enumerate(own[begin:])]
    return out


def test_segments_over_many_ranges(spark, many_ranges):
    rows = points()
    df = spark.createDataFrame(rows, "series_id string, t double, v double").repartition(5)
    placed = ranks.numbered(df, "series_id", "t", previous=True)
    hot = sorted((r.i, r.t, r.before) for r in placed.where("series_id = 'hot'").collect())
    times = sorted(t for s, t, _ in rows if s == "hot")
    assert hot == [(i, t, times[i - 1] if i else None) for i, t in enumerate(times)]
    assert sorted(tuple(r) for r in S.latest_segment(df).collect()) == plain_segment(rows)


def test_a_hot_series_is_the_work_of_many_tasks(spark, many_ranges):
    df = spark.range(20_000).select(F.lit("hot").alias("series_id"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("v"))
    dealt = df.repartitionByRange("series_id", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 7 and max(r["count"] for r in dealt) < 6000
    assert S.gap_stats(df).collect()[0].asDict() == {"series_id": "hot", "n": 20_000, "median_gap": 1.0, "largest_gap": 1.0}
    plan = S.latest_segment(df)._jdf.queryExecution().toString()
    assert "Window" not in plan  # what is left to run is a filter over written rows


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_exact_median(spark, many_ranges, n):
    draw = np.random.default_rng(n)
    values = {k: [float(x) for x in np.round(draw.normal(size=n), d)] for k, d in (("a", 1), ("b", 9))}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v], "k string, x double")
    assert {r.k: r.median for r in ranks.exact_median(df, "k", "x").collect()} == {k: statistics.median(v) for k, v in values.items()}


@pytest.mark.parametrize("lags,size", [(1, 16), (9, 16), (16, 16), (40, 16), (40, 4096)])
def test_lag_products_by_blocks(spark, monkeypatch, lags, size):
    monkeypatch.setattr(S, "BLOCK", size)
    draw = np.random.default_rng(lags)
    rows, want = [], {}
    for name, n in (("a", 100), ("b", 33), ("c", 1)):
        r = draw.normal(size=n)
        keep = [i for i in range(n) if name != "b" or i % 7]  # a series may have holes
        rows += [(name, i, float(r[i])) for i in keep]
        square = np.mean([r[i] ** 2 for i in keep])
        for k in range(1, lags + 1):
            pairs = [r[i] * r[i + k] for i in keep if i + k in keep]
            if pairs:
                want[name, k] = np.mean(pairs) / square
    got = {(x.series_id, x.lag): x.c for x in S.autocorrelation(spark.createDataFrame(rows, "series_id string, i long, r double"), lags).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
