"""Series and records made of the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(line):
    """A made line as a column that later expressions read instead of repeating what makes it."""
    return F.explode(F.array(line))


def cents(x: str):
    """Whole cents, so that sums don't depend on their order."""
    return F.round(F.col(x) * 100).cast("long")


def days(column: str):
    return F.date_diff(F.col(column).cast("date"), F.lit("1990-01-01").cast("date")).cast("double")


def ship_series(spark: SparkSession, sf_dir: str, by_flag: bool = False) -> DataFrame:
    """(series_id, t, v, pos): revenue by ship day in cents, of all line items or by return flag."""
    name = F.concat(F.lit("flag_"), "l_returnflag") if by_flag else F.lit("ship")
    rows = table(spark, sf_dir, "lineitem").select(name.alias("series_id"), days("l_shipdate").alias("t"), cents("l_extendedprice").alias("c"))
    return rows.groupBy("series_id", "t").agg(F.sum("c").cast("double").alias("v")).withColumn("pos", F.lit(0).cast("long"))


def hour_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, v, pos): mean value of all events by hour, in cents."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("double")
    rows = table(spark, sf_dir, "events").select(F.lit("hour").alias("series_id"), hour.alias("t"), cents("value").alias("c"))
    mean = F.sum("c").cast("double") / F.count(F.lit(1))
    return rows.groupBy("series_id", "t").agg(mean.alias("v")).withColumn("pos", F.lit(0).cast("long"))


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, v, pos): events as they are, by type; t in microseconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("raw_"), "event_type").alias("series_id"), t.alias("t"), F.col("value").alias("v"), F.col("event_id").alias("pos"))


def made_series(spark: SparkSession) -> DataFrame:
    """(series_id, t, v, pos): signals whose state is known by construction."""
    i = F.col("id").cast("double")
    jitter = (F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 1000.0
    signals = {
        "made_constant": (100, F.lit(5.0)),
        "made_noise": (600, 10 + 0.05 * jitter),
        "made_ramp": (600, 2 + 0.002 * i),
        "made_sine": (800, 4 + 0.8 * F.sin(2 * F.pi() * i / 40)),
        "made_growing": (800, 4 + (0.4 + 0.0015 * i) * F.sin(2 * F.pi() * i / 40)),
        "made_short": (40, i),
    }
    parts = [spark.range(n).select(F.lit(name).alias("series_id"), i.alias("t"), v.alias("v"), F.col("id").alias("pos")) for name, (n, v) in signals.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
