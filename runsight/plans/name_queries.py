"""Queries over the names of tables, constant series and unknown names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import tablenames as T
from runsight.plans.registry import query
from runsight.plans.series_queries import RAW
from runsight.sources import fixtures as fx

# A path for each part; both engines read the same expression.
PATH = """concat(CASE p_partkey % 3 WHEN 0 THEN 'solid/' WHEN 1 THEN 'probe/' ELSE '' END,
 CASE p_partkey % 5 WHEN 0 THEN 'drag/' WHEN 1 THEN 'probe/' WHEN 2 THEN concat(p_brand, '/') WHEN 3 THEN concat(p_size, '/drag/') ELSE '' END,
 CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '/') WHEN 1 THEN concat('1e-', p_size, '/') WHEN 2 THEN concat(p_size, '.5/late/') ELSE '' END,
 CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) WHEN 1 THEN 'a.b.dat' ELSE concat(p_type, '.dat') END)"""
DECLARED = [("drag", "forces", ["U"], "air", None), ("probe", "probes", ["p", "T"], None, None)]

PATHS = f"""rows AS (SELECT DISTINCT {PATH} AS path FROM part), parts AS (SELECT path, string_split(path, '/') AS p FROM rows),
placed AS (SELECT *, list_max([i FOR i IN range(1, len(p)) IF regexp_matches(p[i], '{T.NUMBER}')]) AS a FROM parts),
befores AS (SELECT *, p[1:coalesce(a, len(p)) - 1] AS b FROM placed),
known AS (SELECT * FROM (VALUES ('drag', 'forces', 'air'), ('probe', 'probes', NULL)) AS x(name, kind, own)),
hits AS (SELECT *, list_min([i FOR i IN range(1, len(b) + 1) IF b[i] IN ('drag', 'probe')]) AS m FROM befores)"""


@query("table_functions", f"""WITH {PATHS} SELECT path, '{T.ROOT}/' || array_to_string([p[i] FOR i IN range(1, len(p) + 1) IF a IS NULL OR i <> a], '/') AS source,
 CASE WHEN m IS NOT NULL THEN b[m] WHEN len(b) > 0 THEN b[len(b)] ELSE regexp_replace(p[len(p)], '^(.+)\\.[^.]+$', '\\1') END AS function,
 coalesce(kind, '{T.GENERIC}') AS type,
 CASE WHEN m IS NOT NULL THEN coalesce(own, CASE WHEN m > 1 THEN b[m - 1] END) WHEN len(b) > 1 THEN b[len(b) - 1] END AS region,
 CASE WHEN a IS NULL THEN 0 ELSE CAST(p[a] AS DOUBLE) END AS start FROM hits LEFT JOIN known ON name = b[m]""")
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fx.table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"))
    return T.with_functions(paths, T.function_specs(spark, DECLARED))


# The values of each type of event, and the discounts of each supplier, which every third keeps constant.
@query("constant_series", f"""WITH {RAW}, every AS (SELECT series_id, v FROM raw UNION ALL SELECT 'discount_' || l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 1.0 ELSE l_discount END FROM lineitem)
SELECT series_id, count(v) AS n, count(v) >= {T.LEAST_CONSTANT} AND coalesce(min(v) = max(v), false) AS constant FROM every GROUP BY series_id""")
def constant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("discount_"), "l_suppkey").alias("series_id"), F.when(F.col("l_suppkey") % 3 == 0, 1.0).otherwise(F.col("l_discount").cast("double")).alias("v"))
    return T.constant_series(fx.raw_series(spark, sf_dir).select("series_id", "v").unionByName(lines))


KNOWN = ["AF", "NO"]


@query("unknown_names", f"""WITH given AS (SELECT l_orderkey, list(DISTINCT concat(l_returnflag, l_linestatus)) AS names FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort([x FOR x IN names IF x NOT IN ({', '.join(f"'{k}'" for k in KNOWN)})]), ',') AS unknown FROM given""")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("names"))
    return given.select("l_orderkey", F.array_join(T.unknown_names(F.col("names"), KNOWN), ",").alias("unknown"))
