"""Queries over configurations of cases and their meshes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import configuration as Cf
from runsight.operators import documents as D
from runsight.operators import meshfiles as Mf
from runsight.plans.registry import query
from runsight.sources import fixtures as fx

#: Configurations, ID standing for a number, and the rules that they break.
VARIANTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ('{"version": 1, "selectedSeries": ["sID"], "acceptedStates": ["periodic"]}', ()),
    ('{"version": 1, "selectedLog": "logs/log.ID", "overrides": {"sID": {"label": "own ID", "minimumCycles": 4, "absoluteFloor": 0.5}}}', ()),
    ('{"version": 1', ("not_json",)), ("[1, ID]", ("not_an_object",)), ('{"version": 1, "version": 1}', ("duplicate_key",)), ('{"version": 1, "overrides": {"sID": {"staleAfterSeconds": NaN}}}', ("non_finite_literal",)),
    ('{"version": 1.0, "extra": ID, "also": 1}', ("unknown_key", "unknown_key", "version")), ('{"version": true, "selectedLog": 5}', ("version", "selected_log_type")),
    ('{"version": 1, "selectedLog": ""}', ("selected_log_length",)), ('{"version": 1, "selectedLog": "a/../log.ID"}', ("selected_log_path",)), ('{"version": 1, "selectedLog": "C:\\\\log.ID"}', ("selected_log_path",)),
    ('{"version": 1, "selectedSeries": "sID"}', ("selected_series_type",)), ('{"version": 1, "selectedSeries": ["sID", "", 7, "sID"]}', ("series_id", "series_id", "duplicate_series")),
    ('{"version": 1, "overrides": []}', ("overrides_type",)), ('{"version": 1, "overrides": {"sID": 1, "": {}}}', ("override_type", "series_id")),
    ('{"version": 1, "overrides": {"sID": {"colour": 1, "label": 5, "minimumCycles": 0, "absoluteFloor": 0, "staleAfterSeconds": -1, "maxNormalizedSlope": "x"}}}', ("unknown_override_key", "display_text", "finite_number", "minimum_cycles", "positive_number", "negative_number")),
    ('{"version": 1, "acceptedStates": "periodic"}', ("accepted_states_type",)), ('{"version": 1, "acceptedStates": ["periodic", "steady", "periodic"]}', ("accepted_state", "duplicate_state")),
    ('{"version": 1, "overrides": {"sID": {"minimumCycles": 1.5, "maxMeanShiftFraction": 1e999}}}', ("finite_number", "minimum_cycles")),
)
_N = len(VARIANTS)
_BROKEN = ", ".join(f"({v}, {i + 1}, '{code}')" for v, (_, codes) in enumerate(VARIANTS) for i, code in enumerate(codes))
_NAMES_ITS_SERIES = [v for v, (text, codes) in enumerate(VARIANTS) if '"sID"' in text and not {"not_json", "duplicate_key", "non_finite_literal", "selected_series_type"} & set(codes)]


def configurations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, text) of each customer, and which series each knows."""
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in VARIANTS]), (F.col("c_custkey") % _N + 1).cast("int"))
    known = customers.where("c_custkey % 3 > 0").select("path", F.concat(F.lit("s"), "path").alias("series_id"))
    return customers.select("path", F.replace(text, F.lit("ID"), F.col("path")).alias("text")), known


@query("config_problems", f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS k, CAST(c_custkey % {_N} AS INT) AS v FROM customer), broken AS (SELECT * FROM (VALUES {_BROKEN}) x(v, n, code)), counts AS (SELECT v, count(*) AS m FROM broken GROUP BY v)
SELECT path, CAST(n AS INT) AS position, code FROM c JOIN broken USING (v) UNION ALL SELECT path, CAST(coalesce(m, 0) + 1 AS INT), 'unknown_series' FROM c LEFT JOIN counts USING (v) WHERE k % 3 = 0 AND v IN ({', '.join(map(str, _NAMES_ITS_SERIES))})""")
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, known = configurations(spark, sf_dir)
    return Cf.problems(Cf.read_configurations(files), known).drop("place")


@query("config_values", f"""SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey % {_N} > 1 AS broken, CASE c_custkey % {_N} WHEN 1 THEN 'logs/log.' || c_custkey END AS selected_log, CASE c_custkey % {_N} WHEN 0 THEN 's' || c_custkey ELSE '' END AS selected,
  CASE c_custkey % {_N} WHEN 0 THEN 'periodic' ELSE 'periodic,plateau,statistically_stationary' END AS accepted, CASE c_custkey % {_N} WHEN 1 THEN 'own ' || c_custkey END AS own_label, CAST(CASE c_custkey % {_N} WHEN 1 THEN 4 END AS INT) AS own_cycles, CAST(CASE c_custkey % {_N} WHEN 1 THEN 0.5 END AS DOUBLE) AS own_floor FROM customer""")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What configurations say; the defaults where a rule is broken."""
    read = Cf.read_configurations(configurations(spark, sf_dir)[0])
    own = F.get("overrides", F.lit(0))
    return read.select("path", (F.size("problems") > 0).alias("broken"), "selected_log", F.array_join("selected_series", ",").alias("selected"), F.array_join("accepted_states", ",").alias("accepted"), own["label"].alias("own_label"), own["minimum_cycles"].alias("own_cycles"), own["absolute_floor"].alias("own_floor"))


FOLDER = "CASE p_partkey % 7 WHEN 0 THEN 'constant' WHEN 1 THEN '2' WHEN 2 THEN '1e1' WHEN 3 THEN '0.5' WHEN 4 THEN 'processor0' WHEN 5 THEN 'constant' ELSE 'system' END"
NAME = "concat(CASE p_partkey % 11 WHEN 0 THEN 'points' WHEN 1 THEN 'faces' WHEN 2 THEN 'owner' WHEN 3 THEN 'neighbour' WHEN 4 THEN 'boundary' WHEN 5 THEN 'points' WHEN 6 THEN 'faces' WHEN 7 THEN 'owner' WHEN 8 THEN 'neighbour' WHEN 9 THEN 'cellZones' ELSE 'boundary' END, CASE WHEN p_partkey % 13 < 3 THEN '.gz' ELSE '' END)"


@query("mesh_probe", f"""WITH listed AS (SELECT CAST(floor(p_partkey / 7) AS BIGINT) % 60 AS c, {FOLDER} AS folder, {NAME} AS name, max(p_size) AS size, max(p_partkey) AS m FROM part GROUP BY ALL),
cores AS (SELECT c, folder, CAST(CASE folder WHEN 'constant' THEN '-inf' ELSE folder END AS DOUBLE) AS time, replace(name, '.gz', '') AS core, arg_min({{'n': name, 's': size, 'm': m}}, strlen(name)) AS f FROM listed WHERE folder NOT IN ('system', 'processor0') AND name NOT LIKE 'cell%' GROUP BY ALL),
meshes AS (SELECT c, folder, time, max(f.m) AS newest, string_agg(f.n || ':' || f.s || ':' || f.m, '|' ORDER BY list_position(['points', 'faces', 'owner', 'neighbour', 'boundary'], core)) AS files FROM cores GROUP BY ALL HAVING count(*) = 5),
best AS (SELECT * FROM meshes QUALIFY row_number() OVER (PARTITION BY c ORDER BY time DESC) = 1), all_of AS (SELECT c, bool_or(folder = 'processor0') AS split FROM listed GROUP BY c)
SELECT c AS "case", folder || '/polyMesh' AS source, folder || '/polyMesh|' || files AS signature, newest AS newest_ns, CASE WHEN folder IS NOT NULL THEN NULL WHEN split THEN '{Mf.DECOMPOSED}' ELSE '{Mf.NONE_YET}' END AS reason FROM all_of LEFT JOIN best USING (c)""")
def mesh_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of the parts: a mesh file each, in folders of times, of processors and others."""
    listed = fx.table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 7).cast("long") % 60).alias("case"), F.expr(f"concat({FOLDER}, '/polyMesh/', {NAME})").alias("path"), "p_size", "p_partkey")
    files = listed.groupBy("case", "path").agg(F.max("p_size").alias("size"), F.max("p_partkey").alias("modified_ns"))
    return Mf.mesh_probe(files, listed.select("case").distinct())


_OWN = '{"s\' || k || \'":{"absoluteFloor":0.5,"label":"own \' || k || \'","minimumCycles":4}}'
_FIRST = " ".join(f"WHEN {v} THEN '\"{codes[0]}\"'" for v, (_, codes) in enumerate(VARIANTS) if codes)


@query("case_snapshot", f"""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey % {_N} AS INT) AS v, c_acctbal AS bal FROM customer), o AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
l AS (SELECT k, string_agg('{{"simulationTime":' || o_orderkey || ',"statusText":"' || o_orderstatus || '"}}', ',' ORDER BY r) AS l, any_value(n) AS n FROM o WHERE r <= 3 GROUP BY k)
SELECT CAST(k AS VARCHAR) AS "case", '{{"generatedAt":"now","refreshSeconds":2.0,"process":' || CASE WHEN n IS NULL THEN 'null' ELSE '{{"orderCount":' || n || ',"notANumber":null}}' END || ',"configuration":{{"version":1,"selectedLog":' || CASE v WHEN 1 THEN '"logs/log.' || k || '"' ELSE 'null' END
 || ',"selectedSeries":' || CASE v WHEN 0 THEN '["s' || k || '"]' ELSE '[]' END || ',"overrides":' || CASE v WHEN 1 THEN '{_OWN}' ELSE '{{}}' END || ',"acceptedStates":' || CASE v WHEN 0 THEN '["periodic"]' ELSE '["periodic","plateau","statistically_stationary"]' END || ',"error":' || CASE v {_FIRST} ELSE 'null' END || '}},"timeSteps":[' || coalesce(l, '') || ']}}' AS document FROM c LEFT JOIN l USING (k)""")
def case_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases: their configuration, what their orders say, and the last three of those."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case"), (-F.col("o_orderkey")).alias("position"), F.col("o_orderkey").alias("simulation_time"), F.col("o_orderstatus").alias("status_text"))
    process = orders.groupBy("case").agg(F.count(F.lit(1)).alias("order_count")).withColumn("not_a_number", F.lit(float("nan")))
    files = configurations(spark, sf_dir)[0]
    sections = {"process": process, "configuration": D.configuration_section(Cf.read_configurations(files))}
    about = {"generated_at": F.lit("now"), "refresh_seconds": F.lit(2.0)}
    return D.snapshot_documents(files.select(F.col("path").alias("case")), sections, {"time_steps": (orders, 3)}, about)
