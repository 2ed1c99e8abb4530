"""Queries over the catalogue of series, details, documents and notices, each with its SQL.

The tables' text is made of the line items: six sources, a file for each line number as its restart, a row for each item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions.staging import staged
from runsight.operators import documents as D
from runsight.operators import health as H
from runsight.operators import series as S
from runsight.operators import tablenames
from runsight.plans.registry import query
from runsight.sources import fixtures as fx
from runsight.sources import tables

#: Folder and file of each kind of table; its header lines.
PLACES = (("flow", "q.dat"), ("fluid/U", "U.dat"), ("drag", "force.dat"), ("probes", "p"), ("mix", "m.dat"), ("grad", "g.dat"))
HEADS = (["# Time value"], ["#time U"], ["# Time force(all)"], ["# Probe 0 (0 0 0)", "# probe 1 (0 0 1)", "# Time p"], ['# Time "areaAverage(p)" vol(b)', "# a comment"], ["# Time gradT"])
DECLARED = [("flow", "volFieldValue", ["Q"], "air", "sum"), ("drag", "forces", ["U"], None, None)]
#: A row's text by kind, of q, p and s; both engines could read it, only the reader here does.
TEXT = """CASE k WHEN 0 THEN concat(t, '  ', q) WHEN 1 THEN concat(t, ' (', q, ' ', 2 * q, ' ', 2 * q, ')') WHEN 3 THEN concat('   ', t, ' ', q, ' ', p) WHEN 4 THEN concat(t, ' ', p, ' ', s, ' ')
 ELSE concat(t, ' ((', q, ' ', p, ' ', s, ') (', q + 1, ' ', p + 1, ' ', s + 1, ') (', q + 2, ' ', p + 2, ' ', s + 2, '))') END"""
NOW = 320.0


def table_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, files) of the made tables: (path, line_no, line) and (path, modified_ns)."""
    items = fx.table(spark, sf_dir, "lineitem").selectExpr("CAST(l_suppkey % 6 AS INT) AS k", "l_linenumber AS n", "l_orderkey AS t", "CAST(l_quantity AS INT) AS q", "l_partkey % 1000 AS p", "l_suppkey AS s")
    folder, file = (F.element_at(F.array(*[F.lit(p[i]) for p in PLACES]), F.col("k") + 1) for i in (0, 1))
    path = F.concat_ws("/", folder, F.col("n").cast("string"), file)
    rows = items.select(path.alias("path"), ((F.col("q") * 1000 + F.col("p")) * 10_000_000 + F.col("s") + 10).alias("line_no"), fx.made(F.expr(TEXT)).alias("line"))
    restarts = staged(items.select("k", "n").distinct(), "restarts").select("k", "n", path.alias("path"))
    heads = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in HEADS]), F.col("k") + 1)
    headers = restarts.select("path", F.posexplode(heads).alias("line_no", "line")).select("path", F.col("line_no").cast("long").alias("line_no"), "line")
    cut_off = restarts.select("path", F.lit(5).cast("long").alias("line_no"), F.lit("77 (1 2").alias("line"))
    files = restarts.select("path", ((F.col("k") * 50 + F.col("n")).cast("long") * 1_000_000_000).alias("modified_ns"))
    return rows.unionByName(headers).unionByName(cut_off), files


def case_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, files = table_lines(spark, sf_dir)
    return tables.discovered(tables.parsed_rows(lines), files, tablenames.function_specs(spark, DECLARED), tables.table_heads(lines))


_V = "xyz"
_NINE = [(f"force {part}", None, c) for part in ("pressure", "viscous", "porous") for c in _V]
#: Kind, function, type, region, source, field, operation, component and value, as the reader should find them.
_FOUND = [
    (0, "flow", "volFieldValue", "air", "flow/q.dat", "Q", "sum", None, "q"), (3, "probes", "generic_table", None, "probes/p", "p", None, "probe 0", "q"), (3, "probes", "generic_table", None, "probes/p", "p", None, "probe 1", "p"),
    (4, "mix", "generic_table", None, "mix/m.dat", "p", "areaAverage", None, "p"), (4, "mix", "generic_table", None, "mix/m.dat", "b", "vol", None, "s"),
    *[(1, "U", "generic_table", "fluid", "fluid/U/U.dat", "U", None, c, v) for c, v in (("x", "q"), ("y", "2 * q"), ("z", "2 * q"), ("magnitude", "3 * q"))],
    *[(2, "drag", "forces", None, "drag/force.dat", *d, f"{'qps'[i % 3]} + {i // 3}") for i, d in enumerate(_NINE)],
    *[(5, "grad", "generic_table", None, "grad/g.dat", "gradT", None, a + b, f"{'qps'[j]} + {i}") for i, a in enumerate(_V) for j, b in enumerate(_V)],
]


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


_ROWS = ", ".join(f"({f[0]}, {', '.join(map(_text, f[1:8]))}, {i})" for i, f in enumerate(_FOUND))
_VALUES = "CASE d " + " ".join(f"WHEN {i} THEN {f[8]}" for i, f in enumerate(_FOUND)) + " END"
CASE = f"""names AS (SELECT *, substr(sha256(fn || '|' || ft || '|' || coalesce(region, '') || '|' || field || '|' || coalesce(op, '') || '|' || coalesce(comp, '') || '|postProcessing/' || src), 1, 20) AS id, concat_ws(' ', fn, op, field, comp) AS label FROM (VALUES {_ROWS}) x(k, fn, ft, region, src, field, op, comp, d)),
items AS (SELECT CAST(l_suppkey % 6 AS INT) AS k, l_linenumber AS n, l_orderkey AS t, CAST(l_quantity AS INT) AS q, l_partkey % 1000 AS p, l_suppkey AS s FROM lineitem),
newest AS (SELECT k, 50 * k + max(n) AS modified FROM items GROUP BY k), won AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY n DESC, q DESC, p DESC, s DESC) = 1),
pts AS (SELECT id, CAST(t AS DOUBLE) AS t, CAST({_VALUES} AS DOUBLE) AS v FROM won JOIN names USING (k)), seg AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM pts)"""


def envelope(limit: int) -> str:
    """cut (id, times, values) of seg, by the rules of the envelope."""
    half = (limit - 2) // 2
    return f"""ends AS (SELECT id, arg_min(v, i) AS v0, arg_max(v, i) AS v1 FROM seg GROUP BY id), placed AS (SELECT seg.*, v0, v1, CASE WHEN n > {limit} AND i BETWEEN 1 AND n - 2 THEN (i * {half} - 1) // (n - 2) END AS b FROM seg JOIN ends USING (id)),
ranked AS (SELECT *, b IS NOT NULL AND (row_number() OVER (PARTITION BY id, b ORDER BY v, i) = 1 OR row_number() OVER (PARTITION BY id, b ORDER BY v DESC, i) = 1) AS extreme FROM placed), marked AS (SELECT *, n <= {limit} OR i = 0 OR i = n - 1 OR extreme AS kept FROM ranked),
far AS (SELECT *, row_number() OVER (PARTITION BY id, kept ORDER BY abs(v - (v0 + (v1 - v0) * i / (n - 1))) DESC, i) AS rank, count(*) FILTER (kept) OVER (PARTITION BY id) AS have FROM marked),
cut AS (SELECT id, list(t ORDER BY t) AS times, list(v ORDER BY t) AS values FROM far WHERE kept OR rank <= {limit} - have GROUP BY id)"""


OWN = [("Q", "inflow", "kg/s", 500.0), ("gradT", None, None, 10.0)]


def chosen(spark: SparkSession, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides and the selection: by field, as the ids are hashes."""
    own = spark.createDataFrame(OWN, "field string, own_label string, units string, stale_after_seconds double")
    overrides = series.join(own, "field").select("series_id", F.col("own_label").alias("label"), "units", "stale_after_seconds")
    return overrides, series.where("component IN ('x', 'probe 1')").select("series_id")


_WORTH = "CASE WHEN k IN (0, 2) THEN 80 WHEN k = 4 AND op = 'areaAverage' THEN 70 WHEN k = 3 THEN 60 ELSE 0 END"
_WHY = """CASE WHEN k IN (0, 2) THEN 'Force, flow, flux, pressure-difference, or power output (+80).' WHEN op = 'areaAverage' THEN 'Average, integral, heat-transfer, species, phase, or interface output (+70).' WHEN k = 3 THEN 'Named probe output (+60).' END"""


@query("series_catalog", f"""WITH {CASE}, {envelope(300)}, of AS (SELECT id, count(*) AS n, arg_max(v, t) AS current_value, min(v) = max(v) AS same FROM pts GROUP BY id),
all_of AS (SELECT names.*, of.n, current_value, times, values, {NOW} - modified AS age, {_WORTH} + CASE WHEN of.n >= 50 THEN 20 WHEN of.n >= 20 THEN 10 ELSE 0 END - CASE WHEN of.n >= 20 AND same THEN 20 ELSE 0 END - CASE WHEN {NOW} - modified > 300 THEN 20 ELSE 0 END AS score,
  concat_ws(' ', {_WHY}, CASE WHEN of.n >= 50 THEN 'At least 50 finite samples (+20).' WHEN of.n >= 20 THEN 'At least 20 finite samples (+10).' END, CASE WHEN of.n >= 20 AND same THEN 'Constant series after 20 samples (-20).' END, CASE WHEN {NOW} - modified > 300 THEN 'Stale post-processing output (-20).' END) AS why FROM names JOIN of USING (id) JOIN cut USING (id) JOIN newest USING (k))
SELECT id, CASE WHEN field = 'Q' THEN 'inflow' ELSE label END AS label, CASE WHEN field = 'Q' THEN 'kg/s' END AS units, 'postProcessing/' || src AS source, fn AS function_name, ft AS function_type, region, field, op AS operation, comp AS component,
  age > CASE field WHEN 'Q' THEN 500 WHEN 'gradT' THEN 10 ELSE 120 END AS stale, coalesce(comp IN ('x', 'probe 1'), false) AS selected, n AS sample_count, current_value, CAST(score AS INT) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence, why AS explanation,
  CAST(len(times) AS INT) AS previewed, list_sum(times) AS sum_t, list_sum(values) AS sum_v FROM all_of""")
def series_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, series = case_series(spark, sf_dir)
    overrides, selected = chosen(spark, series)
    of = D.series_catalog(points, series, F.lit(NOW), overrides=overrides, selected=selected)

    def total(c: str):
        return F.aggregate(F.col(f"preview.{c}"), F.lit(0.0), lambda s, x: s + x)

    columns = ["id", "label", "units", "source", "function_name", "function_type", "region", "field", "operation", "component", "stale", "selected", "sample_count", "current_value"]
    return of.select(*columns, "candidate.score", "candidate.confidence", "candidate.explanation", F.size("preview.times").alias("previewed"), total("times").alias("sum_t"), total("values").alias("sum_v"))


@query("series_detail", f"""WITH {CASE}, {envelope(60)}, of AS (SELECT id, count(*) AS n FROM pts GROUP BY id)
SELECT CAST(to_json({{'id': id, 'label': CASE WHEN field = 'Q' THEN 'inflow' ELSE label END, 'units': CASE WHEN field = 'Q' THEN 'kg/s' END, 'source': 'postProcessing/' || src, 'field': field, 'component': comp, 'selected': coalesce(comp IN ('x', 'probe 1'), false),
 'totalSamples': n, 'returnedSamples': len(times), 'downsampled': len(times) < n, 'times': times, 'values': values}}) AS VARCHAR) AS document FROM names JOIN of USING (id) JOIN cut USING (id)""")
def series_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each series."""
    points, series = case_series(spark, sf_dir)
    overrides, selected = chosen(spark, series)
    return D.json_documents(D.series_details(points, series, limit=60, overrides=overrides, selected=selected))


SEVERITY = "CASE WHEN {0} % 41 = 7 THEN 'error' ELSE 'info' END"
#: Source, table, case, seq, message.
NOTICES = (
    ("configuration", "nation", "n_regionkey % 3", "n_nationkey", "n_name"), ("case", "supplier", "s_nationkey % 3", "s_suppkey", "concat('s', s_nationkey)"), ("solver_log", "customer", "c_nationkey % 3", "c_custkey", "concat(c_mktsegment, c_custkey % 90)"),
    ("post_processing", "pages", "page_id % 3", "page_id", "concat('page ', page_id % 40)"), ("mesh_quality", "part", "p_partkey % 3", "p_partkey", "p_brand"),
)


@query("notices_of_all", "WITH rows AS (" + " UNION ALL ".join(f"SELECT CAST({c} AS INT) AS c, {D.NOTICE_ORDER.index(s)} AS place, CAST({n} AS BIGINT) AS seq, {SEVERITY.format(n)} AS severity, '{s}' AS source, {m} AS message FROM {t}" for s, t, c, n, m in NOTICES) + """),
once AS (SELECT c, severity, source, message, min(place * 100000000000 + seq) AS pl FROM rows GROUP BY ALL), counted AS (SELECT *, count(*) OVER (PARTITION BY c) AS total FROM once),
kept AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY severity <> 'error', source = 'solver_log', pl DESC) AS k FROM counted QUALIFY k <= 60)
SELECT c AS "case", CAST(row_number() OVER (PARTITION BY c ORDER BY pl) AS INT) AS position, severity, source, message, total, total - count(*) OVER (PARTITION BY c) AS omitted FROM kept""")
def notices_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {s: fx.table(spark, sf_dir, t).selectExpr(f"CAST({c} AS INT) AS case", f"CAST({n} AS LONG) AS seq", f"{SEVERITY.format(n)} AS severity", f"CAST({m} AS STRING) AS message") for s, t, c, n, m in NOTICES}
    return D.gathered_notices(parts, most=60)


# Positive discounts of the line items as residuals of three fields, a time each day.
@query("residual_plot", f"""WITH r AS (SELECT 'U' || substr('xyz', CAST(l_partkey % 3 AS INT) + 1, 1) AS id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, l_discount * 100 + l_tax AS v, ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS line_no FROM lineitem WHERE l_linenumber <> 3),
pts AS (SELECT id, t, arg_max(v, line_no) AS v FROM (SELECT id, t, line_no, max(v) AS v FROM r WHERE v > 0 GROUP BY ALL) GROUP BY id, t), seg AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM pts), {envelope(200)}
SELECT id AS field, unnest(times) AS t, unnest(values) AS v FROM cut""")
def residual_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_discount") * 100 + F.col("l_tax"))
    rows = fx.table(spark, sf_dir, "lineitem").select(F.expr("concat('U', substr('xyz', CAST(l_partkey % 3 AS INT) + 1, 1))").alias("field"), fx.days("l_shipdate").alias("simulation_time"), value.alias("initial"), (((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("line_no"))
    once = rows.groupBy("field", "simulation_time", "line_no").agg(F.max("initial").alias("initial"))
    return H.plotted(once, 200)


@query("zipped_points", "SELECT vec_id AS series_id, CAST(k AS DOUBLE) AS t, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(70) x(k) WHERE k < least(len(embedding), vec_id % 70)")
def zipped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as values of series whose times are as many as their number says."""
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), F.expr("CASE WHEN vec_id % 70 = 0 THEN array() ELSE sequence(0, CAST(vec_id % 70 AS INT) - 1) END").alias("times"), F.col("embedding").alias("values"))
    return S.points_of(rows).drop("pos")
