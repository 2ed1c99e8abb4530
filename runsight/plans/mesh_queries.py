"""Queries over mesh reports, log choice, process states and record envelopes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import catalog as C
from runsight.operators import meshcheck as M
from runsight.operators import series as S
from runsight.operators.ranks import numbered
from runsight.plans.registry import query
from runsight.sources import fixtures as fx

# A line of a mesh report from each part, indented and ended by blanks as they come; both engines read the same expression.
LINE = """concat(substr('      ', 1, CAST(p_partkey % 6 AS INT)), CASE p_partkey % 23
 WHEN 0 THEN concat('cells:   ', p_size) WHEN 1 THEN concat('internal faces: ', p_size * 3) WHEN 2 THEN concat('Number of regions: ', p_size, ' (OK).')
 WHEN 3 THEN concat('Max skewness = ', p_size, CASE WHEN p_size % 3 = 0 THEN ' OK.' ELSE '' END) WHEN 4 THEN concat('Max aspect ratio = ', p_size, '.5 OK')
 WHEN 5 THEN concat('Mesh non-orthogonality Max: ', p_size, '.25 average: 4.5') WHEN 6 THEN 'Non-orthogonality check OK.'
 WHEN 7 THEN concat('***Number of severely non-orthogonal (> 70 degrees) faces: ', p_size % 4, '.') WHEN 8 THEN concat('* Max skewness, highly skew faces > 4.5: ', p_size % 3)
 WHEN 9 THEN concat('Min volume = 1e-', p_size, '. Max volume = ', p_size, '. Total volume = 1. Cell volumes OK.') WHEN 10 THEN concat('* negative volume cells = ', p_size % 2)
 WHEN 11 THEN concat('*Some odd things: ', p_size) WHEN 12 THEN concat('Minimum determinant = 0.', p_size) WHEN 13 THEN concat('faces: ', p_size)
 WHEN 14 THEN CASE WHEN p_size % 5 = 0 THEN concat('Failed ', p_size, ' mesh checks.') ELSE 'Mesh OK.' END WHEN 15 THEN CASE WHEN p_size = 7 THEN 'Segmentation fault' WHEN p_size = 8 THEN 'Floating point exception' ELSE p_name END
 WHEN 16 THEN concat('Overall domain bounding box (-', p_size, ' 0 .5) (1 2e1 ', p_size, '.25)') WHEN 17 THEN concat('Mesh has 2 geometric (non-empty/wedge) directions (1 ', p_size % 2, ' 1)') WHEN 18 THEN concat('Mesh has 3 solution (non-empty) directions (', p_size % 2, ' 1 1)')
 WHEN 19 THEN concat('Min determinant = 0.5. Mesh (non-empty, non-wedge) directions (1 1 ', p_size % 2, ')') WHEN 20 THEN concat('Mesh (non-empty) directions (0 ', p_size % 2, ' 1)') WHEN 21 THEN '' ELSE p_type END, substr('   ', 1, CAST(p_partkey % 4 AS INT)))"""
REPORT = "CAST(p_partkey % 97 % 23 AS INT)"
LINES = f"lines AS (SELECT {REPORT} AS report, p_partkey AS line_no, {LINE} AS line FROM part)"


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select(F.expr(REPORT).alias("report"), F.col("p_partkey").alias("line_no"), fx.made(F.expr(LINE)).alias("line"))


def _last(value: str) -> str:
    return f"arg_max({value}, CASE WHEN {value} IS NOT NULL THEN line_no END)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BARE = "bare AS (SELECT report, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines), clean_lines AS (SELECT *, lower(line) AS low FROM bare WHERE line <> '')"


def _count(words: str) -> str:
    value = f"CASE WHEN starts_with(low, '{words}') THEN TRY_CAST(regexp_extract(low, '^{words} *: *([0-9]+)', 1) AS BIGINT) END"
    return f"{_last(value)} AS {words.replace(' ', '_')}"


@query("mesh_counts", f"""WITH {LINES}, {_BARE} SELECT report, {', '.join(_count(c) for c in ('points', 'faces', 'internal faces', 'cells'))}, {_last("TRY_CAST(regexp_extract(low, 'number of regions *: *([0-9]+)', 1) AS BIGINT)")} AS regions FROM clean_lines GROUP BY report""")
def mesh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(report_lines(spark, sf_dir))


@query("mesh_geometry", f"""WITH {LINES}, {_BARE}, w AS (SELECT report, line_no, CASE WHEN contains(low, 'bounding box (') THEN replace(replace(split_part(low, 'bounding box (', 2), ') (', ' '), ')', '') END AS box,
  CASE WHEN contains(low, ' geometric ') OR contains(low, 'mesh (non-empty, non-wedge)') THEN split_part(split_part(low, 'directions (', 2), ')', 1) END AS g, CASE WHEN contains(low, ' solution ') OR contains(low, 'mesh (non-empty) ') THEN split_part(split_part(low, 'directions (', 2), ')', 1) END AS s FROM clean_lines)
SELECT report, CAST(split_part({_last('box')}, ' ', 1) AS DOUBLE) AS x_min, CAST(split_part({_last('box')}, ' ', 6) AS DOUBLE) AS z_max, {_last('g')} AS geometric, {_last('s')} AS solution FROM w GROUP BY report""")
def mesh_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = M.geometry(report_lines(spark, sf_dir))
    return of.select("report", F.element_at("box_min", 1).alias("x_min"), F.element_at("box_max", 3).alias("z_max"), *[F.array_join(F.col(f"{c}_directions").cast("array<string>"), " ").alias(c) for c in ("geometric", "solution")])


# The problems, metrics and verdicts in a writing of their own, so that a fault in the library's shows.
_CODE = """CASE WHEN contains(low, 'severely') AND contains(low, 'non-orthogonal') THEN 'severely_non_orthogonal_faces' WHEN contains(low, 'non-orthogonal') THEN 'non_orthogonality_faces' WHEN contains(low, 'face pyramid') THEN 'face_pyramid_faces'
 WHEN contains(low, 'concav') THEN 'concave_faces' WHEN contains(low, 'skew') THEN 'highly_skew_faces' WHEN contains(low, 'interpolation weight') THEN 'interpolation_weight_faces' WHEN contains(low, 'volume ratio') THEN 'volume_ratio_faces'
 WHEN contains(low, 'face twist') THEN 'face_twist_faces' WHEN contains(low, 'determinant') THEN 'low_determinant_cells' WHEN contains(low, 'negative') AND contains(low, 'volume') THEN 'negative_volume_cells'
 ELSE trim(regexp_replace(label, '[^a-z0-9]+', '_', 'g'), '_') END"""
_MARKS = "regexp_matches(low, 'non-orthogonal|skew|negative volume|face pyramid|concav|interpolation weight|volume ratio|face twist|determinant|illegal|disconnected|duplicate|zero area')"
PROBLEMS = f"""{_BARE}, found AS (SELECT report, line_no, ltrim(low, '* ') AS low, trim(regexp_extract(ltrim(low, '* '), '^(.+?) *[:=] *[0-9]+[.]?$', 1)) AS label, TRY_CAST(regexp_extract(low, '[:=] *([0-9]+)[.]?$', 1) AS BIGINT) AS n FROM clean_lines WHERE NOT contains(low, 'number of regions') AND (starts_with(low, '*') OR {_MARKS})),
problems AS (SELECT report, line_no, {_CODE} AS code, n, TRY_CAST(regexp_extract(label, '[<>] *([-+0-9.e]+)', 1) AS DOUBLE) AS lim FROM found WHERE n IS NOT NULL AND label <> '')"""


@query("mesh_problems", f'WITH {LINES}, {PROBLEMS} SELECT report, line_no, code, n, lim AS "limit" FROM problems')
def mesh_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.problems(report_lines(spark, sf_dir))


_X = "([-+]?[0-9]*[.]?[0-9]+(?:e[-+]?[0-9]+)?)"
#: Code, pattern of a line in lower case, and whether OK in the line passes it.
_METRICS = (
    ("aspect_ratio_max", f"max aspect ratio = {_X}", True), ("face_area_min", f"minimum face area = {_X}[.] maximum", True), ("face_area_max", f"maximum face area = {_X}", True),
    ("cell_volume_min", f"min volume = {_X}[.]? ", True), ("cell_volume_max", f"max volume = {_X}", True), ("non_orthogonality_max", f"non-orthogonality max: {_X}", False),
    ("non_orthogonality_average", f"non-orthogonality max: .*average: {_X}", False), ("skewness_max", f"max skewness = {_X}", True), ("determinant_min", f"min(?:imum)? determinant = {_X}", True),
    ("face_weight_min", f"min face weight = {_X}", True), ("volume_ratio_min", f"min volume ratio = {_X}", True), ("tet_quality_min", f"min tet quality = {_X}", True),
    ("concavity_max", f"max concavity = {_X}", True), ("cell_openness_max", f"max cell openness = {_X}", True),
)


def _told(code: str, pattern: str, says: bool) -> str:
    said = "CASE WHEN regexp_matches(low, '\\bok\\b') THEN 'passing' ELSE 'informational' END" if says else "'informational'"
    return f"SELECT report, line_no * 4 AS pos, '{code}' AS code, TRY_CAST(regexp_extract(low, '{pattern}', 1) AS DOUBLE) AS observed, {said} AS said FROM clean_lines WHERE regexp_matches(low, '{pattern}')"


_JUDGED = """CASE code WHEN 'severely_non_orthogonal_faces' THEN 'non_orthogonality_max' WHEN 'non_orthogonality_faces' THEN 'non_orthogonality_max' WHEN 'highly_skew_faces' THEN 'skewness_max' WHEN 'concave_faces' THEN 'concavity_max'
 WHEN 'interpolation_weight_faces' THEN 'face_weight_min' WHEN 'volume_ratio_faces' THEN 'volume_ratio_min' WHEN 'low_determinant_cells' THEN 'determinant_min' WHEN 'negative_volume_cells' THEN 'cell_volume_min' END"""


@query("mesh_metrics", f"""WITH {LINES}, {PROBLEMS}, told AS ({' UNION ALL '.join(_told(*m) for m in _METRICS)}),
judgements AS (SELECT report, line_no * 4 + 1 AS pos, c.code, 'passing' AS judged, CAST(NULL AS DOUBLE) AS lim FROM clean_lines, (VALUES ('non_orthogonality_max'), ('non_orthogonality_average')) c(code) WHERE contains(low, 'non-orthogonality check ok')
  UNION ALL SELECT report, line_no * 4 + 2, {_JUDGED}, CASE WHEN n > 0 THEN 'failing' ELSE 'passing' END, lim FROM problems WHERE {_JUDGED} IS NOT NULL),
ends AS (SELECT report, code, min(pos) AS a, max(pos) AS z, arg_max(observed, pos) AS observed, arg_max(said, pos) AS said FROM told GROUP BY report, code),
judged AS (SELECT j.report, j.code, arg_max(j.judged, j.pos) AS judged, max(j.pos) AS pos, arg_max(CASE WHEN j.pos > e.z THEN j.lim END, CASE WHEN j.pos > e.z AND j.lim IS NOT NULL THEN j.pos END) AS target FROM judgements j JOIN ends e ON j.report = e.report AND j.code = e.code AND j.pos > e.a GROUP BY 1, 2)
SELECT e.report, e.code, e.observed, CASE WHEN j.judged = 'failing' OR j.pos > e.z THEN j.judged ELSE e.said END AS status, j.target FROM ends e LEFT JOIN judged j ON e.report = j.report AND e.code = j.code""")
def mesh_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics(report_lines(spark, sf_dir))


@query("mesh_verdict", f"""WITH {LINES}, {_BARE}, marked AS (SELECT report, line_no, regexp_full_match(low, '(--> *)?foam fatal (io )?error *:?|floating point exception( +\\(core dumped\\))?|segmentation fault( +\\(core dumped\\))?|mpi_abort was invoked on rank [0-9]+\\b.*') AS fatal,
  CASE WHEN regexp_matches(low, '\\bfailed +[0-9]+ +mesh checks? *[.]') THEN false WHEN regexp_matches(low, '\\bmesh ok *[.]') THEN true END AS ok, TRY_CAST(regexp_extract(low, '\\bfailed +([0-9]+) +mesh check', 1) AS BIGINT) AS failed FROM clean_lines),
of AS (SELECT report, bool_or(fatal) AS fatal, {_last('ok')} AS mesh_ok, {_last('failed')} AS failed_checks FROM marked GROUP BY report)
SELECT report, mesh_ok, failed_checks, CASE WHEN report % 11 = 3 OR fatal OR mesh_ok = false THEN 'failing' WHEN mesh_ok THEN 'passing' ELSE 'indeterminate' END AS status FROM of""")
def mesh_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report_lines(spark, sf_dir)
    exits = lines.select("report").distinct().withColumn("exit_code", F.when(F.col("report") % 11 == 3, 1).otherwise(0))
    return M.verdict(lines, exits)


APPLICATION = "CASE c_nationkey % 3 WHEN 0 THEN 'simpleFoam' WHEN 1 THEN 'deposits' END"
NAME = "CASE c_custkey % 9 WHEN 0 THEN 'log.snappyHexMesh' WHEN 1 THEN 'log.blockMesh' WHEN 2 THEN 'log.simpleFoam' ELSE 'log' END"
HEAD = "CASE c_custkey % 4 WHEN 0 THEN 'decomposePar ran' ELSE c_comment END"
TAIL = "CASE c_custkey % 5 WHEN 0 THEN 'Time = 3' ELSE '' END"
LOGS = f"logs AS (SELECT *, {NAME} AS name, {HEAD} AS head, {TAIL} AS tail, {APPLICATION} AS application FROM customer)".replace("c_comment", "c_mktsegment")
WORKFLOW = f"""CASE WHEN regexp_matches(concat_ws(chr(10), name, head, tail), {_q(C.MESHER)}) THEN 'snappy_hex_mesh' WHEN regexp_matches(name, {_q(C.UTILITY)}) OR regexp_matches(head, {_q(C.UTILITY)}) THEN 'utility'
 WHEN regexp_matches(tail, {_q(C.SOLVER_RECORD)}) OR coalesce(contains(lower(name), lower(application)) OR regexp_matches(head, '(?i)\\b' || application || '\\b'), false) THEN 'solver' ELSE 'unknown' END"""


def case_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer")
    parts = {"name": NAME, "head": HEAD.replace("c_comment", "c_mktsegment"), "tail": TAIL, "application": APPLICATION}
    return C.log_workflow(rows.select("*", *[F.expr(e).alias(c) for c, e in parts.items()]))


@query("log_workflow", f"WITH {LOGS} SELECT c_custkey, {WORKFLOW} AS workflow FROM logs")
def log_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_logs(spark, sf_dir).select("c_custkey", "workflow")


@query("log_choice", f"""WITH {LOGS}, kinds AS (SELECT c_nationkey AS k, c_custkey AS path, c_nationkey % 6 = 5 AND c_custkey % 4 = 3 AS e, c_nationkey % 6 = 4 AND c_custkey % 3 = 2 AS s, c_nationkey % 6 = 3 AND c_custkey % 5 = 1 AS act, {WORKFLOW} AS workflow, CAST(round(c_acctbal * 100) AS BIGINT) AS m, CAST(c_custkey % 13 AS INT) AS score FROM logs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN e THEN 0 WHEN s THEN 1 ELSE 2 END, CASE WHEN workflow = 'unknown' THEN 1 ELSE 0 END, m DESC, path) AS r FROM kinds),
of AS (SELECT k, min(CASE WHEN e THEN r END) AS e, min(CASE WHEN s THEN r END) AS s, min(CASE WHEN act THEN r END) AS t, min(r) AS f FROM ranked GROUP BY k),
b AS (SELECT k, path, m FROM ranked WHERE workflow = 'solver' QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, m DESC, r) = 1), n AS (SELECT k, path, m FROM ranked WHERE workflow = 'snappy_hex_mesh' QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC, r) = 1)
SELECT of.k AS "case", coalesce(x.path, y.path, q.path, CASE WHEN n.path IS NOT NULL AND (b.path IS NULL OR n.m > b.m) THEN n.path END, b.path, z.path) AS path FROM of LEFT JOIN ranked x ON x.k = of.k AND x.r = of.e LEFT JOIN ranked y ON y.k = of.k AND y.r = of.s LEFT JOIN ranked q ON q.k = of.k AND q.r = of.t LEFT JOIN b ON b.k = of.k LEFT JOIN n ON n.k = of.k LEFT JOIN ranked z ON z.k = of.k AND z.r = of.f""")
def log_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = case_logs(spark, sf_dir).select(F.col("c_nationkey").alias("case"), F.col("c_custkey").alias("path"), F.expr("c_nationkey % 6 = 5 AND c_custkey % 4 = 3").alias("explicit"), F.expr("c_nationkey % 6 = 4 AND c_custkey % 3 = 2").alias("saved"), F.expr("c_nationkey % 6 = 3 AND c_custkey % 5 = 1").alias("active"), "workflow", fx.cents("c_acctbal").alias("modified_ns"), (F.col("c_custkey") % 13).cast("int").alias("score"))
    return C.chosen_log(C.ranked_logs(of), F.col("active"))


@query("process_state", """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'running' WHEN o_custkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'failed' WHEN o_custkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'completed'
 WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 OR o_totalprice >= 300000 THEN 'completed' WHEN o_orderkey % 4 <> 0 AND o_custkey % 500 <= CASE WHEN o_custkey % 2 = 0 THEN 300 ELSE 90 END THEN 'running'
 WHEN o_custkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'stale' WHEN o_orderkey % 4 <> 0 AND o_orderstatus <> 'P' THEN 'stopped' ELSE 'not_started' END AS state FROM orders""")
def process_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "found": "o_orderkey % 19 = 0", "has_log": "o_orderkey % 4 <> 0", "mesher": "o_custkey % 2 = 0", "age_seconds": "CAST(o_custkey % 500 AS DOUBLE)", "mesher_failed": "o_orderkey % 7 = 0", "mesher_completed": "o_orderkey % 5 = 0",
        "failed": "o_orderkey % 11 = 0", "completed": "o_orderstatus = 'F' AND o_orderkey % 3 = 0", "current_time": "CAST(o_totalprice AS DOUBLE)", "end_time": "300000D", "parsed": "o_orderstatus <> 'P'",
    }
    runs = fx.table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(c) for c, e in parts.items()])
    return C.process_state(runs).select("o_orderkey", "state")


@query("record_envelope", """WITH r AS (SELECT o_orderstatus AS seg, o_orderkey AS t, CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey % 10 AS DOUBLE) ELSE greatest(o_totalprice, CAST(o_custkey % 10 AS DOUBLE)) END AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
ends AS (SELECT seg, arg_min(v, i) AS v0, arg_max(v, i) AS v1 FROM r GROUP BY seg), placed AS (SELECT r.*, v0, v1, CASE WHEN n > 50 AND i BETWEEN 1 AND n - 2 THEN (i * 24 - 1) // (n - 2) END AS b FROM r JOIN ends USING (seg)),
ranked AS (SELECT *, b IS NOT NULL AND (row_number() OVER (PARTITION BY seg, b ORDER BY v, i) = 1 OR row_number() OVER (PARTITION BY seg, b ORDER BY v DESC, i) = 1) AS extreme FROM placed), marked AS (SELECT *, n <= 50 OR i = 0 OR i = n - 1 OR extreme AS kept FROM ranked),
far AS (SELECT *, row_number() OVER (PARTITION BY seg, kept ORDER BY abs(v - (v0 + (v1 - v0) * i / (n - 1))) DESC, i) AS rank, count(*) FILTER (kept) OVER (PARTITION BY seg) AS have FROM marked) SELECT seg, t, v FROM far WHERE kept OR rank <= 50 - have""")
def record_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each segment cut to fifty by their signal: in each stretch the smallest and the largest decide."""
    price = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice").cast("double")).otherwise(float("nan"))
    signal = C.record_signal(price, (F.col("o_custkey") % 10).cast("double"))
    records = fx.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("series_id"), F.col("o_orderkey").alias("t"), signal.alias("v"))
    return S.envelope(numbered(records, "series_id", "t"), 50).select(F.col("series_id").alias("seg"), "t", "v")


@query("missing_selected", "SELECT c_custkey * 2 AS id FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)")
def missing_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the customers' numbers, as selected series, that no order, as known series, has."""
    selected = fx.table(spark, sf_dir, "customer").select(F.lit("c").alias("case"), (F.col("c_custkey") * 2).alias("id"))
    known = fx.table(spark, sf_dir, "orders").select(F.lit("c").alias("case"), F.col("o_custkey").alias("id"))
    return C.missing_selected(selected, known).select("id")
