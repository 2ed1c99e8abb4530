"""Queries over solver logs. The lines are made of the events table, a log for each user: every format and lines like them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions.staging import scratch
from runsight.operators import events as E
from runsight.operators import meshcheck as MC
from runsight.plans.registry import query
from runsight.sources import fixtures as fx
from runsight.streaming import logs as stream

#: An SQL expression of both engines: the line of event number e, with n = e % 97, a = e % 9, b = e % 7.
LINE = """CASE e * 7 % 31 WHEN 0 THEN 'Time = ' || n || '.' || b WHEN 1 THEN 'Time = ' || n || 'e-' || b WHEN 2 THEN 'Time = .' || n || '  '
 WHEN 3 THEN 'deltaT = 0.00' || a WHEN 4 THEN 'smoothSolver:  Solving for U' || substr('xyz', CAST(e % 3 AS INT) + 1, 1) || ', Initial residual = ' || a || 'e-0' || b || ', Final residual = ' || b || 'e-07, No Iterations ' || n
 WHEN 5 THEN 'zone_' || b || ': GAMG:  Solving for T, Initial residual = 0.' || n || ', Final residual = .00' || a || ', No Iterations = ' || n || ' failed'
 WHEN 6 THEN 'PCG:  Solving for p_rgh, Initial residual = +0.' || a || ', Final residual = 8e-4, No Iterations ' || b || ' Converged'
 WHEN 7 THEN 'PCG:  Solving for p, Initial residual = 1' || ', Final residual = 8e-4, No Iterations ' || b || ' not converged'
 WHEN 8 THEN 'Courant Number mean: 0.' || a || ' max: ' || b || '.' || n WHEN 9 THEN 'water: Courant Number mean: ' || a || '. max: ' || n WHEN 10 THEN 'Mesh Courant Number mean: 0.00' || a || ' max: 0.' || n
 WHEN 11 THEN 'time step continuity errors : sum local = ' || a || 'e-07, global = -' || b || 'e-09, cumulative = ' || n || 'E-09' WHEN 12 THEN 'PIMPLE: iteration ' || a WHEN 13 THEN 'SIMPLE: outer iteration ' || b
 WHEN 14 THEN 'ExecutionTime = ' || n || '.' || a || ' s  ClockTime = ' || n || ' s' WHEN 15 THEN 'Region zone_' || a WHEN 16 THEN 'Region: side' || b || ' ' WHEN 17 THEN 'air' || b || ': Time = ' || n
 WHEN 18 THEN '--> FOAM Warning : in cell ' || n WHEN 19 THEN 'warning ' || a WHEN 20 THEN 'trap for Floating point exception is on' WHEN 21 THEN 'PIMPLE: convergence criteria satisfied in ' || a || ' loops'
 WHEN 22 THEN 'It failed: convergence criteria not met' WHEN 23 THEN CASE WHEN n < 20 THEN 'End ' ELSE 'End of step' END
 WHEN 24 THEN CASE WHEN n < 9 THEN '[' || a || '] Segmentation fault' WHEN n < 18 THEN 'MPI_ABORT was invoked on rank ' || a || ' in a communicator' WHEN n < 27 THEN '--> FOAM FATAL IO ERROR : ' WHEN n < 36 THEN 'floating point exception (core dumped)' ELSE 'a Segmentation fault' END
 WHEN 25 THEN 'time = ' || n WHEN 26 THEN '' WHEN 27 THEN 'Time = ' || n || ' s' WHEN 28 THEN 'deltaT = ' || n || '.5' ELSE 'some other line ' || n END"""
#: A user's events of the second half of the month are a new segment.
LINES = f"lines AS (SELECT 'log.' || user_id AS path, CAST(CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS INT) AS segment, e AS line_no, {LINE} AS line FROM (SELECT user_id, ts, event_id AS e, event_id % 97 AS n, event_id % 9 AS a, event_id % 7 AS b FROM events))"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = fx.table(spark, sf_dir, "events").select("user_id", "ts", e.alias("e"), (e % 97).alias("n"), (e % 9).alias("a"), (e % 7).alias("b"))
    return rows.select(F.concat(F.lit("log."), "user_id").alias("path"), F.when(F.dayofmonth("ts") > 15, 1).otherwise(0).alias("segment"), F.col("e").alias("line_no"), fx.made(F.expr(LINE)).alias("line"))


# The formats in a writing of their own, so that a fault in the library's shows.
_N = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_AT = r"(?:([A-Za-z_][A-Za-z0-9_.-]*)\s*:\s*)?"
_ANY = "(?i)"
SQL_FORMATS = {
    "region": _ANY + r"Region\s*:?[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)\s*",
    "time": _AT + r"Time\s*=\s*" + _N + r"\s*",
    "delta_t": _AT + r"deltaT\s*=\s*" + _N + r"\s*",
    "solve": _ANY + _AT + r"([^:]+):\s+Solving for\s+([^,]+),\s*Initial residual\s*=\s*" + _N + r",\s*Final residual\s*=\s*" + _N + r",\s*No Iterations\s*(?:=\s*)?([0-9]+)(.*)",
    "mesh_courant": _ANY + _AT + r"Mesh Courant Number\s+mean:\s*" + _N + r"\s+max:\s*" + _N + r"\s*",
    "courant": _ANY + _AT + r"Courant Number\s+mean:\s*" + _N + r"\s+max:\s*" + _N + r"\s*",
    "continuity": _ANY + _AT + r"time step continuity errors\s*:\s*sum local\s*=\s*" + _N + r",\s*global\s*=\s*" + _N + r",\s*cumulative\s*=\s*" + _N + r"\s*",
    "corrector": _ANY + _AT + r"(?:SIMPLE|PISO|PIMPLE)\s*:\s*(?:outer\s+)?iteration\s+([0-9]+)\s*",
    "timing": _ANY + r"ExecutionTime\s*=\s*" + _N + r"\s+s\s+ClockTime\s*=\s*" + _N + r"\s+s\s*",
}
SQL_FATAL = (
    ("Floating point exception", r"(?i)\s*(?:\[[0-9]+\]\s*)?Floating point exception(?:\s+\(core dumped\))?\s*"),
    ("Segmentation fault", r"(?i)\s*(?:\[[0-9]+\]\s*)?Segmentation fault(?:\s+\(core dumped\))?\s*"),
    ("MPI abort", r"(?i)\s*(?:\[[0-9]+\]\s*)?MPI_ABORT was invoked on rank [0-9]+\b.*"),
    ("Fatal error", r"(?i)\s*(?:\[[0-9]+\]\s*)?(?:(?:-->\s*)?FOAM FATAL (?:IO )?|FATAL )ERROR\s*:\s*"),
)
#: The groups that hold the numbers; group 1 is the region, of all but solves' solver.
SQL_GROUPS = {"time": (2,), "delta_t": (2,), "solve": (4, 5, 6), "mesh_courant": (2, 3), "courant": (2, 3), "continuity": (2, 3, 4), "corrector": (2,), "timing": (1, 2)}


def _full(pattern: str) -> str:
    return f"regexp_full_match(line, '{pattern}')"


def _number(i: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN TRY_CAST(regexp_extract(line, '^{SQL_FORMATS[kind]}$', {g[i]}) AS DOUBLE)" for kind, g in SQL_GROUPS.items() if i < len(g)) + " END"


_LABEL = "CASE " + " ".join(f"WHEN {_full(p)} THEN '{name}'" for name, p in SQL_FATAL) + " END"
_KIND = "CASE WHEN label IS NOT NULL THEN 'fatal' " + " ".join(f"WHEN {_full(p)} THEN '{name}'" for name, p in SQL_FORMATS.items())
_KIND += " WHEN contains(low, 'convergence criteria') AND regexp_matches(low, '\\b(converged|satisfied|met)\\b') AND NOT regexp_matches(low, '\\b(not|failed|failure|unsatisfied|unmet)\\b') THEN 'converged' WHEN regexp_full_match(line, 'End\\s*') THEN 'end' END"
_REGION = "CASE WHEN kind IN ('region', 'time', 'delta_t', 'solve', 'mesh_courant', 'courant', 'continuity', 'corrector') THEN nullif(CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '^{p}$', 1)" for k, p in SQL_FORMATS.items()) + " END, '') END"
_SUFFIX = f"regexp_extract(low, '^{SQL_FORMATS['solve']}$', 7)"
EVENTS = f"""{LINES}, labelled AS (SELECT *, lower(line) AS low, {_LABEL} AS label FROM lines), kinds AS (SELECT *, {_KIND} AS kind FROM labelled),
events_ AS (SELECT path, segment, line_no, line, kind, label, {_REGION} AS region, CASE WHEN kind = 'solve' THEN trim(regexp_extract(line, '^{SQL_FORMATS['solve']}$', 3)) END AS field, {_number(0)} AS x, {_number(1)} AS y, {_number(2)} AS z,
  CASE WHEN kind <> 'solve' THEN NULL WHEN regexp_matches({_SUFFIX}, 'not\\s+converged|\\bfail(ed|ure)\\b') THEN false WHEN regexp_matches({_SUFFIX}, '\\bconverged\\b') THEN true END AS converged,
  label IS NULL AND regexp_matches(line, '(?i)^(-->)?\\s*(FOAM\\s+)?WARNING\\b') AS warning FROM kinds)"""
STEPS = f"""{EVENTS}, stepped AS (SELECT *, sum(CASE WHEN kind = 'time' THEN 1 ELSE 0 END) OVER o AS step, last_value(CASE WHEN kind = 'time' THEN x END IGNORE NULLS) OVER o AS simulation_time,
  last_value(CASE WHEN kind IN ('region', 'time') THEN region END IGNORE NULLS) OVER o AS region_so_far FROM events_ WINDOW o AS (PARTITION BY path, segment ORDER BY line_no)),
placed AS (SELECT *, CAST(coalesce(max(CASE WHEN kind = 'corrector' THEN x END) OVER (PARTITION BY path, segment, step ORDER BY line_no), 0) AS INT) AS corrector FROM stepped)"""
RESIDUAL_SQL = "residuals AS (SELECT path, segment, line_no, CAST(step AS BIGINT) AS step, simulation_time, field, x AS initial, y AS final, CAST(z AS INT) AS iterations, converged, coalesce(region, region_so_far) AS region, corrector AS outer_corrector FROM placed WHERE kind = 'solve' AND step > 0)"


def _latest(kind: str, c: str) -> str:
    return f"arg_max({c}, CASE WHEN kind = '{kind}' THEN line_no END)"


STEP_SQL = f"""steps AS (SELECT path, segment, CAST(step AS BIGINT) AS step, {_latest('time', 'x')} AS simulation_time, {_latest('delta_t', 'x')} AS delta_t, {_latest('courant', 'x')} AS courant_mean, {_latest('courant', 'y')} AS courant_max,
  {_latest('mesh_courant', 'x')} AS mesh_courant_mean, {_latest('mesh_courant', 'y')} AS mesh_courant_max, {_latest('continuity', 'x')} AS continuity_local, {_latest('continuity', 'y')} AS continuity_global, {_latest('continuity', 'z')} AS continuity_cumulative,
  max(corrector) AS outer_correctors FROM placed WHERE step > 0 GROUP BY path, segment, step)"""


@query("event_extract", f"WITH {EVENTS} SELECT path, segment, line_no, kind, label, region, field, x, y, z, converged, warning FROM events_")
def event_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(log_lines(spark, sf_dir)).drop("line")


@query("forward_fill_region", f"WITH {STEPS} SELECT path, line_no, CAST(step AS BIGINT) AS step, simulation_time, region_so_far FROM placed")
def forward_fill_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.in_steps(E.extract(log_lines(spark, sf_dir))).select("path", "line_no", "step", "simulation_time", "region_so_far")


@query("running_corrector", f"WITH {STEPS}, {RESIDUAL_SQL} SELECT * FROM residuals")
def running_corrector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.residuals(E.extract(log_lines(spark, sf_dir)))


@query("step_assembly", f"WITH {STEPS}, {STEP_SQL} SELECT * FROM steps")
def step_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.time_steps(E.extract(log_lines(spark, sf_dir)))


@query("log_flags", f"""WITH {EVENTS}, latest AS (SELECT * FROM events_ QUALIFY segment = max(segment) OVER (PARTITION BY path))
SELECT path, bool_or(coalesce(kind = 'end', false)) AS completed, bool_or(coalesce(kind = 'converged', false)) AS declared_converged, {_latest('fatal', 'label')} AS failure, {_latest('timing', 'x')} AS execution_time, {_latest('timing', 'y')} AS clock_time FROM latest GROUP BY path""")
def log_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_flags(E.extract(log_lines(spark, sf_dir)))


#: What two queries say of a log: the run, and sums and ends of what is kept.
TELEMETRY = f"""WITH {STEPS}, {RESIDUAL_SQL}, {STEP_SQL}, ends AS (SELECT path, max(segment) AS segment FROM placed WHERE kind IS NOT NULL OR warning OR line_no = 0 GROUP BY path),
now AS (SELECT placed.*, step = max(step) OVER (PARTITION BY path) AS open FROM placed JOIN ends USING (path, segment)),
flags AS (SELECT path, segment, {_latest('time', 'x')} AS current_time, arg_max(x, CASE WHEN kind = 'delta_t' AND open THEN line_no END) AS current_delta_t, {_latest('timing', 'x')} AS execution_seconds, {_latest('timing', 'y')} AS clock_seconds,
  bool_or(coalesce(kind = 'end', false)) AS completed, bool_or(coalesce(kind = 'converged', false)) AS declared_converged, {_latest('fatal', 'label')} AS failure_label, {_latest('fatal', 'line')} AS failure_line, arg_max(region_so_far, CASE WHEN region_so_far IS NOT NULL THEN line_no END) AS region FROM now GROUP BY path, segment),
r AS (SELECT path, count(*) AS n_residuals FROM residuals GROUP BY path), rl AS (SELECT path, list(CAST(line_no AS VARCHAR) || field || initial ORDER BY segment, line_no) AS l FROM residuals GROUP BY path),
s AS (SELECT path, count(*) AS n_steps FROM steps GROUP BY path),
w AS (SELECT path, string_agg(line, '/' ORDER BY segment, line_no) AS warnings FROM (SELECT * FROM events_ WHERE warning QUALIFY row_number() OVER (PARTITION BY path ORDER BY segment DESC, line_no DESC) <= 3) GROUP BY path),
c AS (SELECT path, string_agg(line, '/' ORDER BY place) AS notices FROM (SELECT path, line, min(segment * 1000000000000 + line_no) AS place FROM events_ WHERE kind = 'converged' GROUP BY path, line QUALIFY row_number() OVER (PARTITION BY path ORDER BY place) <= 3) GROUP BY path),
lr AS (SELECT path, string_agg(field || CASE WHEN converged THEN '+' WHEN NOT converged THEN '-' ELSE '' END || coalesce(region, '') || outer_corrector || iterations, '/' ORDER BY segment, line_no) AS last_residuals FROM (SELECT * FROM residuals QUALIFY row_number() OVER (PARTITION BY path ORDER BY segment DESC, line_no DESC) <= 5) GROUP BY path),
ls AS (SELECT path, sum(simulation_time) AS last_times, count(courant_max) AS last_courants, CAST(sum(outer_correctors) AS BIGINT) AS last_correctors FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY path ORDER BY segment DESC, step DESC) <= 5) GROUP BY path)
SELECT flags.path, segment, current_time, current_delta_t, execution_seconds, clock_seconds, completed, declared_converged, failure_label, failure_line, region, coalesce(n_residuals, 0) AS n_residuals, coalesce(n_steps, 0) AS n_steps,
  coalesce(warnings, '') AS warnings, coalesce(notices, '') AS notices, coalesce(last_residuals, '') AS last_residuals, round(coalesce(last_times, 0), 6) AS last_times, coalesce(last_courants, 0) AS last_courants, coalesce(last_correctors, 0) AS last_correctors
FROM flags LEFT JOIN r USING (path) LEFT JOIN s USING (path) LEFT JOIN w USING (path) LEFT JOIN c USING (path) LEFT JOIN lr USING (path) LEFT JOIN ls USING (path)"""


def said(of: DataFrame) -> DataFrame:
    """Rows of telemetry with their arrays as text and sums."""
    mark = F.transform("residuals", lambda r: F.concat(r["field"], F.when(r["converged"], "+").when(~r["converged"], "-").otherwise(""), F.coalesce(r["region"], F.lit("")), r["outer_corrector"].cast("string"), r["iterations"].cast("string")))

    def total(c: str, kind: str):
        return F.aggregate("time_steps", F.lit(0).cast(kind), lambda s, x: s + x[c])

    return of.select(
        *stream.OUT_NAMES[:1], *stream.OUT_NAMES[2:9], F.col("failure.label").alias("failure_label"), F.col("failure.line").alias("failure_line"), "region", "n_residuals", "n_steps",
        F.array_join("warnings", "/").alias("warnings"), F.array_join("notices", "/").alias("notices"), F.array_join(mark, "/").alias("last_residuals"), F.round(total("simulation_time", "double"), 6).alias("last_times"),
        F.size(F.filter("time_steps", lambda x: x["courant_max"].isNotNull())).cast("long").alias("last_courants"), total("outer_correctors", "long").alias("last_correctors"),
    )


@query("log_telemetry", TELEMETRY)
def log_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(stream.telemetry(log_lines(spark, sf_dir), shown=5, most_messages=3))


#: Parts of the lines that the stream below takes one after another.
CHUNKS = 3


@query("stream_log_equality", TELEMETRY)
def stream_log_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as a stream of chunks, each dealt over files by log; the last row that the stream gives for a log."""
    at = f"{scratch(spark)}/log-stream-{uuid.uuid4().hex}"
    lines = log_lines(spark, sf_dir)
    ends = fx.table(spark, sf_dir, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    if ends.a is None:
        return log_telemetry(spark, sf_dir)
    step = (ends.b - ends.a) // CHUNKS + 1
    # a log's lines of a chunk are in one file, and a chunk's files older than the next one's, whichever files a trigger takes
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(CHUNKS):
        # line numbers grow with the segments here, so chunks by number come in order
        part = lines.where(F.col("line_no").between(ends.a + i * step, ends.a + (i + 1) * step - 1))
        part.repartition(files, "path").write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch_number={number}")

    run = stream.stream_telemetry(source, shown=5, most_messages=3).writeStream.outputMode("update").foreachBatch(keep)
    run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    last = rows.groupBy("path").agg(F.max_by(F.struct(*stream.OUT_NAMES[1:]), "batch_number").alias("r")).select("path", "r.*")
    return said(last)


#: A line of the mesher's log of event number e, with n = e % 41; half of the users' logs end.
MESHER_LINE = """CASE e * 5 % 19 WHEN 0 THEN 'Castellated mesh generation' WHEN 1 THEN '  Morph iteration ' || n WHEN 2 THEN 'smoothing displacement iteration ' || n WHEN 3 THEN 'Solving for pointDisplacementY, No Iterations = ' || n
 WHEN 4 THEN 'cells: ' || n || ' faces : ' || e || ' cells: ' || e WHEN 5 THEN 'points:' || n WHEN 6 THEN '--> FOAM Warning : ' || n % 3 WHEN 7 THEN 'warning ' || n % 2 WHEN 8 THEN CASE WHEN user_id % 3 = 0 THEN 'maxGlobalCells ' || n || ' reached' ELSE 'x' END
 WHEN 9 THEN 'ExecutionTime = ' || n || '.5 s  ClockTime = ' || e || ' s ' WHEN 10 THEN CASE WHEN user_id % 4 > 1 THEN ' Adding layers ' || n ELSE 'layer' END WHEN 11 THEN CASE WHEN n = 7 THEN '[3] Segmentation fault (core dumped)' ELSE 'Segmentation faults' END
 WHEN 12 THEN CASE WHEN user_id % 4 > 2 AND n > 20 THEN 'Checking final mesh' ELSE '' END WHEN 13 THEN CASE WHEN user_id % 8 = 7 AND n > 30 THEN 'End' ELSE 'End of it' END WHEN 14 THEN 'Refinement phase ' || n ELSE 'other ' || n END"""
MESHER_LINES = f"lines AS (SELECT user_id AS path, CAST(CASE WHEN day(ts) > 20 THEN 1 ELSE 0 END AS INT) AS segment, e AS line_no, {MESHER_LINE} AS line FROM (SELECT user_id, ts, event_id AS e, event_id % 41 AS n FROM events))"


def _last_of(pattern: str, kind: str = "INT") -> str:
    value = f"TRY_CAST(nullif(regexp_extract(low, '{pattern}', 1), '') AS {kind})"
    return f"arg_max({value}, CASE WHEN failure IS NULL AND low <> 'end' AND {value} IS NOT NULL THEN line_no END)"


@query("mesher_progress", f"""WITH {MESHER_LINES}, bare AS (SELECT path, segment, line_no, trim(line) AS line, lower(trim(line)) AS low FROM lines QUALIFY segment = max(segment) OVER (PARTITION BY path)),
f AS (SELECT *, CASE WHEN starts_with(low, '[3] segmentation fault (core') THEN 'segmentation fault' END AS failure, CASE WHEN failure IS NOT NULL THEN 0 WHEN low = 'end' THEN 5 WHEN low LIKE '%final mesh%' THEN 4 WHEN low LIKE '%adding layers%' THEN 3 WHEN low LIKE '%morph iteration%' THEN 2 WHEN low LIKE 'castellated%' OR low LIKE 'refinement phase%' THEN 1 ELSE 0 END AS rank FROM bare),
s AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f), w AS (SELECT *, CASE WHEN rank = 5 THEN 'snappyHexMesh completed' WHEN rank > 0 AND rank >= before OR rank = 2 OR regexp_matches(low, '^smoothing|pointdisplacement') THEN line END AS work FROM s),
warned AS (SELECT path, line_no, line FROM (SELECT path, line_no, line FROM f WHERE regexp_matches(low, '^(--> )?(foam )?warning |^maxglobalcells')) QUALIFY lag(line) OVER (PARTITION BY path ORDER BY line_no) IS DISTINCT FROM line),
told AS (SELECT path, count(*) AS warning_count FROM warned GROUP BY path), kept AS (SELECT path, string_agg(line, '/' ORDER BY line_no) AS warnings FROM (SELECT * FROM warned QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 4) GROUP BY path),
g AS (SELECT path, max(rank) AS rank, {_last_of('morph iteration ([0-9]+)')} AS morph, {_last_of('(?:^smoothing displacement iteration |no iterations = )([0-9]+)')} AS smoothing, {_last_of('cells: [0-9]+ faces : [0-9]+ cells: ([0-9]+)')} AS cells, {_last_of('faces : ([0-9]+)')} AS faces, {_last_of('points:([0-9]+)')} AS points,
  bool_or(low LIKE 'maxglobalcells%') AS most_cells, arg_max(work, CASE WHEN work IS NOT NULL THEN line_no END) AS current_work, {_last_of('executiontime = ([0-9.]+)', 'DOUBLE')} AS execution_seconds, {_last_of('clocktime = ([0-9.]+)', 'DOUBLE')} AS clock_seconds, arg_max(failure, CASE WHEN failure IS NOT NULL THEN line_no END) AS failure FROM w GROUP BY path)
SELECT g.path, ['initialization', 'castellation', 'snapping', 'layers', 'finalizing', 'completed'][rank + 1] AS stage, morph, smoothing, cells, faces, points, most_cells, rank = 5 AS completed, CASE WHEN rank = 2 THEN least(100.0, CAST(100.0 * morph / 25 AS DOUBLE)) END AS percent, current_work, execution_seconds, clock_seconds, failure,
  coalesce(warning_count, 0) AS warning_count, coalesce(warnings, '') AS warnings FROM g LEFT JOIN told USING (path) LEFT JOIN kept USING (path)""".replace("least(100.0, CAST", "least(CAST(100 AS DOUBLE), CAST"))
def mesher_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").select("user_id", F.col("user_id").alias("path"), F.when(F.dayofmonth("ts") > 20, 1).otherwise(0).alias("segment"), F.col("event_id").alias("line_no"), F.col("event_id").alias("e"), (F.col("event_id") % 41).alias("n"))
    lines = rows.select("path", "segment", "line_no", fx.made(F.expr(MESHER_LINE)).alias("line"))
    return MC.mesher_progress(lines, F.lit(25), most_warnings=4).withColumn("warnings", F.array_join("warnings", "/"))
