"""What a run has to offer: candidate scores, the choice of a log, notices, retained output, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.columns import finite

# Words that mark what a series measures, by what they are worth.
WORTH = (
    (80, ("force", "flow", "flux", "pressuredifference", "pressure_difference", "power")),
    (70, ("average", "integral", "heattransfer", "species", "phase", "interface")),
    (60, ("probe",)),
)
DIAGNOSTIC = ("solverinfo", "executiontime", "clocktime", "courant", "diagnostic")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# What a candidate's explanation says of each of its points.
REASONS = {
    80: "Force, flow, flux, pressure-difference, or power output (+80).", 70: "Average, integral, heat-transfer, species, phase, or interface output (+70).", 60: "Named probe output (+60).",
    20: "At least 50 finite samples (+20).", 10: "At least 20 finite samples (+10).", -60: "Numerical-only diagnostic (-60).", "constant": "Constant series after 20 samples (-20).",
    "stale": "Stale post-processing output (-20).", None: "No candidate-ranking factor applied.",
}


def _points() -> list[Column]:
    """The points of a series, each a number or null: for what it measures, its samples, diagnostics, being constant, being stale."""
    text = F.lower(F.concat_ws(" ", "function_name", "function_type", "field", F.coalesce("operation", F.lit(""))))
    worth = F.lit(None).cast("int")
    for points, words in reversed(WORTH):
        worth = F.when(_any(text, words), points).otherwise(worth)
    return [
        worth, F.when(F.col("n") >= 50, 20).when(F.col("n") >= 20, 10), F.when(_any(text, DIAGNOSTIC), -60),
        F.when((F.col("n") >= 20) & F.col("constant"), -20), F.when(F.col("stale"), -20),
    ]


def explanation() -> Column:
    """Why a series has its score: a sentence for each of its points. Over the columns that candidate_score takes."""
    worth, samples, diagnostic, constant, stale_ = _points()
    of_worth = F.when(worth == 80, REASONS[80]).when(worth == 70, REASONS[70]).when(worth == 60, REASONS[60])
    of_samples = F.when(samples == 20, REASONS[20]).when(samples == 10, REASONS[10])
    said = F.concat_ws(" ", of_worth, of_samples, F.when(diagnostic.isNotNull(), REASONS[-60]), F.when(constant.isNotNull(), REASONS["constant"]), F.when(stale_.isNotNull(), REASONS["stale"]))
    return F.when(said == "", REASONS[None]).otherwise(said)


def candidate_score(series: DataFrame) -> DataFrame:
    """series (function_name, function_type, field, operation, n, constant, stale, ...) with score, confidence and recommended."""
    first, *others = [F.coalesce(p, F.lit(0)) for p in _points()]
    out = series.withColumn("score", sum(others, first))
    return out.withColumn("confidence", F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low")).withColumn("recommended", F.col("score") >= 70)


def log_score(logs: DataFrame) -> DataFrame:
    """logs (explicit, saved, application, banner, solver_record, age_seconds, at_root, workflow, size, ...) with score."""
    def points(flag: Column, n: int) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0)

    parts = [
        points(F.col("explicit"), 1000), points(F.col("saved"), 900), points(F.col("application"), 200), points(F.col("banner"), 50), points(F.col("solver_record"), 50),
        points(F.col("age_seconds") <= 120, 25), points(F.col("at_root"), 10), points(F.col("workflow") == "utility", -300), points(F.col("size") == 0, -25),
    ]
    return logs.withColumn("score", sum(parts[1:], parts[0]))


def ranked_logs(logs: DataFrame) -> DataFrame:
    """logs with rank from 1: explicit, then saved, then others; of those recognised workflows, then newest, then by path."""
    first = F.when(F.col("explicit"), 0).when(F.col("saved"), 1).otherwise(2)
    known = F.when(F.col("workflow") == "unknown", 1).otherwise(0)
    return logs.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(first, known, F.desc("modified_ns"), "path")))


# The tools that prepare a case, the mesher among them, and what only a solver writes.
MESHER = r"(?i)\bsnappyHexMesh\b"
UTILITY = r"(?i)\b(?:blockMesh|checkMesh|decomposePar|reconstructPar|foamToVTK|renumberMesh|snappyHexMesh)\b"
SOLVER_RECORD = r"(?i)(?:\bTime\s*=|\bSolving for\b|\bInitial residual\b|\bFinal residual\b)"


def log_workflow(logs: DataFrame) -> DataFrame:
    """logs (name, head, tail, application, ...) with workflow. head and tail: the first and last 64 KiB of a log's text.

    The mesher's name anywhere makes it the mesher's log, another tool's in its name or head a utility's; a solver's record in
    the tail, or the application in the name or, as a word, in the head a solver's.
    """
    application = F.lower(F.coalesce("application", F.lit("")))
    word = F.concat(F.lit(r"(?i)\b\Q"), "application", F.lit(r"\E\b"))
    applied = (application != "") & (F.contains(F.lower("name"), application) | F.coalesce(F.rlike("head", word), F.lit(False)))
    everywhere = F.concat_ws("\n", "name", "head", "tail")
    workflow = (
        F.when(everywhere.rlike(MESHER), "snappy_hex_mesh").when(F.col("name").rlike(UTILITY) | F.col("head").rlike(UTILITY), "utility")
        .when(F.col("tail").rlike(SOLVER_RECORD) | applied, "solver").otherwise("unknown")
    )
    return logs.withColumn("workflow", workflow)


#: What a log's head says where it is of the toolbox; a log is recent for so many seconds.
BANNER, RECENT = "openfoam", 120.0


def log_candidates(files: DataFrame, cases: DataFrame, now: Column) -> DataFrame:
    """The candidates for the log of each case: files (case, path, modified_ns, size, head, tail), paths below the case, with
    workflow, score and rank; cases (case, application, explicit_log, saved_log), the logs as paths below the case.

    head and tail are the first and last 64 KiB (sources/logs.py log_ends). An explicit or saved log that isn't among files
    is none. A score is the sum of log_score(); the order that of ranked_logs().
    """
    named = files.join(cases, "case").withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = log_workflow(named)
    application = F.lower(F.coalesce("application", F.lit("")))
    word = F.concat(F.lit(r"(?i)\b\Q"), "application", F.lit(r"\E\b"))
    flags = {
        "explicit": F.coalesce(F.col("path") == F.col("explicit_log"), F.lit(False)), "saved": F.coalesce(F.col("path") == F.col("saved_log"), F.lit(False)),
        "applied": (application != "") & (F.contains(F.lower("name"), application) | F.coalesce(F.rlike("head", word), F.lit(False))),
        "banner": F.contains(F.lower("head"), F.lit(BANNER)), "solver_record": F.col("tail").rlike(SOLVER_RECORD), "at_root": ~F.contains("path", F.lit("/")), "age_seconds": now - F.col("modified_ns") / 1e9,
    }
    scored = log_score(rows.withColumns(flags).withColumn("application_name", F.col("application")).withColumn("application", F.col("applied")))
    kept = [c for c in files.columns if c not in ("head", "tail")]
    return ranked_logs(scored.select(*kept, "explicit", "saved", "workflow", "score"))


def parsed_anything() -> Column:
    """Whether rows of telemetry (streaming/logs.py) say anything of a run: a time, a residual, a step, a running time, a failure
    or an end."""
    said = F.coalesce(F.col("current_time"), F.col("execution_seconds"), F.col("clock_seconds")).isNotNull()
    return said | (F.col("n_residuals") > 0) | (F.col("n_steps") > 0) | F.col("failure").isNotNull() | F.coalesce(F.col("completed"), F.lit(False))


def chosen_log(logs: DataFrame, active: Column | None = None) -> DataFrame:
    """The log of each case that is followed, of ranked_logs() with score: the explicit one, else the saved one, else the first
    whose workflow is active; else the newest mesher's if it is newer than the best solver's (by score, then age), else that,
    else the first in rank."""
    active = F.lit(False) if active is None else F.coalesce(active, F.lit(False))
    solver, mesher = F.col("workflow") == "solver", F.col("workflow") == "snappy_hex_mesh"
    row = F.struct("path", "modified_ns")

    def first(flag: Column) -> Column:
        return F.min_by(row, F.when(flag, F.col("rank")))

    best = F.max_by(row, F.when(solver, F.struct("score", "modified_ns", (-F.col("rank")).alias("early"))))
    newest = F.max_by(row, F.when(mesher, F.struct("modified_ns", (-F.col("rank")).alias("early"))))
    of = logs.groupBy("case").agg(first(F.col("explicit")).alias("e"), first(F.col("saved")).alias("s"), first(active).alias("a"), best.alias("b"), newest.alias("m"), first(F.lit(True)).alias("any"))
    newer = F.when(F.col("m").isNotNull() & (F.col("b").isNull() | (F.col("m.modified_ns") > F.col("b.modified_ns"))), F.col("m"))
    return of.select("case", F.coalesce("e", "s", "a", newer, "b", "any")["path"].alias("path"))


#: Seconds after which a solver's and a mesher's log are no longer a running process's.
SOLVER_STALE, MESHER_STALE = 90.0, 300.0


def process_state(runs: DataFrame) -> DataFrame:
    """runs (found, has_log, mesher, age_seconds, mesher_failed, mesher_completed, failed, completed, current_time, end_time,
    parsed, ...) with state; found: whether the process is there, parsed: whether anything was read from the log."""
    def is_(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    limit = F.when(is_("mesher"), MESHER_STALE).otherwise(SOLVER_STALE)
    fresh = is_("has_log") & F.coalesce(F.col("age_seconds") <= limit, F.lit(False))
    state = (
        F.when(is_("found"), "running").when(is_("mesher") & is_("mesher_failed"), "failed").when(is_("mesher") & is_("mesher_completed"), "completed")
        .when(is_("failed"), "failed").when(is_("completed") | F.coalesce(F.col("current_time") >= F.col("end_time"), F.lit(False)), "completed")
        .when(fresh, "running").when(is_("mesher") & is_("has_log") & F.coalesce(F.col("age_seconds") > limit, F.lit(False)), "stale")
        .when(is_("has_log") & (is_("parsed") | is_("mesher")), "stopped").otherwise("not_started")
    )
    return runs.withColumn("state", state)


def record_signal(*fields: Column) -> Column:
    """The largest absolute value of a record's finite fields, 0 without any: what its envelope goes by."""
    return F.coalesce(F.greatest(F.lit(0.0), *[F.when(finite(f), F.abs(f)) for f in fields]), F.lit(0.0))


def missing_selected(selected: DataFrame, known: DataFrame) -> DataFrame:
    """selected (case, id, ...) whose series isn't among known (case, id)."""
    return selected.join(known, ["case", "id"], "left_anti")


def bounded_notices(notices: DataFrame, most: int = 300) -> DataFrame:
    """(seq, severity, source, message, total) of notices (case, seq, ...): the first of equal ones, and of more than
    most the errors, then those that aren't from the solver's log, then the newest; total counts all different ones."""
    once = notices.groupBy("case", "severity", "source", "message").agg(F.min("seq").alias("seq"))
    once = once.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("case")))
    order = [F.when(F.col("severity") == "error", 0).otherwise(1), F.when(F.col("source") == "solver_log", 1).otherwise(0), F.desc("seq")]
    kept = once.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(*order))).where(F.col("rank") <= most)
    return kept.select("case", "seq", "severity", "source", "message", "total")


def retained_output(lines: DataFrame, important: Column, most: int = 200) -> DataFrame:
    """lines (case, seq, line) that are among the last most, or the last most important ones; each once."""
    w = Window.partitionBy("case").orderBy(F.desc("seq"))
    last = lines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    marked = lines.where(important).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return last.unionByName(marked).dropDuplicates(["case", "seq"])


def stale(modified_ns: Column, now: Column, limit_seconds: Column) -> Column:
    return now - modified_ns / 1e9 > limit_seconds


def signature(files: DataFrame) -> DataFrame:
    """(case, newest_ns, bytes, files) of files (case, modified_ns, size): unchanged files have an unchanged signature."""
    return files.groupBy("case").agg(F.max("modified_ns").alias("newest_ns"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
