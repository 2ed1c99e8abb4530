"""Solver logs: lines to events, events to residuals and time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.columns import NUMBER, once

_REGION = r"(?:([A-Za-z_][\w.-]*)\s*:\s*)?"
_RANK = r"(?:\[\d+\]\s*)?"

# The line formats of solver logs, in the order in which they are tried; the first that matches wins.
FATAL = (
    ("Floating point exception", rf"(?i)^\s*{_RANK}Floating point exception(?:\s+\(core dumped\))?\s*$"),
    ("Segmentation fault", rf"(?i)^\s*{_RANK}Segmentation fault(?:\s+\(core dumped\))?\s*$"),
    ("MPI abort", rf"(?i)^\s*{_RANK}MPI_ABORT was invoked on rank \d+\b"),
    ("Fatal error", rf"(?i)^\s*{_RANK}(?:-->\s*)?FOAM FATAL (?:IO )?ERROR\s*:\s*$"),
    ("Fatal error", rf"(?i)^\s*{_RANK}FATAL ERROR\s*:\s*$"),
)
WARNING = r"(?i)^(?:-->)?\s*(?:FOAM\s+)?WARNING\b"
FORMATS = (
    ("region", r"(?i)^Region\s*:?[ \t]*([A-Za-z_][\w.-]*)\s*$"),
    ("time", rf"^{_REGION}Time\s*=\s*({NUMBER})\s*$"),
    ("delta_t", rf"^{_REGION}deltaT\s*=\s*({NUMBER})\s*$"),
    ("solve", rf"(?i)^{_REGION}([^:]+):\s+Solving for\s+([^,]+),\s*Initial residual\s*=\s*({NUMBER}),\s*Final residual\s*=\s*({NUMBER}),\s*No Iterations\s*(?:=\s*)?(\d+)(.*)$"),
    ("mesh_courant", rf"(?i)^{_REGION}Mesh Courant Number\s+mean:\s*({NUMBER})\s+max:\s*({NUMBER})\s*$"),
    ("courant", rf"(?i)^{_REGION}Courant Number\s+mean:\s*({NUMBER})\s+max:\s*({NUMBER})\s*$"),
    ("continuity", rf"(?i)^{_REGION}time step continuity errors\s*:\s*sum local\s*=\s*({NUMBER}),\s*global\s*=\s*({NUMBER}),\s*cumulative\s*=\s*({NUMBER})\s*$"),
    ("corrector", rf"(?i)^{_REGION}(?:PIMPLE|PISO|SIMPLE)\s*:\s*(?:outer\s+)?iteration\s+(\d+)\s*$"),
    ("timing", rf"(?i)^ExecutionTime\s*=\s*({NUMBER})\s+s\s+ClockTime\s*=\s*({NUMBER})\s+s\s*$"),
)
CONVERGED = r"(?i)(?:\b(?:converged|satisfied|met)\b.*\bconvergence criteria\b|\bconvergence criteria\b.*\b(?:converged|satisfied|met)\b)"
NOT_CONVERGED = r"(?i)\b(?:not|failed|failure|unsatisfied|unmet)\b"
END = r"^End\s*$"
UNSOLVED = r"\b(?:not\s+converged|failed|failure)\b"
SOLVED = r"\bconverged\b"

#: Group numbers of the formats: region, then the numbers in x, y, z.
GROUPS = {"time": (2,), "delta_t": (2,), "solve": (4, 5, 6), "mesh_courant": (2, 3), "courant": (2, 3), "continuity": (2, 3, 4), "corrector": (2,), "timing": (1, 2)}
PATTERN = dict(FORMATS)


def extract(lines: DataFrame) -> DataFrame:
    """lines (path, segment, line_no, line) with kind, label, region, field, x, y, z, converged and warning.

    One pass: kind by the first format that matches, then only that format's groups. Lines of no format have a null
    kind, a null line too. x, y, z are the format's numbers in order; of a solve the initial and final residual and
    the iterations.
    """
    line = F.col("line")
    label = F.coalesce(*[F.when(line.rlike(p), F.lit(name)) for name, p in FATAL])
    kind = F.when(F.col("label").isNotNull(), "fatal")
    for name, pattern in FORMATS:
        kind = kind.when(line.rlike(pattern), name)
    kind = kind.when(line.rlike(CONVERGED) & ~line.rlike(NOT_CONVERGED), "converged").when(line.rlike(END), "end")
    # patterns are tried once a line, whatever filters or reads their outcome later
    warning = F.coalesce(F.col("label").isNull() & line.rlike(WARNING), F.lit(False))
    rows = lines.select("*", once(label=label)).select("*", once(kind=kind, warning=warning))

    def group(n_of: int) -> Column:
        out = F.lit(None).cast("double")
        for name, groups in GROUPS.items():
            if n_of < len(groups):
                out = F.when(F.col("kind") == name, F.regexp_extract(line, PATTERN[name], groups[n_of]).try_cast("double")).otherwise(out)
        return out

    region = F.when(F.col("kind") == "region", F.regexp_extract(line, PATTERN["region"], 1))
    for name in ("time", "delta_t", "solve", "mesh_courant", "courant", "continuity", "corrector"):
        region = region.when(F.col("kind") == name, F.nullif(F.regexp_extract(line, PATTERN[name], 1), F.lit("")))
    is_solve = F.col("kind") == "solve"
    suffix = F.lower(F.regexp_extract(line, PATTERN["solve"], 7))
    converged = F.when(is_solve & suffix.rlike(UNSOLVED), False).when(is_solve & suffix.rlike(SOLVED), True)
    field = F.when(is_solve, F.trim(F.regexp_extract(line, PATTERN["solve"], 3)))
    return rows.select(*lines.columns, "kind", "label", region.alias("region"), field.alias("field"), group(0).alias("x"), group(1).alias("y"), group(2).alias("z"), converged.alias("converged"), "warning")


def in_steps(events: DataFrame) -> DataFrame:
    """events with step (the Time records so far in the segment), simulation_time, region_so_far and corrector_so_far.

    A region, of a Region line or in front of a Time record, holds until the segment ends; the corrector number runs up
    within a step.
    """
    order = Window.partitionBy("path", "segment").orderBy("line_no")
    rows = events.withColumn("step", F.sum(F.when(F.col("kind") == "time", 1).otherwise(0)).over(order))
    within = Window.partitionBy("path", "segment", "step").orderBy("line_no")
    return rows.withColumns(
        {
            "simulation_time": F.last(F.when(F.col("kind") == "time", F.col("x")), ignorenulls=True).over(order),
            "region_so_far": F.last(F.when(F.col("kind").isin("region", "time"), F.col("region")), ignorenulls=True).over(order),
            "corrector_so_far": F.coalesce(F.max(F.when(F.col("kind") == "corrector", F.col("x"))).over(within), F.lit(0.0)).cast("int"),
        }
    )


def residuals(events: DataFrame) -> DataFrame:
    """(path, segment, line_no, step, simulation_time, field, initial, final, iterations, converged, region, outer_corrector):
    a row for each linear solve behind the first Time record. events may be in_steps() already."""
    rows = (events if "step" in events.columns else in_steps(events)).where("kind = 'solve' AND step > 0")
    return rows.select(
        "path", "segment", "line_no", "step", "simulation_time", "field", F.col("x").alias("initial"), F.col("y").alias("final"), F.col("z").cast("int").alias("iterations"),
        "converged", F.coalesce("region", "region_so_far").alias("region"), F.col("corrector_so_far").alias("outer_corrector"),
    )


def time_steps(events: DataFrame) -> DataFrame:
    """A row for each Time record, with the last value in the step of what its lines report. events may be in_steps() already."""

    def latest(kind: str, c: str) -> Column:
        return F.max_by(c, F.when(F.col("kind") == kind, F.col("line_no")))

    rows = (events if "step" in events.columns else in_steps(events)).where("step > 0")
    return rows.groupBy("path", "segment", "step").agg(
        latest("time", "x").alias("simulation_time"), latest("delta_t", "x").alias("delta_t"),
        latest("courant", "x").alias("courant_mean"), latest("courant", "y").alias("courant_max"),
        latest("mesh_courant", "x").alias("mesh_courant_mean"), latest("mesh_courant", "y").alias("mesh_courant_max"),
        latest("continuity", "x").alias("continuity_local"), latest("continuity", "y").alias("continuity_global"), latest("continuity", "z").alias("continuity_cumulative"),
        F.max("corrector_so_far").alias("outer_correctors"),
    )


def run_flags(events: DataFrame) -> DataFrame:
    """(path, completed, declared_converged, failure, execution_time, clock_time) of each log's latest segment."""
    latest = events.groupBy("path").agg(F.max("segment").alias("segment"))
    rows = events.join(latest, ["path", "segment"])

    def last(kind: str, c: str) -> Column:
        return F.max_by(c, F.when(F.col("kind") == kind, F.col("line_no")))

    return rows.groupBy("path").agg(
        F.coalesce(F.bool_or(F.col("kind") == "end"), F.lit(False)).alias("completed"),
        F.coalesce(F.bool_or(F.col("kind") == "converged"), F.lit(False)).alias("declared_converged"),
        last("fatal", "label").alias("failure"),
        last("timing", "x").alias("execution_time"),
        last("timing", "y").alias("clock_time"),
    )


def monotone_stage(events: DataFrame, rank: Column) -> DataFrame:
    """events (path, segment, line_no, ...) with stage: the largest rank so far, so that a stage never goes back."""
    return events.withColumn("stage", F.max(rank).over(Window.partitionBy("path", "segment").orderBy("line_no")))


def dedupe_consecutive(rows: DataFrame, message: str, *order: str) -> DataFrame:
    """rows whose message differs from the one in front, and total, the rows there were."""
    w = Window.partitionBy("path").orderBy(*order)
    marked = rows.withColumns({"before": F.lag(message).over(w), "first": F.row_number().over(w) == 1, "total": F.count(F.lit(1)).over(Window.partitionBy("path"))})
    return marked.where(F.col("first") | ~F.col("before").eqNullSafe(F.col(message))).drop("before", "first")
