"""Reports of mesh checks and of the mesher: counts, metrics, problems, verdicts, the layer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.columns import NUMBER, once
from runsight.functions.staging import staged

# The line formats of mesh-check reports; each metric with its pattern, the group of its value, and whether
# an OK in the line passes it.
COUNT = r"(?i)^(points|faces|internal\s+faces|cells)\s*:\s*(\d+)\b"
REGIONS = r"(?i)\bNumber of regions\s*:\s*(\d+)\b"
AREA = rf"(?i)\bMinimum face area\s*=\s*({NUMBER}).*?Maximum face area\s*=\s*({NUMBER})"
VOLUME = rf"(?i)\bMin(?:imum)? volume\s*=\s*({NUMBER}).*?Max(?:imum)? volume\s*=\s*({NUMBER})"
ORTHOGONAL = rf"(?i)\bMesh non-orthogonality Max\s*:\s*({NUMBER})\s+average\s*:\s*({NUMBER})"
METRICS = (
    ("aspect_ratio_max", rf"(?i)\bMax aspect ratio\s*=\s*({NUMBER})", 1, True),
    ("face_area_min", AREA, 1, True),
    ("face_area_max", AREA, 2, True),
    ("cell_volume_min", VOLUME, 1, True),
    ("cell_volume_max", VOLUME, 2, True),
    ("non_orthogonality_max", ORTHOGONAL, 1, False),
    ("non_orthogonality_average", ORTHOGONAL, 2, False),
    ("skewness_max", rf"(?i)\bMax skewness\s*=\s*({NUMBER})", 1, True),
    ("determinant_min", rf"(?i)\bMin(?:imum)? determinant\s*=\s*({NUMBER})", 1, True),
    ("face_weight_min", rf"(?i)\bMin(?:imum)? face weight\s*=\s*({NUMBER})", 1, True),
    ("volume_ratio_min", rf"(?i)\bMin(?:imum)? volume ratio\s*=\s*({NUMBER})", 1, True),
    ("tet_quality_min", rf"(?i)\bMin(?:imum)? tet quality\s*=\s*({NUMBER})", 1, True),
    ("concavity_max", rf"(?i)\bMax(?:imum)? concav(?:e|ity)\s*=\s*({NUMBER})", 1, True),
    ("cell_openness_max", rf"(?i)\bMax(?:imum)? cell openness\s*=\s*({NUMBER})", 1, True),
)
BOX = rf"(?i)\bOverall domain bounding box\s*\(\s*({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*\)\s*\(\s*({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*\)"
_ONES = r"\(\s*([01])\s+([01])\s+([01])\s*\)"
#: Directions in the newer and the older writing, of the mesh's geometry and of its solution.
DIRECTIONS = {
    "geometric": (rf"(?i)\bMesh has \d+\s+geometric\s+\([^)]*\) directions\s*{_ONES}", rf"(?i)\bMesh \(non-empty, non-wedge\) directions\s*{_ONES}"),
    "solution": (rf"(?i)\bMesh has \d+\s+solution\s+\([^)]*\) directions\s*{_ONES}", rf"(?i)\bMesh \(non-empty\) directions\s*{_ONES}"),
}
ORTHOGONAL_OK = "non-orthogonality check ok"
FATAL = r"(?i)(?:^(?:-->\s*)?FOAM FATAL (?:IO )?ERROR\s*:?$|^Floating point exception(?:\s+\(core dumped\))?$|^Segmentation fault(?:\s+\(core dumped\))?$|^MPI_ABORT was invoked on rank \d+\b)"
MESH_OK = r"(?i)\bMesh OK\s*\."
FAILED = r"(?i)\bFailed\s+(\d+)\s+mesh checks?\s*\."
# What marks a line that counts faulty faces or cells; the codes of problems by what their line holds, in
# the order in which they are tried; and the metric that a problem judges.
MARKERS = ("non-orthogonal", "skew", "negative volume", "face pyramid", "concav", "interpolation weight", "volume ratio", "face twist", "determinant", "illegal", "disconnected", "duplicate", "zero area")
PROBLEM = r"^(.+?)\s*[:=]\s*(\d+)\.?$"
LIMIT = rf"[<>]\s*({NUMBER})"
CODES = (
    (("non-orthogonal", "severely"), "severely_non_orthogonal_faces"),
    (("non-orthogonal",), "non_orthogonality_faces"),
    (("face pyramid",), "face_pyramid_faces"),
    (("concav",), "concave_faces"),
    (("skew",), "highly_skew_faces"),
    (("interpolation weight",), "interpolation_weight_faces"),
    (("volume ratio",), "volume_ratio_faces"),
    (("face twist",), "face_twist_faces"),
    (("determinant",), "low_determinant_cells"),
    (("negative", "volume"), "negative_volume_cells"),
)
JUDGES = {
    "severely_non_orthogonal_faces": "non_orthogonality_max", "non_orthogonality_faces": "non_orthogonality_max", "highly_skew_faces": "skewness_max",
    "concave_faces": "concavity_max", "interpolation_weight_faces": "face_weight_min", "volume_ratio_faces": "volume_ratio_min",
    "low_determinant_cells": "determinant_min", "negative_volume_cells": "cell_volume_min",
}


def stripped(lines: DataFrame) -> DataFrame:
    """lines without blanks at either end of a line, and without empty ones: reports are indented."""
    return lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")


def counts(lines: DataFrame) -> DataFrame:
    """(report, points, faces, internal_faces, cells, regions) of lines (report, line_no, line): the last value of each.
    Internal faces count where one blank is between the words. A report of empty lines alone has no row."""
    name = F.replace(F.lower(F.regexp_extract("line", COUNT, 1)), F.lit(" "), F.lit("_"))
    rows = stripped(lines).withColumns({"name": name, "of": F.regexp_extract("line", COUNT, 2).try_cast("long"), "regions": F.regexp_extract("line", REGIONS, 1).try_cast("long")})

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))

    return rows.groupBy("report").agg(*[last(F.when(F.col("name") == c, F.col("of"))).alias(c) for c in ("points", "faces", "internal_faces", "cells")], last(F.col("regions")).alias("regions"))


def geometry(lines: DataFrame) -> DataFrame:
    """(report, box_min, box_max, geometric_directions, solution_directions): the last bounding box and, as 0 and 1 for x, y
    and z, the last directions in either writing; null where none is reported."""

    def group(pattern: str, i: int, kind: str) -> Column:
        return F.regexp_extract("line", pattern, i).try_cast(kind)

    def last(pattern: str, groups: range, kind: str) -> Column:
        return F.when(F.col("line").rlike(pattern), F.array(*[group(pattern, i, kind) for i in groups]))

    found = {"box_min": last(BOX, range(1, 4), "double"), "box_max": last(BOX, range(4, 7), "double")}
    found |= {f"{name}_directions": F.coalesce(*[last(p, range(1, 4), "int") for p in patterns]) for name, patterns in DIRECTIONS.items()}
    rows = stripped(lines).select("report", "line_no", *[c.alias(name) for name, c in found.items()])
    return rows.groupBy("report").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in found])


def problems(lines: DataFrame) -> DataFrame:
    """(report, line_no, code, n, limit): the lines that count faulty faces or cells: starred ones or with a marker, and a
    whole number at the end. limit: the number behind < or > in front of it."""
    lines = stripped(lines)
    clean = F.regexp_replace("line", r"^[* ]+", "")
    low = F.lower(clean)
    marked = F.col("line").startswith("*")
    for m in MARKERS:
        marked = marked | low.contains(m)
    rows = lines.withColumn("clean", clean).where(marked & ~low.contains("number of regions") & clean.rlike(PROBLEM))
    label = F.trim(F.regexp_extract("clean", PROBLEM, 1))
    code = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    for words, name in reversed(CODES):
        held = F.lit(True)
        for w in words:
            held = held & F.lower(F.col("clean")).contains(w)
        code = F.when(held, name).otherwise(code)
    return rows.select("report", "line_no", code.alias("code"), F.regexp_extract("clean", PROBLEM, 2).try_cast("long").alias("n"), F.regexp_extract(label, LIMIT, 1).try_cast("double").alias("limit"))


def metrics(lines: DataFrame) -> DataFrame:
    """(report, code, observed, status, target): each metric's last value; failing or passing by the last problem or OK line
    that judges it, else passing where its own line says OK, else informational.

    A failing metric stays so when it is reported again; a judgement in front of the first report doesn't count, and a
    target holds until the next report.
    """
    lines = stripped(lines)
    ok = F.when(F.col("line").rlike(r"(?i)\bOK\b"), "passing").otherwise("informational")
    entry = [F.when(F.col("line").rlike(p), F.struct(F.lit(code).alias("code"), F.regexp_extract("line", p, g).try_cast("double").alias("observed"), (ok if says else F.lit("informational")).alias("said"))) for code, p, g, says in METRICS]
    none = F.lit(None)
    told = lines.select("report", "line_no", F.explode(F.array_compact(F.array(*entry))).alias("e")).select("report", F.struct("line_no", F.lit(0).alias("k")).alias("at"), "e.code", "e.observed", "e.said", none.cast("string").alias("judged"), none.cast("double").alias("limit"))
    passed = lines.where(F.lower("line").contains(ORTHOGONAL_OK)).select("report", F.struct("line_no", F.lit(1).alias("k")).alias("at"), F.explode(F.array(F.lit("non_orthogonality_max"), F.lit("non_orthogonality_average"))).alias("code"), F.lit("passing").alias("judged"), none.cast("double").alias("limit"))
    which = F.coalesce(*[F.when(F.col("code") == c, F.lit(m)) for c, m in JUDGES.items()])
    judged = problems(lines).select("report", F.struct("line_no", F.lit(2).alias("k")).alias("at"), which.alias("code"), F.when(F.col("n") > 0, "failing").otherwise("passing").alias("judged"), "limit").where("code IS NOT NULL")
    rows = told.unionByName(passed, allowMissingColumns=True).unionByName(judged, allowMissingColumns=True)
    key = Window.partitionBy("report", "code")
    is_told = F.col("said").isNotNull()
    rows = rows.withColumns({"first": F.min(F.when(is_told, F.col("at"))).over(key), "last": F.max(F.when(is_told, F.col("at"))).over(key)}).where("at >= first")
    of = rows.groupBy("report", "code").agg(
        F.max_by("observed", F.when(is_told, F.col("at"))).alias("observed"), F.max_by("said", F.when(is_told, F.col("at"))).alias("said"),
        F.max_by("judged", F.when(F.col("judged").isNotNull(), F.col("at"))).alias("judged"), F.max(F.when(F.col("judged").isNotNull(), F.col("at"))).alias("judged_at"), F.first("last").alias("last"),
        F.max_by("limit", F.when(F.col("limit").isNotNull() & (F.col("at") > F.col("last")), F.col("at"))).alias("target"),
    )
    status = F.when((F.col("judged") == "failing") | (F.col("judged_at") > F.col("last")), F.col("judged")).otherwise(F.col("said"))
    return of.select("report", "code", "observed", status.alias("status"), "target")


def verdict(lines: DataFrame, exits: DataFrame) -> DataFrame:
    """(report, mesh_ok, failed_checks, status) by the lines and exits (report, exit_code)."""
    rows = stripped(lines).select("report", "line_no", F.col("line").rlike(FATAL).alias("fatal"), F.when(F.col("line").rlike(FAILED), False).when(F.col("line").rlike(MESH_OK), True).alias("ok"), F.regexp_extract("line", FAILED, 1).try_cast("long").alias("failed"))
    of = rows.groupBy("report").agg(F.bool_or("fatal").alias("fatal"), F.max_by("ok", F.when(F.col("ok").isNotNull(), F.col("line_no"))).alias("mesh_ok"), F.max_by("failed", F.when(F.col("failed").isNotNull(), F.col("line_no"))).alias("failed_checks"))
    out = exits.join(of, "report", "left")
    bad = ~F.coalesce(F.col("exit_code") == 0, F.lit(False)) | F.coalesce("fatal", F.lit(False)) | F.coalesce(~F.col("mesh_ok"), F.lit(False))
    return out.select("report", "mesh_ok", "failed_checks", F.when(bad, "failing").when(F.col("mesh_ok"), "passing").otherwise("indeterminate").alias("status"))


# The mesher's lines and stages.
MORPH = r"(?i)\bMorph\s+iteration\s+(\d+)\b"
SMOOTHING = r"(?i)\b(?:smooth(?:ing)?\s+displacement|displacement\s+smoothing)(?:\s*[:=-]?\s*iteration)?\s+(\d+)\b"
DISPLACEMENT = r"(?i)\bSolving for\s+pointDisplacement\w*\b.*\bNo Iterations\s*(?:=\s*)?(\d+)\b"
MOST_CELLS = r"(?i)\bmaxGlobalCells\b.*\b(?:reached|exceeded|stopp(?:ed|ing))\b"
STAGES = (
    ("completed", 5, r"^End\s*$"),
    ("finalizing", 4, r"(?i)\b(?:finalis(?:e|ing)|finaliz(?:e|ing)|checking final mesh|final mesh)\b"),
    ("layers", 3, r"(?i)\b(?:layer addition|adding layers|add layers)\b"),
    ("snapping", 2, r"(?i)\b(?:snapping phase|mesh snapping|morph iteration)\b"),
    ("castellation", 1, r"(?i)\b(?:castellated mesh generation|mesh refinement|refinement phase)\b"),
)


TIMING = rf"(?i)^ExecutionTime\s*=\s*({NUMBER})\s+s\s+ClockTime\s*=\s*({NUMBER})\s+s$"
WARNING = r"(?i)^(?:-->)?\s*(?:FOAM\s+)?Warning\b"
_RANK = r"(?i)^(?:\[\d+\]\s*)?"
FAILURES = (
    ("FOAM fatal error", _RANK + r"(?:-->\s*)?FOAM FATAL (?:IO )?ERROR\s*:$"),
    ("floating point exception", _RANK + r"Floating point exception(?:\s+\(core dumped\))?$"),
    ("segmentation fault", _RANK + r"Segmentation fault(?:\s+\(core dumped\))?$"),
    ("MPI abort", _RANK + r"MPI_ABORT was invoked on rank \d+\b"),
)
DONE = "snappyHexMesh completed"


def mesher_progress(lines: DataFrame, relax: Column, most_warnings: int = 200) -> DataFrame:
    """(path, stage, morph, smoothing, cells, faces, points, most_cells, completed, percent, current_work, execution_seconds,
    clock_seconds, failure, warning_count, warnings) of the latest segment in each path's lines (path, segment, line_no,
    line; without segment all are one).

    The furthest stage, the last numbers (of a count that a line has several times the last), while snapping the percentage
    of relax morph iterations; the last line that says what is worked on; warnings without immediate repeats, the last
    most_warnings of them and how many there were. A failure's line says nothing else.
    """
    told_of = ["path", *[c for c in ("segment",) if c in lines.columns]]
    rows = lines.select(*told_of, "line_no", once(line=F.regexp_replace("line", r"^\s+|\s+$", "")))
    failure = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(label)) for label, p in FAILURES])
    rows = rows.select("*", once(failure=failure))
    told = F.when(F.col("failure").isNull(), F.col("line"))
    rank = F.lit(0)
    for _, n, pattern in reversed(STAGES):
        rank = F.when(told.rlike(pattern), n).otherwise(rank)
    going = ~told.rlike(STAGES[0][2])  # the line that ends it has nothing else

    def number(pattern: str, kind: str = "int", group: int = 1) -> Column:
        return F.when(going, F.regexp_extract(told, pattern, group).try_cast(kind))

    # every line is read once, and only those that say something go on
    rows = rows.select("*", once(
        rank=rank, morph=number(MORPH), smoothing=F.coalesce(number(SMOOTHING), number(DISPLACEMENT)), execution_seconds=number(TIMING, "double"), clock_seconds=number(TIMING, "double", 2),
        **{c: F.when(going, F.try_element_at(F.regexp_extract_all(told, F.lit(rf"(?i)\b{c}\s*:\s*(\d+)\b"), F.lit(1)), F.lit(-1)).try_cast("int")) for c in ("cells", "faces", "points")},
        full=F.coalesce(told.rlike(MOST_CELLS), F.lit(False)), warns=F.coalesce(told.rlike(WARNING), F.lit(False)),
    ))
    rows = rows.where((F.col("rank") > 0) | F.col("failure").isNotNull() | F.col("full") | F.col("warns") | F.coalesce("morph", "smoothing", "cells", "faces", "points").isNotNull() | F.col("clock_seconds").isNotNull())
    paths = lines.groupBy("path").agg(F.max("segment").alias("latest")) if "segment" in lines.columns else lines.select("path").distinct()
    rows = staged(rows, "mesher-lines")
    if "segment" in lines.columns:
        paths = staged(paths, "mesher-logs")
        rows = rows.join(paths, "path").where("segment = latest").drop("latest")
    order = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("before", F.coalesce(F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    work = F.when(F.col("rank") == 5, F.lit(DONE)).when(((F.col("rank") > 0) & (F.col("rank") >= F.col("before"))) | F.col("morph").isNotNull() | F.col("smoothing").isNotNull(), F.col("line"))
    rows = rows.withColumn("work", work)
    # a line may warn twice, by its word and by its limit; the second is a repeat of the first
    warned = rows.where(F.col("warns") | F.col("full")).withColumn("previous", F.lag("line").over(order)).where(~F.col("line").eqNullSafe(F.col("previous")))
    warned = warned.withColumns({"k": F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no"))), "n": F.count(F.lit(1)).over(Window.partitionBy("path"))})
    warned = warned.where(F.col("k") <= most_warnings).groupBy("path").agg(F.first("n").alias("warning_count"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("warnings"))

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)

    of = rows.groupBy("path").agg(F.max("rank").alias("rank"), *[last(c) for c in ("morph", "smoothing", "cells", "faces", "points", "execution_seconds", "clock_seconds", "failure", "work")], F.bool_or("full").alias("most_cells"))
    of = paths.select("path").join(of, "path", "left").join(warned, "path", "left")
    stage = F.lit("initialization")
    for name, n, _ in STAGES:
        stage = F.when(F.col("rank") == n, name).otherwise(stage)
    percent = F.when((F.col("rank") == 2) & (relax > 0), F.least(F.lit(100.0), 100.0 * F.col("morph") / relax))
    return of.select(
        "path", stage.alias("stage"), "morph", "smoothing", "cells", "faces", "points", F.coalesce("most_cells", F.lit(False)).alias("most_cells"), F.coalesce(F.col("rank") == 5, F.lit(False)).alias("completed"), percent.alias("percent"),
        F.col("work").alias("current_work"), "execution_seconds", "clock_seconds", "failure", F.coalesce("warning_count", F.lit(0)).cast("long").alias("warning_count"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


LAYER_HEADER = r"(?i)^patch\s+faces\s+layers\s+overall\s+thickness$"
LAYER_ROW = rf"^(.*\S)\s+([+-]?\d+)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})$"
#: Two or three numbers at the end: a row that is cut off.
CUT_ROW = rf"^(?:.*\s)?{NUMBER}\s+{NUMBER}$"


def layer_table(lines: DataFrame) -> DataFrame:
    """(path, line_no, patch, faces, average_layers, thickness, percent): the rows of the last whole layer table of each
    path's lines (path, line_no, line).

    A header opens a table, ruled and processor lines don't count, and the first other line that isn't a row closes it. A
    table that a cut-off row closes, that nothing has closed yet or that has no rows doesn't count.
    """
    text = F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), r"^\[\d+\]\s*", "")
    order = Window.partitionBy("path").orderBy("line_no")
    rows = lines.withColumn("text", text).where("text <> ''").withColumn("table", F.count_if(F.col("text").rlike(LAYER_HEADER)).over(order)).where("table > 0")
    head, row = F.col("text").rlike(LAYER_HEADER), F.col("text").rlike(LAYER_ROW)
    other = ~head & ~row & ~F.col("text").startswith("[") & ~F.col("text").rlike(r"^[- ]+$")
    rows = rows.withColumns({"row": row, "closes": F.when(other, F.col("line_no"))})
    rows = rows.withColumn("end", F.min("closes").over(Window.partitionBy("path", "table")))
    rows = rows.withColumn("closed_by", F.max(F.when(F.col("line_no") == F.col("end"), F.col("text"))).over(Window.partitionBy("path", "table")))
    # a header closes the table in front of it as well
    rows = rows.withColumn("last", F.max("table").over(Window.partitionBy("path")))
    inside = rows.where(F.col("row") & (F.col("end").isNull() | (F.col("line_no") < F.col("end"))))
    whole = F.when(F.col("end").isNull(), F.col("table") < F.col("last")).otherwise(~F.col("closed_by").rlike(CUT_ROW))
    inside = inside.where(whole).withColumn("newest", F.max("table").over(Window.partitionBy("path"))).where("table = newest")
    part = [F.regexp_extract("text", LAYER_ROW, i) for i in range(1, 6)]
    return inside.select("path", "line_no", F.regexp_replace(part[0], r"\s+", " ").alias("patch"), part[1].try_cast("int").alias("faces"), part[2].try_cast("double").alias("average_layers"), part[3].try_cast("double").alias("thickness"), part[4].try_cast("double").alias("percent"))
