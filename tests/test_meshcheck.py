"""Mesh-check reports, the mesher's progress, the layer table, log choice and process states."""

from pyspark.sql import functions as F

from runsight.operators import catalog as C
from runsight.operators import mesh
from runsight.operators import meshcheck as M


def frame(spark, text, name="report"):
    return spark.createDataFrame([("r", i, f"{' ' * (i % 5)}{x}{' ' * (i % 3)}") for i, x in enumerate(text.split("\n"))], f"{name} string, line_no long, line string")


REPORT = """points: 120
internal faces: 40
cells:  77
Number of regions: 2
Max aspect ratio = 4.5 OK.
Minimum face area = 1e-4. Maximum face area = 0.5.  Face area magnitudes OK.
Mesh non-orthogonality Max: 71.5 average: 12.5
***Number of severely non-orthogonal (> 70 degrees) faces: 3.
Non-orthogonality check OK.
Max skewness = 5.1
***Max skewness check, 2 highly skew faces > 4: 2
Max skewness = 4.9 OK
<<Writing 3 faces
illegal thing = 7
Failed 1 mesh checks."""


def test_mesh_report(spark):
    lines = frame(spark, REPORT)
    assert M.counts(lines).collect()[0].asDict() == {"report": "r", "points": 120, "faces": None, "internal_faces": 40, "cells": 77, "regions": 2}
    got = {r.code: (r.observed, r.status, r.target) for r in M.metrics(lines).collect()}
    assert got == {
        "aspect_ratio_max": (4.5, "passing", None), "face_area_min": (1e-4, "passing", None), "face_area_max": (0.5, "passing", None),
        "non_orthogonality_max": (71.5, "passing", 70.0), "non_orthogonality_average": (12.5, "passing", None), "skewness_max": (4.9, "failing", None),
    }
    assert [(r.code, r.n, r.limit) for r in M.problems(lines).orderBy("line_no").collect()] == [("severely_non_orthogonal_faces", 3, 70.0), ("highly_skew_faces", 2, 4.0), ("illegal_thing", 7, None)]


INDENTED = """Mesh stats
    points:           120
    faces:            330
    internal faces:   270
    cells:            100
\t
    Number of regions: 1 (OK).
    Overall domain bounding box (0 -1e-3 .5) (1 2 3)
    Mesh has 3 geometric (non-empty/wedge) directions (1 1 0)
    Mesh has 3 solution (non-empty) directions (1 1 1)
   *Number of faces with skewness > 4 = 3
 ***Some odd things: 4 \nMesh OK. """


def test_indented_reports(spark):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(INDENTED.split("\n"))], "report string, line_no long, line string")
    assert M.counts(lines).collect()[0].asDict() == {"report": "r", "points": 120, "faces": 330, "internal_faces": 270, "cells": 100, "regions": 1}
    assert [(r.code, r.n, r.limit) for r in M.problems(lines).orderBy("line_no").collect()] == [("highly_skew_faces", 3, 4.0), ("some_odd_things", 4, None)]
    assert tuple(M.geometry(lines).collect()[0])[1:] == ([0.0, -0.001, 0.5], [1.0, 2.0, 3.0], [1, 1, 0], [1, 1, 1])
    old = spark.createDataFrame([("r", 0, "  Mesh (non-empty, non-wedge) directions (1 0 1)"), ("r", 1, " Mesh (non-empty) directions (0 0 1) ")], lines.schema)
    assert tuple(M.geometry(old).collect()[0])[1:] == (None, None, [1, 0, 1], [0, 0, 1])
    exits = spark.createDataFrame([("r", 0)], "report string, exit_code int")
    assert M.verdict(lines, exits).collect()[0].status == "passing"
    assert M.verdict(spark.createDataFrame([("r", 0, "  Floating point exception ")], lines.schema), exits).collect()[0].status == "failing"


def test_layer_coverage_states(spark):
    cases = spark.createDataFrame([(c, None if c == "none" else c != "off") for c in ("met", "part", "miss", "lone", "free", "none", "off", "on")], "path string, add_layers boolean")
    rows = [("met", "a", 2.0), ("met", "b", 3.0), ("part", "a", 1.5), ("part", "b", 9.0), ("miss", "a", 0.0), ("miss", "b", 1.0), ("lone", "a", 2.0), ("free", "a", 2.0), ("free", "b", 3.0), ("free", "x", 1.0)]
    table = spark.createDataFrame(rows, "path string, patch string, average_layers double")
    out = {r.path: (r.status, r.unmatched, r.rows) for r in mesh.layer_coverage(table, [("a", 2), ("[bc]", 3), ("zero", 0)], cases).collect()}
    assert out == {
        "met": ("met", [], 2), "part": ("partial", [], 2), "miss": ("missing", [], 2), "lone": ("unknown", ["[bc]"], 1), "free": ("unknown", [], 3),
        "none": ("unavailable", ["a", "[bc]"], 0), "off": ("not_configured", ["a", "[bc]"], 0), "on": ("unavailable", ["a", "[bc]"], 0),
    }
    without = {r.path: r.status for r in mesh.layer_coverage(table, [], cases).collect()}
    assert without["met"] == "unknown" and without["off"] == "not_configured"


def test_mesh_verdicts(spark):
    texts = {"ok": "Mesh OK.", "failed": "Failed 2 mesh checks.", "fatal": "Mesh OK.\nSegmentation fault", "none": "cells: 3", "exit": "Mesh OK.", "empty": None}
    rows = [(k, i, x) for k, t in texts.items() for i, x in enumerate((t or "").split("\n")) if t]
    exits = spark.createDataFrame([(k, 1 if k == "exit" else 0) for k in texts], "report string, exit_code int")
    out = {r.report: (r.status, r.failed_checks) for r in M.verdict(spark.createDataFrame(rows, "report string, line_no long, line string"), exits).collect()}
    assert out == {"ok": ("passing", None), "failed": ("failing", 2), "fatal": ("failing", None), "none": ("indeterminate", None), "exit": ("failing", None), "empty": ("indeterminate", None)}


def test_mesher_progress(spark):
    text = "Castellated mesh generation\ncells: 10 faces: 30\nMorph iteration 0\nsmoothing displacement iteration 4\nMorph iteration 3\nrefinement phase\nmaxGlobalCells reached"
    r = M.mesher_progress(frame(spark, text, "path"), F.lit(5)).collect()[0]
    assert (r.stage, r.morph, r.smoothing, r.cells, r.faces, r.most_cells, r.completed, r.percent) == ("snapping", 3, 4, 10, 30, True, False, 60.0)
    assert (r.current_work, r.failure, r.warning_count, r.warnings) == ("Morph iteration 3", None, 1, ["maxGlobalCells reached"])
    r = M.mesher_progress(frame(spark, text + "\nEnd", "path"), F.lit(5)).collect()[0]
    assert (r.stage, r.completed, r.current_work, r.percent) == ("completed", True, "snappyHexMesh completed", None)


def test_mesher_failures_warnings_and_segments(spark):
    log = ["add layers", "Warning : a", "Warning : a", "--> FOAM Warning b", "Warning : a", "cells: 1 cells : 2", "ExecutionTime = 1.5 s  ClockTime = 2 s", "mesh refinement", "Solving for pointDisplacementX, No Iterations 7", "[1] Segmentation fault (core dumped)"]
    rows = [("p", 0, 0, "End"), *[("p", 1, i, f" {x} ") for i, x in enumerate(log)], ("q", 0, 0, "nothing")]
    lines = spark.createDataFrame(rows, "path string, segment int, line_no long, line string")
    p, q = M.mesher_progress(lines, F.lit(5), most_warnings=2).orderBy("path").collect()
    assert (p.stage, p.completed, p.cells, p.execution_seconds, p.clock_seconds, p.failure) == ("layers", False, 2, 1.5, 2.0, "segmentation fault")
    assert (p.warning_count, p.warnings, p.smoothing) == (3, ["--> FOAM Warning b", "Warning : a"], 7) and p.current_work.startswith("Solving")
    assert (q.stage, q.warning_count, q.warnings, q.current_work) == ("initialization", 0, [], None)


def test_layer_table(spark):
    head = "patch faces layers overall thickness\n----- ----\n"

    def table(text):
        return [(r.patch, r.faces, r.average_layers) for r in M.layer_table(frame(spark, text, "path")).orderBy("line_no").collect()]

    assert table(head + "wall a 10 2.5 0.1 90\n[0] inlet 4 1 0.2 80\nDone") == [("wall a", 10, 2.5), ("inlet", 4, 1.0)]
    assert table(head + "wall 10 2 0.1 90\nDone\n" + head + "wall 10 3 0.1 90") == [("wall", 10, 2.0)]
    assert table(head + "wall 10 2 0.1 90\n" + head + "wall 10 3 0.1 90\ninlet 4 1") == [("wall", 10, 2.0)]
    assert table("nothing") == []


def test_log_workflows_and_choice(spark):
    logs = [
        ("log.a", "simpleFoam : banner", "Time = 3", None), ("log.snappyHexMesh", "", "", None), ("log.b", "blockMesh utility", "Time = 1", None), ("log.myApp", "", "", "myapp"),
        ("x.log", "run of my.app here", "", "my.app"), ("x.log", "run of myxapp here", "", "my.app"), ("log", "", "", None),
    ]
    out = C.log_workflow(spark.createDataFrame([(i, *x) for i, x in enumerate(logs)], "i int, name string, head string, tail string, application string")).orderBy("i").collect()
    assert [r.workflow for r in out] == ["solver", "snappy_hex_mesh", "utility", "solver", "solver", "unknown", "unknown"]
    kinds = "case string, path string, explicit boolean, saved boolean, workflow string, score int, modified_ns long, act boolean"
    rows = [
        ("a", "s1", False, False, "solver", 100, 5, False), ("a", "s2", False, False, "solver", 90, 9, False), ("a", "m", False, False, "snappy_hex_mesh", 1, 6, False),
        ("b", "s1", False, False, "solver", 100, 7, False), ("b", "m", False, False, "snappy_hex_mesh", 1, 6, False),
        ("c", "s1", False, False, "solver", 100, 7, False), ("c", "u", False, True, "utility", 1, 1, False), ("d", "u", False, False, "unknown", 1, 1, False), ("d", "v", False, False, "unknown", 9, 2, False),
        ("e", "s1", False, False, "solver", 100, 7, False), ("e", "m", False, False, "snappy_hex_mesh", 1, 1, True),
    ]
    got = {r.case: r.path for r in C.chosen_log(C.ranked_logs(spark.createDataFrame(rows, kinds)), F.col("act")).collect()}
    assert got == {"a": "m", "b": "s1", "c": "u", "d": "v", "e": "m"}


def test_process_states(spark):
    kinds = "i int, found boolean, has_log boolean, mesher boolean, age_seconds double, mesher_failed boolean, mesher_completed boolean, failed boolean, completed boolean, current_time double, end_time double, parsed boolean"
    none = dict(found=False, has_log=True, mesher=False, age_seconds=500.0, mesher_failed=False, mesher_completed=False, failed=False, completed=False, current_time=None, end_time=None, parsed=True)
    cases = [
        (dict(found=True), "running"), (dict(mesher=True, mesher_failed=True), "failed"), (dict(mesher=True, mesher_completed=True, failed=True), "completed"), (dict(failed=True), "failed"),
        (dict(completed=True), "completed"), (dict(current_time=2.0, end_time=2.0), "completed"), (dict(age_seconds=80.0), "running"), (dict(age_seconds=200.0, mesher=True), "running"),
        (dict(mesher=True), "stale"), (dict(), "stopped"), (dict(parsed=False), "not_started"), (dict(has_log=False, age_seconds=None, parsed=False), "not_started"),
    ]
    rows = [(i, *(none | c).values()) for i, (c, _) in enumerate(cases)]
    assert [r.state for r in C.process_state(spark.createDataFrame(rows, kinds)).orderBy("i").collect()] == [s for _, s in cases]


def test_log_score(spark):
    kinds = "explicit boolean, saved boolean, application boolean, banner boolean, solver_record boolean, age_seconds double, at_root boolean, workflow string, size long"
    rows = [(False, False, True, True, True, 5.0, True, "solver", 9), (None, None, None, None, None, None, None, None, None), (True, True, False, False, False, 121.0, False, "utility", 0)]
    assert [r.score for r in C.log_score(spark.createDataFrame(rows, kinds)).collect()] == [335, 0, 1575]
