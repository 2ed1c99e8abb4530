"""Tables to series: shapes, headers, descriptors, restarts; the catalogue, details and documents made of them."""

import datetime
import hashlib
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runsight.operators import documents as D
from runsight.operators import tablenames
from runsight.operators.configuration import read_configurations
from runsight.sources import tables

DECLARED = [("flow", "volFieldValue", ["Q"], "air", "sum"), ("drag", "forces", [], None, None)]
FILES = {
    "flow/0/out.dat": "# Time value\n0 1\n1 2\n2 3\nbad\n3 nan\n3 (1\n",
    "flow/2/out.dat": "# TIME value\n2 5\n4 6",
    "fluid/U/0/data.dat": "# Time U\n0 (1 2 2)\n1 (2 3 6)\n2 5\n",
    "fluid/U/1/data.dat": "# Time U\n1 5\n",
    "drag/0/force.dat": "# Time force\n0 ((1 2 3) (4 5 6) (7 8 9))\n",
    "drag/0/moment.dat": "# Time moment\n0 ((1 2 3) (4 5 6) (7 8 9))\n",
    "grad/0/t.dat": "# Time gradT\n0 (1 2 3 4 5 6 7 8 9)\n1 (inf 2 3 4 5 6 7 8 9)\n",
    "probes/0/p": "# Probe 0 (0 0 0)\n# probe 1 (1 0 0)\n# Time p\n0 10 20\n1 11\n2 12 22\n",
    "mix/0/m.dat": '# Time "areaAverage(p)" "volIntegrate(a b)"\n0 1 2\n1 (1 2 3)\n2 3 4\n',
    "plain.dat": "0 7 8\n",
    "late.dat": "1 2\n# Time x\n2 3\n",
    "empty/0/e.dat": "# Time e\n",
}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("case")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def found(spark, rows):
    files = spark.createDataFrame([(name, i * 10**9) for i, name in enumerate(FILES)], "path string, modified_ns long")
    points, series = tables.discovered(rows, files, tablenames.function_specs(spark, DECLARED))
    got = {}
    names = {r.series_id: (r.function_name, r.field, r.operation, r.component) for r in series.collect()}
    for r in points.collect():
        got.setdefault(names[r.series_id], {})[r.t] = r.v
    return got, series


def relative(rows, root):
    return rows.withColumn("path", F.substring_index("path", f"{root}/", -1))


def test_series_of_a_case(spark, case):
    got, series = found(spark, relative(tables.table_rows(spark, *[f"{case}/{n}" for n in FILES]), case))
    assert got["flow", "Q", "sum", None] == {0: 1, 1: 2, 2: 5, 4: 6}
    assert got["U", "U", None, "magnitude"] == {0: 3, 1: 7} and got["U", "U", None, "z"] == {0: 2, 1: 6}
    assert got["drag", "force pressure", None, "x"] == {0: 1} and got["drag", "moment porous", None, "z"] == {0: 9}
    assert got["grad", "gradT", None, "zz"] == {0: 9} and ("grad", "gradT", None, "magnitude") not in got
    assert got["probes", "p", None, "probe 1"] == {0: 20, 2: 22}
    assert got["mix", "p", "areaAverage", None] == {0: 1, 2: 3} and got["mix", "a b", "volIntegrate", None] == {0: 2, 2: 4}
    assert got["plain", "value[1]", None, None] == {0: 8} and got["late", "x", None, None] == {1: 2, 2: 3}
    assert len(got) == 1 + 4 + 18 + 9 + 2 + 2 + 2 + 1
    (flow,) = series.where("function_name = 'flow'").collect()
    text = "flow|volFieldValue|air|Q|sum||postProcessing/flow/out.dat"
    assert flow.series_id == hashlib.sha256(text.encode()).hexdigest()[:20] and flow.label == "flow sum Q" and flow.modified_ns == 10**9


@pytest.mark.parametrize("split", [7, 40, 1 << 20])
def test_ranges_give_the_same_rows(spark, case, split):
    whole = tables.table_rows(spark, *[f"{case}/{n}" for n in FILES])
    ranges = None
    for name in FILES:
        one = tables.split_table_rows(spark, f"{case}/{name}", split)
        ranges = one if ranges is None else ranges.unionByName(one)

    def rows(df):
        return sorted((r.path.removeprefix("file://"), r.t, r.v, r.widths, r.headers, r.probes) for r in df.collect())

    assert rows(ranges) == rows(whole) and len(rows(whole)) > 20


def test_catalogue_and_details(spark):
    n = 5000
    points = spark.createDataFrame([("a", float(i), math.sin(i / 50) + (9 if i == 777 else 0)) for i in range(n)] + [("b", 1.0, 3.0)], "series_id string, t double, v double")
    meta = [("a", "flow p", "flow", "x", "s/a", None, "p", None, None, 10**9), ("b", "probe T", "probe", "x", "s/b", "air", "T", "avg", "x", 190 * 10**9), ("c", "none", "f", "x", "s/c", None, "q", None, None, 0)]
    series = spark.createDataFrame(meta, tables.SERIES + ", modified_ns long")
    overrides = spark.createDataFrame([("a", "own", "Pa", None), ("b", None, None, 5.0)], "series_id string, label string, units string, stale_after_seconds double")
    selected = spark.createDataFrame([("b",), ("x",), ("b",)], "series_id string")
    a, b, c = D.series_catalog(points, series, F.lit(200.0), overrides=overrides, selected=selected).collect()
    assert (a.id, a.label, a.units, a.stale, a.selected, a.sample_count, a.current_value) == ("a", "own", "Pa", True, False, n, math.sin((n - 1) / 50))
    assert (b.label, b.units, b.stale, b.selected, b.sample_count, b.current_value, b.preview.values) == ("probe T", None, True, True, 1, 3.0, [3.0])
    assert len(a.preview.times) == 300 and a.preview.times[0] == 0 and a.preview.times[-1] == n - 1 and 777 in a.preview.times
    assert a.candidate.asDict() == {"score": 100, "confidence": "high", "recommended": True, "explanation": "Force, flow, flux, pressure-difference, or power output (+80). At least 50 finite samples (+20)."}
    assert (c.sample_count, c.current_value, c.preview.times, c.candidate.explanation) == (0, None, [], "No candidate-ranking factor applied.")
    details = {r.id: r for r in D.series_details(points, series, limit=50, overrides=overrides, selected=selected).collect()}
    assert (details["a"].total_samples, details["a"].returned_samples, details["a"].downsampled) == (n, 50, True) and 777 in details["a"].times
    assert (details["b"].returned_samples, details["b"].downsampled, details["b"].selected) == (1, False, True) and "c" not in details
    with pytest.raises(ValueError):
        D.series_details(points, series, limit=0)


def test_documents_of_any_schema(spark):
    schema = "run_id int, mean_value double, deep struct<end_time:float,tags_set:array<string>,x_list:array<struct<y_z:double>>>, m map<int,double>, raw binary, day date, none_here string"
    nan = float("nan")
    rows = [(1, nan, (float("inf"), ["b", "a", "b"], [(1.5,), (float("-inf"),), None]), {1: nan, 2: 2.0}, b"ab", datetime.date(2020, 1, 2), None), (None, 1.0, None, None, None, None, "x")]
    got = [json.loads(r.document) for r in D.json_documents(spark.createDataFrame(rows, schema), sets=("deep.tags_set",)).collect()]
    assert got == [
        {"runId": 1, "meanValue": None, "deep": {"endTime": None, "tagsSet": ["a", "b"], "xList": [{"yZ": 1.5}, {"yZ": None}, None]}, "m": {"1": None, "2": 2.0}, "raw": "ab", "day": "2020-01-02", "noneHere": None},
        {"runId": None, "meanValue": 1.0, "deep": None, "m": None, "raw": None, "day": None, "noneHere": "x"},
    ]


def test_notices_of_all_sources(spark):
    schema = "case string, seq int, severity string, message string"
    case = spark.createDataFrame([("c", 1, "info", "one"), ("c", 2, "error", "two"), ("c", 3, "info", "one")], schema)
    log = spark.createDataFrame([("c", i, "error" if i == 4 else "info", f"log {i}") for i in range(1, 6)] + [("d", 1, "info", "only")], schema)
    mesh = spark.createDataFrame([("c", 1, "info", "mesh")], schema)
    out = D.gathered_notices({"mesh_quality": mesh, "solver_log": log, "case": case}, most=5).orderBy("case", "position").collect()
    assert [(r.case, r.source, r.message, r.total, r.omitted) for r in out] == [
        ("c", "case", "one", 8, 3), ("c", "case", "two", 8, 3), ("c", "solver_log", "log 4", 8, 3), ("c", "solver_log", "log 5", 8, 3), ("c", "mesh_quality", "mesh", 8, 3), ("d", "solver_log", "only", 1, 0)]
    with pytest.raises(ValueError):
        D.gathered_notices({"other": case})


def test_snapshot_of_cases(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("a",)], "case string")
    state = spark.createDataFrame([("a", "running", math.inf, "x")], "case string, run_state string, end_time double, case_name string")
    steps = spark.createDataFrame([("a", i, float(i)) for i in (3, 1, 2)] + [("z", 1, 1.0)], "case string, position int, time_value double")
    text = json.dumps({"version": 1, "selectedLog": "l", "overrides": {"s": {"label": "x", "units": None, "minimumCycles": 2}}, "acceptedStates": ["plateau", "evolving"]})
    read = read_configurations(spark.createDataFrame([("a", text), ("b", "{")], "path string, text string"))
    out = D.snapshot_documents(cases, {"process": state, "configuration": D.configuration_section(read)}, {"last_steps": (steps, 2)}, {"refresh_seconds": F.lit(2)})
    got = {r.case: json.loads(r.document) for r in out.collect()}
    assert got["a"] == {
        "refreshSeconds": 2, "process": {"runState": "running", "endTime": None, "caseName": "x"}, "lastSteps": [{"timeValue": 1.0}, {"timeValue": 2.0}],
        "configuration": {"version": 1, "selectedLog": "l", "selectedSeries": [], "overrides": {"s": {"label": "x", "minimumCycles": 2}}, "acceptedStates": ["evolving", "plateau"], "error": None},
    }
    assert got["b"]["process"] is None and got["b"]["lastSteps"] == [] and got["b"]["configuration"]["error"] == "not_json" and got.keys() == {"a", "b"}


def test_plain_lines_are_read_as_columns():
    lines = ["1 2", "0 (2 3 4)", "5\t((1 2 3) (4 5 6)  (7 8 9))", "+1 2", "1 1e999", "1 2.", "1 .5e+3", "e 1", "1 -2.5E-3", "77 (1 2", "1", "nan 2", "1_0 2", "1 ()", "1(2 3)", "1 (2)(3)", "(1) 2", "(1 2) 3", "1 1-2", ")1 2(", "(((1))) 2", "0x1 2", ""]
    batch = pa.RecordBatch.from_pydict({"path": ["a"] * len(lines), "line_no": list(range(len(lines))), "line": lines})
    rows, others = tables.plain_rows(batch)
    got = {r["row_no"]: (r["t"], r["v"], r["widths"]) for r in rows.to_pylist()}
    judged = {r["line_no"]: row for r in others.to_pylist() if (row := tables.row_of(r["line"]))}
    assert got | judged == {i: row for i, x in enumerate(lines) if (row := tables.row_of(x))}
    assert {0, 1, 2, 5, 6, 8} <= set(got) and set(judged) == {3, 12}


def test_points_come_numbered_and_rows_are_met_once(spark):
    """A source's times are put in order once for all of its series, in the tasks that merge them."""
    lines = spark.createDataFrame([("a/0/x", i, f"{i % 90} ({i} 2 3)") for i in range(200)] + [("a/0/x", 500, "# Time U")], "path string, line_no long, line string")
    files = spark.createDataFrame([("a/0/x", 5)], "path string, modified_ns long")
    points, series = tables.discovered(tables.parsed_rows(lines), files, tablenames.function_specs(spark, DECLARED), tables.table_heads(lines))
    assert points.columns == ["series_id", "t", "v", "i", "n"] and series.count() == 4
    rows = points.join(series.where("component = 'x'"), "series_id").collect()
    assert sorted((r.t, r.v, r.i, r.n) for r in rows) == [(float(k), float(k + 180 if k < 20 else k + 90), k, 90) for k in range(90)]
