"""Case inspection, and which function wrote a table."""

from runsight.operators import tablenames as T
from runsight.sources import casedict

CONTROL = """// Version: v12.3
application heatFlow; startTime 2; endTime 50.5; deltaT 1e-3; adjustTimeStep yes; maxCo 0.8;
functions { drag { type forces; field U; region air; } probe { type probes; fields (p T 3); operation average; } word on; }
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_inspection(tmp_path):
    put(tmp_path / "system/controlDict", CONTROL)
    put(tmp_path / "system/fvSolution", "SIMPLE { residualControl { p 1e-4; U { tolerance 1e-5; } } }")
    put(tmp_path / "constant/regionProperties", "regions ( fluid (air water) solid (wall) );")
    for name in ("processor0", "processor11", "processors2"):
        (tmp_path / name).mkdir()
    got = casedict.inspect_case(tmp_path)
    assert (got["application"], got["version"], got["mode"]) == ("heatFlow", "12.3", "steady_simple")
    assert (got["start_time"], got["end_time"], got["delta_t"], got["max_co"], got["max_delta_t"]) == (2.0, 50.5, 1e-3, 0.8, None)
    assert got["adjust_time_step"] is True and got["parallel_ranks"] == 2 and got["multi_region"] is True
    assert got["targets"] == [("p", 1e-4), ("U", 1e-5)]
    assert got["functions"] == [("drag", "forces", ["U"], "air", None), ("probe", "probes", ["p", "T"], None, "average")]


def test_inspection_of_an_empty_case(tmp_path):
    got = casedict.inspect_case(tmp_path)
    assert got["mode"] == "unknown" and got["version"] is None and got["functions"] == [] and got["multi_region"] is False and got["notices"] == []


def test_functions_of_paths(spark):
    specs = T.function_specs(spark, [("drag", "forces", ["U"], "air", None), ("probe", "probes", ["p"], None, None), ("probe", "probes", ["p"], None, None)])
    paths = ["drag/0/force.dat", "solid/probe/0.5/p", "probe/drag/1e2/2/x", "solid/other/3/x.y.dat", "alone.dat", "1/alone", "probe", None, "drag/0/force.dat", ".5/a/b", ""]
    rows = T.with_functions(spark.createDataFrame([(p,) for p in paths], "path string"), specs).collect()
    got = {r.path: tuple(r)[1:] for r in rows}
    assert len(rows) == 9 and got == {
        "drag/0/force.dat": ("postProcessing/drag/force.dat", "drag", "forces", "air", 0.0),
        "solid/probe/0.5/p": ("postProcessing/solid/probe/p", "probe", "probes", "solid", 0.5),
        "probe/drag/1e2/2/x": ("postProcessing/probe/drag/1e2/x", "probe", "probes", None, 2.0),
        "solid/other/3/x.y.dat": ("postProcessing/solid/other/x.y.dat", "other", "generic_table", "solid", 3.0),
        "alone.dat": ("postProcessing/alone.dat", "alone", "generic_table", None, 0.0),
        "1/alone": ("postProcessing/alone", "alone", "generic_table", None, 1.0),
        "probe": ("postProcessing/probe", "probe", "generic_table", None, 0.0),
        ".5/a/b": ("postProcessing/a/b", "b", "generic_table", None, 0.5),
        "": ("postProcessing/", "", "generic_table", None, 0.0),
    }


def test_mesher_settings(tmp_path):
    text = 'addLayers off; snapControls { nSolveIter 30; nRelaxIter 2.5; } castellatedMeshControls { maxGlobalCells 1e6; }'
    put(tmp_path / "system/snappyHexMeshDict", text + ' addLayerControls { layers { wall { nSurfaceLayers 3; } "p.*" { nSurfaceLayers -1; } in 2; out { nSurfaceLayers 0; } } }')
    got = casedict.mesher_settings(tmp_path)
    assert got == {"add_layers": False, "n_solve_iter": 30, "n_relax_iter": None, "max_global_cells": 1000000, "stage_count": 2, "layer_requests": [("wall", 3), ("out", 0)], "notices": []}
    assert casedict.mesher_settings(tmp_path / "none") == {"add_layers": None, "n_solve_iter": None, "n_relax_iter": None, "max_global_cells": None, "stage_count": 3, "layer_requests": [], "notices": []}


def test_functions_of_sources(spark):
    specs = T.function_specs(spark, [("1", "late", [], "r", None)])
    paths = spark.createDataFrame([("a/0/x",), ("a/2/x",), ("b/x",), ("1/2/x",), ("2/1/x",)], "path string")
    got = sorted(tuple(r) for r in T.source_functions(paths, specs).collect())
    assert got == [("postProcessing/1/x", "1", "late", "r", 1), ("postProcessing/2/x", "2", "generic_table", None, 1), ("postProcessing/a/x", "a", "generic_table", None, 2), ("postProcessing/b/x", "b", "generic_table", None, 1)]


def test_constant_and_unknown(spark):
    rows = [("a", 1.0)] * 20 + [("b", 1.0)] * 19 + [("c", float(i)) for i in range(30)] + [("d", None)] * 25
    assert {r.series_id: (r.n, r.constant) for r in T.constant_series(spark.createDataFrame(rows, "series_id string, v double")).collect()} == {"a": (20, True), "b": (19, False), "c": (30, False), "d": (0, False)}
    names = spark.createDataFrame([(["b", "x", "a", "x"],), ([],), (None,)], "n array<string>")
    assert [r[0] for r in names.select(T.unknown_names(names["n"], ["a", "c"])).collect()] == [["b", "x"], [], None]
