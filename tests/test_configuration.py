"""Strict reading of configurations, the newest complete mesh, files of a case."""

import json
import os

import pytest

from runsight.operators import configuration as C
from runsight.operators import meshfiles as M


def codes(text):
    return [p["code"] for p in C.read_one(text)["problems"]]


def test_a_configuration_and_the_defaults(spark):
    text = json.dumps({"version": 1, "selectedLog": "log.x", "selectedSeries": ["b", "a"], "overrides": {"a": {"label": None, "maxNormalizedSlope": 1, "minimumCycles": 3}}, "acceptedStates": ["plateau", "evolving"]})
    rows = spark.createDataFrame([("ok", text), ("none", None), ("bad", text[:-1]), ("empty", "")], "path string, text string")
    read = {r.path: r for r in C.read_configurations(rows).collect()}
    ok = read["ok"]
    assert (ok.selected_log, ok.selected_series, ok.accepted_states, ok.problems) == ("log.x", ["b", "a"], ["evolving", "plateau"], [])
    assert ok.overrides[0].asDict() == {"series_id": "a"} | {C.snake(k): None for k in C.FIELDS} | {"max_normalized_slope": 1.0, "minimum_cycles": 3}
    for name in ("none", "bad", "empty"):
        assert (read[name].selected_log, read[name].selected_series, read[name].overrides, read[name].accepted_states) == (None, [], [], list(C.DEFAULT_STATES))
    assert read["none"].problems == [] and [p.code for p in read["empty"].problems] == ["not_json"]


@pytest.mark.parametrize(
    "payload,want",
    [
        ({}, ["version"]), ({"version": "1"}, ["version"]), (None, ["not_an_object"]),
        ({"version": 1, "selectedLog": "/abs"}, ["selected_log_path"]), ({"version": 1, "selectedLog": "\\root"}, ["selected_log_path"]), ({"version": 1, "selectedLog": "x" * 4097}, ["selected_log_length"]), ({"version": 1, "selectedLog": "a\0"}, ["selected_log_length"]),
        ({"version": 1, "selectedSeries": [str(i) for i in range(1001)]}, ["selected_series_many"]), ({"version": 1, "selectedSeries": ["x" * 257]}, ["series_id"]), ({"version": 1, "selectedSeries": ["x" * 256]}, []),
        ({"version": 1, "overrides": {str(i): {} for i in range(1001)}}, ["overrides_many"]), ({"version": 1, "overrides": {"a": {"units": "x" * 101}}}, ["display_text"]), ({"version": 1, "overrides": {"a": {"units": "x" * 100}}}, []),
        ({"version": 1, "overrides": {"a": {"minimumCycles": True}}}, ["minimum_cycles"]), ({"version": 1, "overrides": {"a": {"minimumCycles": 1_000_001}}}, ["minimum_cycles"]), ({"version": 1, "overrides": {"a": {"absoluteFloor": True}}}, ["finite_number"]),
        ({"version": 1, "overrides": {"a": {"absoluteFloor": 10**400}}}, ["finite_number"]), ({"version": 1, "overrides": {"a": {"staleAfterSeconds": 0}}}, []), ({"version": 1, "overrides": {"a": {"minimumEffectiveSamples": 0}}}, ["positive_number"]),
        ({"version": 1, "acceptedStates": []}, []), ({"version": 1, "acceptedStates": [None, "plateau", "plateau"]}, ["accepted_state", "duplicate_state"]),
    ],
)
def test_rules(payload, want):
    assert codes(json.dumps(payload)) == want


def test_strict_json():
    assert codes('{"version": 1, "overrides": {"a": {"label": "x", "label": "y"}}}') == ["duplicate_key"] and codes('{"version": -Infinity}') == ["non_finite_literal"]
    assert codes('{"version": 1}' + " " * (4 << 20)) == ["too_large"] and codes("[" * 100_000) == ["not_json"] and codes("1 2") == ["not_json"]


def test_unknown_series_come_last(spark):
    files = spark.createDataFrame([("p", '{"version": 2, "selectedSeries": ["b", "a", "k"]}'), ("q", '{"version": 1, "overrides": {"k": {}}}')], "path string, text string")
    known = spark.createDataFrame([("p", "k"), ("p", "k"), ("q", "x")], "path string, series_id string")
    out = [tuple(r) for r in C.problems(C.read_configurations(files), known).orderBy("path", "position").collect()]
    assert out == [("p", 1, "version", "version"), ("p", 2, "unknown_series", "a"), ("p", 3, "unknown_series", "b"), ("q", 1, "unknown_series", "k")]


def test_newest_complete_mesh(spark, tmp_path):
    def mesh(case, folder, names, gz=()):
        at = tmp_path / case / folder / "polyMesh"
        at.mkdir(parents=True)
        for n in names:
            (at / (n + (".gz" if n in gz else ""))).write_text(n)

    mesh("a", "constant", M.CORE)
    mesh("a", "2", M.CORE, gz=("owner",))
    mesh("a", "10", M.CORE[:4])
    mesh("a", "-inf", M.CORE)
    mesh("b", "processor0", M.CORE)
    mesh("c", "system", M.CORE)
    (tmp_path / "d").mkdir()
    (tmp_path / "outside.txt").write_text("x")
    os.symlink(tmp_path / "outside.txt", tmp_path / "a" / "link")
    files = None
    for case in "abc":
        one = M.case_files(spark, str(tmp_path / case)).selectExpr(f"'{case}' AS case", "*")
        files = one if files is None else files.unionByName(one)
    assert files.where("path LIKE '%link%' OR path LIKE '%outside%'").count() == 0 and files.where("case = 'a'").count() == 19
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case string")
    more = files.unionByName(spark.createDataFrame([("a", "system/controlDict", 1, 1), ("b", "system/controlDict", 1, 1), ("e", "system/controlDict", 1, 1), ("e", "0.5/U", 1, 1), ("f", "constant/x", 1, 1)], files.schema))
    assert {r.case: r.is_case for r in M.is_case(more).collect()} == {"a": True, "b": False, "c": False, "e": True, "f": False}
    got = {r.case: r for r in M.mesh_probe(files, cases).collect()}
    assert got["a"].source == "2/polyMesh" and got["a"].reason is None and "owner.gz:5:" in got["a"].signature and got["a"].newest_ns > 10**18
    assert [got[c].reason for c in "bcd"] == [M.DECOMPOSED, M.NONE_YET, M.NONE_YET] and got["b"].signature is None
