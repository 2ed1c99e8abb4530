"""Dictionaries and log lines."""

from runsight.sources import casedict, logs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return path


def test_dictionary(tmp_path):
    write(tmp_path / "more", "b 2;\nc yes; // a comment\n")
    f = write(tmp_path / "dict", '/* x { */ a 1; name "quoted // text"; b 1;\n#include "more"\nsub { list (1 2 (3 x)); "p|U.*" { tolerance 1e-4; } words one two; flag no; }\n#calc "nothing";\nlast on;')
    got, notices = casedict.read_dictionary(f, tmp_path)
    assert got == {"a": 1.0, "name": "quoted // text", "b": 2.0, "c": True, "sub": {"list": (1.0, 2.0, (3.0, "x")), "p|U.*": {"tolerance": 1e-4}, "words": "one two", "flag": False}, "last": "on"}
    assert len(notices) == 1 and "#calc" in notices[0]


def test_directive_blocks_are_skipped_whole(tmp_path):
    f = write(tmp_path / "dict", "SIMPLE { #calc { x 1; deep { y 2; } } residualControl { U 1e-3; } }\nlist (a { k 1; in { z 2; } } (b { m no; }));\n#ifeq a b { q 1; }\nend 5;")
    got, notices = casedict.read_dictionary(f, tmp_path)
    assert got == {"SIMPLE": {"residualControl": {"U": 1e-3}}, "list": ("a", {"k": 1.0, "in": {"z": 2.0}}, ("b", {"m": False})), "end": 5.0} and len(notices) == 2
    assert casedict.residual_targets(got) == [("U", 1e-3)]
    got, notices = casedict.read_dictionary(write(tmp_path / "open", "a 1; #calc { b { c 2; }"), tmp_path)
    assert got == {"a": 1.0} and len(notices) == 2


def test_dictionary_faults(tmp_path):
    inner = tmp_path / "case"
    write(tmp_path / "outside", "x 1;")
    f = write(inner / "loop", '#include "loop"\n#include "../outside"\n#includeIfPresent "none"\ny 1;\nopen { z 2;')
    got, notices = casedict.read_dictionary(f, inner)
    assert got == {"y": 1.0, "open": {"z": 2.0}} and len(notices) == 3


def test_targets_and_modes():
    solution = {"SIMPLE": {"residualControl": {"p": 1e-3, "U": {"tolerance": 1e-4}, "bad": "x"}}, "PIMPLE": {"residualControl": {"T": 0.5}}}
    assert casedict.residual_targets(solution) == [("T", 0.5), ("p", 1e-3), ("U", 1e-4)]
    assert casedict.mode_of(solution, "") == "transient_pimple" and casedict.mode_of({}, "") == "unknown"
    assert casedict.mode_of({"SIMPLE": {}}, "default Euler;") == "pseudo_transient" and casedict.mode_of({"SIMPLE": {}}, "steadyState") == "steady_simple"
    assert casedict.mode_of({"SIMPLE": {"momentumPredictor": "rDeltaT"}}, {"ddtSchemes": {"default": "steadyState"}}) == "pseudo_transient"
    assert casedict.mode_of({"PIMPLE": "yes", "SIMPLE": {}}, {"default": ("none", "Euler")}) == "pseudo_transient"


def test_whole_lines_of_logs(spark, tmp_path):
    f = write(tmp_path / "case/log.run", "one\r\ntwo\n\nthr")
    write(tmp_path / "case/other.txt", "x\n")
    assert [(r.line_no, r.line) for r in logs.log_lines(spark, str(f)).orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "")]
    (row,) = logs.log_files(spark, str(tmp_path)).collect()
    assert row.size == 13 and row.path.endswith("log.run")
