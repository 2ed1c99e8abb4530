"""Dictionary files of a case: `key value;`, `key { ... }`, `key ( ... );`, comments, includes. Read on the driver: they are
small and configure the jobs."""

from __future__ import annotations

import re
from pathlib import Path

#: A token: a quoted string, a sign of its own, or a bare word.
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}();]|[^\s{}();"]+')
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?")


def without_comments(text: str) -> str:
    """Comments become a space; in quoted strings they are text."""
    return _COMMENT.sub(lambda m: m[1] or " ", text)


def value_of(token: str):
    if _NUMBER.fullmatch(token):
        return float(token)
    return {"yes": True, "no": False}.get(token, token)


class _Reader:
    def __init__(self, root: Path):
        self.root, self.notices, self.open_files = root.resolve(), [], []

    def file(self, path: Path) -> dict:
        path = path.resolve()
        if not path.is_relative_to(self.root):
            self.notices.append(f"{path.name} is outside of the case")
            return {}
        if path in self.open_files:
            self.notices.append(f"{path.name} includes itself")
            return {}
        self.open_files.append(path)
        try:
            text = path.read_text(encoding="utf-8", errors="replace")
        except OSError as e:
            self.notices.append(f"{path.name} can't be read: {e.strerror}")
            return {}
        try:
            tokens = _TOKEN.findall(without_comments(text))
            out, at = self.entries(tokens, 0, path)
            if at < len(tokens):
                self.notices.append(f"{path.name}: a }} too many")
            return out
        finally:
            self.open_files.pop()

    def entries(self, tokens: list[str], at: int, path: Path) -> tuple[dict, int]:
        """Entries up to the closing brace or the end; a later key replaces an earlier one."""
        out: dict = {}
        while at < len(tokens) and tokens[at] != "}":
            key = tokens[at].strip('"')
            at += 1
            if key in ("#include", "#includeIfPresent") and at < len(tokens):
                target = path.parent / tokens[at].strip('"')
                if key == "#include" or target.exists():
                    out |= self.file(target)
                at += 1
            elif key.startswith("#"):
                self.notices.append(f"{path.name}: {key} isn't supported")
                while at < len(tokens) and tokens[at] not in (";", "{", "}"):
                    at += 1
                if at < len(tokens) and tokens[at] == "{":
                    at = self.behind_block(tokens, at + 1, path)
                else:
                    at += at < len(tokens) and tokens[at] == ";"
            elif key in (";", "(", ")", "{"):
                continue
            elif at < len(tokens) and tokens[at] == "{":
                out[key], at = self.entries(tokens, at + 1, path)
                if at >= len(tokens):
                    self.notices.append(f"{path.name}: {key} isn't closed")
                at += 1
            else:
                out[key], at = self.plain(tokens, at, path)
        return out, at

    def behind_block(self, tokens: list[str], at: int, path: Path) -> int:
        """The place behind the brace that closes an open one, whatever blocks are inside."""
        depth = 1
        while at < len(tokens) and depth:
            depth += (tokens[at] == "{") - (tokens[at] == "}")
            at += 1
        if depth:
            self.notices.append(f"{path.name}: a directive's block isn't closed")
        return at

    def plain(self, tokens: list[str], at: int, path: Path):
        """A value up to the semicolon: one token, a list, or several words joined."""
        values: list = []
        while at < len(tokens) and tokens[at] not in (";", "}"):
            if tokens[at] == "(":
                items, at = self.items(tokens, at + 1, path)
                values.append(items)
            else:
                values.append(tokens[at].strip('"') if tokens[at].startswith('"') else value_of(tokens[at]))
                at += 1
        at += at < len(tokens) and tokens[at] == ";"
        if len(values) == 1:
            return values[0], at
        return " ".join(f"{v:g}" if isinstance(v, float) else str(v) for v in values), at

    def items(self, tokens: list[str], at: int, path: Path) -> tuple[tuple, int]:
        """A list's items: values, lists in it, and dictionaries in it."""
        out: list = []
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == "(":
                inner, at = self.items(tokens, at + 1, path)
                out.append(inner)
                continue
            if tokens[at] == "{":
                inner, at = self.entries(tokens, at + 1, path)
                out.append(inner)
            elif tokens[at] not in (";", "}"):
                out.append(value_of(tokens[at].strip('"')))
            at += 1
        return tuple(out), at + 1


def read_dictionary(path: str | Path, root: str | Path) -> tuple[dict, list[str]]:
    """(entries, notices) of a file; included files must lie below root."""
    reader = _Reader(Path(root))
    return reader.file(Path(path)), reader.notices


def residual_targets(solution: dict) -> list[tuple[str, float]]:
    """(pattern, threshold) of the residual controls, in the order in which the algorithms are named below; each is a
    number or a dictionary with a tolerance."""
    out = []
    for algorithm in ("PIMPLE", "PISO", "SIMPLE"):
        control = solution.get(algorithm)
        for pattern, value in (control.get("residualControl") or {}).items() if isinstance(control, dict) and isinstance(control.get("residualControl"), dict) else ():
            value = value.get("tolerance") if isinstance(value, dict) else value
            if isinstance(value, float):
                out.append((pattern, value))
    return out


# The algorithms with the kind of run each makes, and what marks a scheme or setting that advances in time.
MODES = {"PIMPLE": "transient_pimple", "PISO": "transient_piso", "SIMPLE": "steady_simple"}
TIME_MARKERS = ("Euler", "backward", "CrankNicolson", "localEuler", "rDeltaT")


def words_in(value) -> str:
    """All keys and words of nested entries, for a search."""
    if isinstance(value, dict):
        return " ".join(f"{k} {words_in(v)}" for k, v in value.items())
    return " ".join(map(words_in, value)) if isinstance(value, tuple) else value if isinstance(value, str) else ""


def mode_of(solution: dict, schemes: dict | str) -> str:
    """The kind of run by the first algorithm that has a dictionary; a steady one with a time marker in the schemes or the
    solution is pseudo-transient."""
    kind = next((kind for name, kind in MODES.items() if isinstance(solution.get(name), dict)), "unknown")
    text = f"{words_in(schemes)} {words_in(solution)}"
    return "pseudo_transient" if kind == "steady_simple" and any(m in text for m in TIME_MARKERS) else kind


#: The version in the head of a dictionary file.
VERSION = re.compile(r"(?:Version|OpenFOAM)[^0-9]*([0-9]+(?:\.[0-9]+)*)", re.I)


def _of(kind: type, value):
    return value if isinstance(value, kind) else None


def declared_functions(control: dict) -> list[tuple]:
    """(name, type, fields, region, operation) of the functions that a control dictionary declares; entries that are no
    dictionaries declare none."""
    out = []
    for name, given in (_of(dict, control.get("functions")) or {}).items():
        if isinstance(given, dict):
            fields = given.get("fields", given.get("field"))
            fields = [fields] if isinstance(fields, str) else [x for x in _of(tuple, fields) or () if isinstance(x, str)]
            out.append((name, _of(str, given.get("type")) or "", fields, _of(str, given.get("region")), _of(str, given.get("operation"))))
    return out


def inspect_case(case: str | Path) -> dict:
    """What a case's dictionaries say of a run, by name: application, version, mode, times and limits (None where not
    given as a number or a switch), parallel_ranks (folders named processor and a number), multi_region, targets
    (residual_targets), functions (declared_functions) and notices. Files that are missing say nothing."""
    case = Path(case)
    control_file = case / "system" / "controlDict"
    files = (control_file, case / "system" / "fvSolution", case / "system" / "fvSchemes", case / "constant" / "regionProperties")
    (control, a), (solution, b), (schemes, c), (regions, d) = (read_dictionary(f, case) if f.is_file() else ({}, []) for f in files)
    head = VERSION.search(control_file.read_text(encoding="utf-8", errors="replace")) if control_file.is_file() else None
    # a name in the list of regions stands for one; lists behind it are its parts
    named = [x for x in _of(tuple, regions.get("regions")) or () if isinstance(x, str)]
    out = {"application": _of(str, control.get("application")), "version": head and head[1], "mode": mode_of(solution, schemes)}
    # The names of the entries.
    for key, entry in (("start_time", "startTime"), ("end_time", "endTime"), ("delta_t", "deltaT"), ("max_co", "maxCo"), ("max_delta_t", "maxDeltaT")):
        out[key] = _of(float, control.get(entry))
    return out | {
        "adjust_time_step": _of(bool, control.get("adjustTimeStep")),
        "parallel_ranks": sum(f.is_dir() and bool(re.fullmatch(r"processor[0-9]+", f.name)) for f in case.iterdir()),
        "multi_region": len(named) > 1,
        "targets": residual_targets(solution),
        "functions": declared_functions(control),
        "notices": [*a, *b, *c, *d],
    }


# Words that stand for a switch.
SWITCHES = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}


def switch(value) -> bool | None:
    return value if isinstance(value, bool) else SWITCHES.get(value.lower()) if isinstance(value, str) else None


def whole(value) -> int | None:
    """A whole number from 0 on."""
    return int(value) if isinstance(value, float) and value >= 0 and value.is_integer() else None


def mesher_settings(case: str | Path) -> dict:
    """What the mesher's dictionary says of its progress: add_layers, n_solve_iter, n_relax_iter, max_global_cells,
    stage_count (without layers one less), layer_requests (patch selector, layers) in the file's order, and notices."""
    case = Path(case)
    file = case / "system" / "snappyHexMeshDict"
    given, notices = read_dictionary(file, case) if file.is_file() else ({}, [])
    snap, refine = (_of(dict, given.get(k)) or {} for k in ("snapControls", "castellatedMeshControls"))
    # the older spelling stands in for the newer one
    layers = next((v for k in ("addLayersControls", "addLayerControls") if isinstance(v := given.get(k), dict)), {})
    requests = [(patch, whole(own.get("nSurfaceLayers"))) for patch, own in (_of(dict, layers.get("layers")) or {}).items() if isinstance(own, dict)]
    add = switch(given.get("addLayers"))
    return {
        "add_layers": add,
        "n_solve_iter": whole(snap.get("nSolveIter")),
        "n_relax_iter": whole(snap.get("nRelaxIter")),
        "max_global_cells": whole(refine.get("maxGlobalCells")),
        "stage_count": 2 if add is False else 3,
        "layer_requests": [(patch, n) for patch, n in requests if n is not None],
        "notices": notices,
    }
