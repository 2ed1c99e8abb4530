"""The log job as a stream: what is known of each log's run, kept in state, the same for any chunks of the log.

`stream_telemetry` folds the lines of a stream, `telemetry` computes the same rows from a table of lines.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runsight.functions.staging import staged
from runsight.operators import events as E

#: Residuals, warnings and notices that are kept of a log; residuals and time steps that a row shows.
MOST_RESIDUALS, MOST_MESSAGES, SHOWN = 100_000, 200, 1000

STEP = (
    "segment int, simulation_time double, delta_t double, courant_mean double, courant_max double, mesh_courant_mean double, mesh_courant_max double, "
    "continuity_local double, continuity_global double, continuity_cumulative double, outer_correctors int"
)
RESIDUAL = "segment int, simulation_time double, field string, initial double, final double, iterations int, converged boolean, region string, outer_corrector int"
RUN = (
    "selection long, segment int, last_line long, current_time double, current_delta_t double, execution_seconds double, clock_seconds double, completed boolean, "
    "declared_converged boolean, failure_label string, failure_line string, failure_segment int, failure_time double, region string, n_residuals long, n_steps long"
)
FAILURE = "label:string,line:string,segment:int,simulation_time:double"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _struct(schema: str) -> str:
    return ",".join(c.replace(" ", ":") for c in schema.split(", "))


OUT = (
    "path string, selection long, segment int, current_time double, current_delta_t double, execution_seconds double, clock_seconds double, completed boolean, declared_converged boolean, "
    f"failure struct<{FAILURE}>, region string, n_residuals long, n_steps long, residuals array<struct<{_struct(RESIDUAL)}>>, time_steps array<struct<{_struct(STEP)}>>, warnings array<string>, notices array<string>"
)
STEP_NAMES, RUN_NAMES, OUT_NAMES = names(STEP), names(RUN), [c.split()[0] for c in OUT.split(", ")]
Event = namedtuple("Event", "selection segment line_no line kind label region field x y z converged warning")
#: A run before its first line, and the fields that a new segment starts anew.
EMPTY = dict.fromkeys(RUN_NAMES) | {"selection": 0, "segment": 0, "last_line": -1, "completed": False, "declared_converged": False, "n_residuals": 0, "n_steps": 0}
PER_SEGMENT = ("current_time", "current_delta_t", "execution_seconds", "clock_seconds", "completed", "declared_converged", "failure_label", "failure_line", "failure_segment", "failure_time", "region")
#: Events and the fields of the open step that their numbers set.
STEP_FIELDS = {"courant": ("courant_mean", "courant_max"), "mesh_courant": ("mesh_courant_mean", "mesh_courant_max"), "continuity": ("continuity_local", "continuity_global", "continuity_cumulative")}


class Fold:
    """What events do to a run: its fields, its open step, and what they add to the histories."""

    def __init__(self, run: dict, step: dict | None):
        self.run, self.step = run, step
        self.steps: list[tuple] = []
        self.residuals: list[tuple] = []
        self.warnings: list[str] = []
        self.notices: list[str] = []

    def close_step(self) -> None:
        if self.step is not None:
            self.steps.append(tuple(self.step.values()))
            self.run["n_steps"] += 1
            self.step = None

    def take(self, e) -> None:
        """One event. Those at or before the last line seen change nothing, so a chunk that comes again is harmless."""
        run = self.run
        if (e.segment, e.line_no) <= (run["segment"], run["last_line"]):
            return
        if e.segment != run["segment"]:
            self.close_step()
            run |= {c: EMPTY[c] for c in PER_SEGMENT} | {"segment": int(e.segment)}
        run["last_line"] = int(e.line_no)
        numbers = [None if x is None or x != x else float(x) for x in (e.x, e.y, e.z)]
        if e.warning:
            self.warnings.append(e.line)
        if e.kind in STEP_FIELDS and self.step is not None:
            self.step |= dict(zip(STEP_FIELDS[e.kind], numbers, strict=False))
        elif e.kind == "fatal":
            run |= {"failure_label": e.label, "failure_line": e.line, "failure_segment": int(e.segment), "failure_time": run["current_time"]}
        elif e.kind == "region":
            run["region"] = e.region
        elif e.kind == "time":
            self.close_step()
            run |= {"current_time": numbers[0], "current_delta_t": None, "region": e.region or run["region"]}
            self.step = dict.fromkeys(STEP_NAMES) | {"segment": int(e.segment), "simulation_time": numbers[0], "outer_correctors": 0}
        elif e.kind == "delta_t":
            run["current_delta_t"] = numbers[0]
            if self.step is not None:
                self.step["delta_t"] = numbers[0]
        elif e.kind == "corrector" and self.step is not None:
            self.step["outer_correctors"] = max(self.step["outer_correctors"], int(numbers[0]))
        elif e.kind == "solve" and self.step is not None:
            converged = None if e.converged is None or e.converged != e.converged else bool(e.converged)
            self.residuals.append((int(e.segment), run["current_time"], e.field, numbers[0], numbers[1], int(numbers[2]), converged, e.region or run["region"], self.step["outer_correctors"]))
            run["n_residuals"] += 1
        elif e.kind == "timing":
            run |= {"execution_seconds": numbers[0], "clock_seconds": numbers[1]}
        elif e.kind == "converged":
            run["declared_converged"] = True
            self.notices.append(e.line)
        elif e.kind == "end":
            run["completed"] = True


class LogProcessor(StatefulProcessor):
    """A log's state: the run and its open step as values; residuals, closed steps, warnings and notices as lists.

    Histories go on over segments. Lists are cut when they have twice what is kept. A greater selection than the state's
    (another log or workflow was chosen) discards the state, lines of a smaller one come too late and go. With keep_ms a
    log without lines for that long is forgotten.
    """

    def __init__(self, shown: int, most_residuals: int, most_messages: int, keep_ms: int | None):
        self.shown, self.most_residuals, self.most_messages, self.keep_ms = shown, most_residuals, most_messages, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run, self.step = handle.getValueState("run", RUN), handle.getValueState("step", STEP)
        self.held = handle.getValueState("held", "residuals int, steps int")
        self.residuals, self.steps = handle.getListState("residuals", RESIDUAL), handle.getListState("steps", STEP)
        self.warnings, self.notices = handle.getListState("warnings", "line string"), handle.getListState("notices", "line string")

    def _forget(self) -> None:
        for state in (self.run, self.step, self.held, self.residuals, self.steps, self.warnings, self.notices):
            state.clear()

    def _append(self, state, new: list[tuple], held: int, most: int) -> tuple[list[tuple], int]:
        """The list's last shown rows and how many the state holds, after new ones."""
        if held + len(new) > 2 * most:
            new = [*state.get(), *new][-most:]
            held = 0
            state.put(new)
        elif new:
            state.appendList(new)
        held += len(new)
        last = new if len(new) >= min(self.shown, held) else list(state.get())
        return last[max(0, len(last) - min(self.shown, most)) :], held

    def _messages(self, fold: Fold, known: bool) -> tuple[list[str], list[str]]:
        """The last warnings, and the first different notices."""
        before = [[line for (line,) in state.get()] if known else [] for state in (self.warnings, self.notices)]
        warnings = (before[0] + fold.warnings)[-self.most_messages :]
        notices = list(dict.fromkeys(before[1] + fold.notices))[: self.most_messages]
        for state, lines, new in ((self.warnings, warnings, fold.warnings), (self.notices, notices, fold.notices)):
            if new:
                state.put([(line,) for line in lines])
        return warnings, notices

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # those of one trigger come in any order; most logs have a few, so frames cost more than lists
        events = [Event._make(e) for f in rows for e in zip(*(f[c].tolist() for c in Event._fields), strict=True)]
        known = self.run.exists()
        run = dict(zip(RUN_NAMES, self.run.get(), strict=True)) if known else dict(EMPTY)
        newest = int(max(e.selection for e in events))
        if known and newest > run["selection"]:
            self._forget()
            known = False
        if not known:
            run = EMPTY | {"selection": newest}
        step = dict(zip(STEP_NAMES, self.step.get(), strict=True)) if known and self.step.exists() else None
        fold = Fold(run, step)
        for e in sorted((e for e in events if e.selection == run["selection"]), key=lambda e: (e.segment, e.line_no)):
            fold.take(e)
        held = self.held.get() if known else (0, 0)
        residuals, n_residuals = self._append(self.residuals, fold.residuals, held[0], self.most_residuals)
        steps, n_steps = self._append(self.steps, fold.steps, held[1], self.shown)
        self.held.update((n_residuals, n_steps))
        warnings, notices = self._messages(fold, known)
        self.run.update(tuple(fold.run.values()))
        if step is not None and fold.step is None:
            self.step.clear()
        if fold.step is not None:
            self.step.update(tuple(fold.step.values()))
            steps = [*steps, tuple(fold.step.values())][-self.shown :]
        if self.keep_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield self._row(key[0], fold, residuals, steps, warnings, notices)

    def _row(self, path: str, fold: Fold, residuals, steps, warnings, notices) -> pd.DataFrame:
        run = fold.run
        failure = None if run["failure_label"] is None else {"label": run["failure_label"], "line": run["failure_line"], "segment": run["failure_segment"], "simulation_time": run["failure_time"]}
        row = run | {
            "path": path, "failure": failure, "n_steps": run["n_steps"] + (fold.step is not None), "warnings": warnings, "notices": notices,
            "residuals": [dict(zip(names(RESIDUAL), r, strict=True)) for r in residuals], "time_steps": [dict(zip(STEP_NAMES, s, strict=True)) for s in steps],
        }
        return pd.DataFrame([[row[c] for c in OUT_NAMES]], columns=OUT_NAMES, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield from ()

    def close(self) -> None:
        pass


def _with_selection(lines: DataFrame) -> DataFrame:
    return lines if "selection" in lines.columns else lines.withColumn("selection", F.lit(0).cast("long"))


def folded_events(lines: DataFrame) -> DataFrame:
    """The events that matter to a run, the lines' text only where it is kept. A segment's first line, at 0, begins it."""
    events = E.extract(_with_selection(lines)).where(F.col("kind").isNotNull() | F.col("warning") | (F.col("line_no") == 0))
    text = F.when(F.col("warning") | F.col("kind").isin("fatal", "converged"), F.col("line"))
    return events.select("path", "selection", "segment", "line_no", text.alias("line"), "kind", "label", "region", "field", "x", "y", "z", "converged", "warning")


def stream_telemetry(lines: DataFrame, *, shown: int = SHOWN, most_residuals: int = MOST_RESIDUALS, most_messages: int = MOST_MESSAGES, keep_ms: int | None = None) -> DataFrame:
    """A row of OUT for a log each time it gets lines, in update mode. lines: a stream of (path, segment, line_no, line) and,
    where logs are chosen anew, selection, a number that grows with every choice.

    A log's lines must come in order from trigger to trigger; within one they may be in any order. One trigger's lines of
    a log are one task's: the option most of the log_tail source bounds them. State is kept in RocksDB.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = LogProcessor(shown, most_residuals, most_messages, keep_ms)
    return folded_events(lines).groupBy("path").transformWithStateInPandas(processor, OUT, "Update", "ProcessingTime" if keep_ms else "None")


def telemetry(lines: DataFrame, *, shown: int = SHOWN, most_messages: int = MOST_MESSAGES) -> DataFrame:
    """The rows of OUT with which a stream of the same lines ends, by windows and aggregates: only arrays that are bounded
    are collected, each cut by rank before."""
    newest = Window.partitionBy("path")
    events = folded_events(lines)
    if "selection" in lines.columns:
        events = events.withColumn("newest", F.max("selection").over(newest)).where("selection = newest").drop("newest")
    # lines are read and put in order once; all below reads what was written
    events = staged(E.in_steps(events), "log-events")
    stepped = events.withColumn("latest", F.max("segment").over(newest))
    now = F.col("segment") == F.col("latest")
    last_step = F.max("step").over(Window.partitionBy("path", "segment"))
    stepped = stepped.withColumn("open", F.col("step") == last_step)

    def last(kind: str, value: Column | str, extra: Column | None = None) -> Column:
        fits = now & (F.col("kind") == kind)
        return F.max_by(value, F.when(fits if extra is None else fits & extra, F.col("line_no")))

    failure = F.struct("label", "line", "segment", "simulation_time")
    flags = stepped.groupBy("path", "selection").agg(
        F.first("latest").alias("segment"), last("time", "x").alias("current_time"), last("delta_t", "x", F.col("open")).alias("current_delta_t"),
        last("timing", "x").alias("execution_seconds"), last("timing", "y").alias("clock_seconds"),
        F.coalesce(F.bool_or(now & (F.col("kind") == "end")), F.lit(False)).alias("completed"), F.coalesce(F.bool_or(now & (F.col("kind") == "converged")), F.lit(False)).alias("declared_converged"),
        last("fatal", failure).alias("failure"), F.max_by("region_so_far", F.when(now, F.col("line_no"))).alias("region"),
    )

    def cut(of: DataFrame, order: list[str], columns: list[str], name: str, most: int, latest: bool = True) -> DataFrame:
        """(path, name, count): an array of the last (or first) most rows in order."""
        ranked = of.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*[F.desc(c) if latest else F.col(c) for c in order])))
        entry = F.struct(*order, F.struct(*columns).alias("e"))
        listed = ranked.where(F.col("rank") <= most).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias(name))
        return listed.join(of.groupBy("path").agg(F.count(F.lit(1)).alias(f"n_{name}")), "path")

    place = ["segment", "line_no"]
    residuals = cut(E.residuals(events), place, names(RESIDUAL), "residuals", shown).withColumnRenamed("n_residuals", "counted")
    steps = cut(E.time_steps(events), ["segment", "step"], STEP_NAMES, "time_steps", shown)
    warned = cut(events.where("warning"), place, ["line"], "warnings", most_messages)
    noticed = events.where("kind = 'converged'").groupBy("path", "line").agg(F.min(F.struct(*place)).alias("at")).select("path", "line", "at.segment", "at.line_no")
    noticed = cut(noticed, place, ["line"], "notices", most_messages, latest=False)
    out = flags
    for part in (residuals, steps, warned, noticed):
        out = out.join(part, "path", "left")

    def listed(name: str, schema: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(f"array<struct<{_struct(schema)}>>")).cast(f"array<struct<{_struct(schema)}>>").alias(name)

    lists = [listed("residuals", RESIDUAL), listed("time_steps", STEP), *[F.coalesce(F.col(f"{c}.line"), F.array().cast("array<string>")).alias(c) for c in ("warnings", "notices")]]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("counted", "n_residuals"), ("n_time_steps", "n_steps"))]
    return out.select(*OUT_NAMES[:11], *counts, *lists)
