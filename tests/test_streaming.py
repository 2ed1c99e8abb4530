"""A stream of log lines, in any chunks and over restarts, ends with the rows that the batch gives."""

import random
import time

from runsight.streaming import logs
from tests.fakes import Clock, Handle

LINES = "path string, segment int, line_no long, line string"
LOG = """Build  : demo run on 4 ranks
Region air
deltaT = 0.5
PIMPLE: iteration 9
DILUPBiCGStab:  Solving for Uz, Initial residual = 6.5e-03, Final residual = 4e-06, No Iterations 1
Time = 1.5
deltaT = 0.0125
Courant Number mean: 0.031 max: 0.47
DILUPBiCGStab:  Solving for Uy, Initial residual = 4.2e-02, Final residual = 3.1e-05, No Iterations 2
PIMPLE: iteration 1
porous: PCG:  Solving for T, Initial residual = 0.33, Final residual = .004, No Iterations = 40 failed
PIMPLE: iteration 3
PIMPLE: iteration 2
PCG:  Solving for p_rgh, Initial residual = 0.07, Final residual = 8e-4, No Iterations 21 converged
time step continuity errors : sum local = 3.5e-07, global = 6e-09, cumulative = -2.1e-07
--> FOAM Warning : patch outlet has back flow
ExecutionTime = 4.75 s  ClockTime = 6 s
water: Time = 1.5125
Mesh Courant Number mean: 0.002 max: 0.09
water: Courant Number mean: 0.05 max: 2.25
DILUPBiCGStab:  Solving for Uz, Initial residual = 6.5e-03, Final residual = 4e-06, No Iterations 1
PIMPLE: convergence criteria satisfied in 3 loops
warning: the same again
Time = 1.525
PIMPLE: convergence criteria satisfied in 3 loops
ExecutionTime = 9.5 s  ClockTime = 12 s
[2] Segmentation fault
End""".split("\n")


def plain(row):
    return row.asDict(recursive=True)


def rows_of(log, path="a", segment=0, at=0):
    return [(path, segment, at + 10 * i, x) for i, x in enumerate(log)]


def test_batch_row(spark):
    (row,) = logs.telemetry(spark.createDataFrame(rows_of(LOG) + rows_of(LOG[:19], segment=1), LINES), shown=3).collect()
    assert (row.segment, row.current_time, row.current_delta_t, row.region, row.execution_seconds, row.clock_seconds) == (1, 1.5125, None, "water", 4.75, 6.0)
    assert (row.completed, row.declared_converged, row.failure) == (False, False, None)  # a new segment starts these anew
    assert row.n_residuals == 7 and row.n_steps == 5
    assert [(r.segment, r.field, r.region, r.converged, r.outer_corrector) for r in row.residuals] == [(1, "Uy", "air", None, 0), (1, "T", "porous", False, 1), (1, "p_rgh", "air", True, 3)]
    assert [(s.segment, s.simulation_time, s.delta_t, s.courant_max, s.mesh_courant_max, s.continuity_global, s.outer_correctors) for s in row.time_steps] == [
        (0, 1.525, None, None, None, None, 0), (1, 1.5, 0.0125, 0.47, None, 6e-09, 3), (1, 1.5125, None, None, 0.09, None, 0)]
    assert row.warnings == ["--> FOAM Warning : patch outlet has back flow", "warning: the same again", "--> FOAM Warning : patch outlet has back flow"]
    assert row.notices == ["PIMPLE: convergence criteria satisfied in 3 loops"]
    (first,) = logs.telemetry(spark.createDataFrame(rows_of(LOG), LINES)).collect()
    assert first.failure.asDict() == {"label": "Segmentation fault", "line": "[2] Segmentation fault", "segment": 0, "simulation_time": 1.525} and first.completed


def chunked(spark, tmp_path, rows, schema, seed, **how):
    """The last rows of a stream over chunks of rows, each of which repeats lines of the one before, with two restarts."""
    draw, at, files = random.Random(seed), 0, 0
    last = {}

    def keep(df, n):
        for r in df.collect():
            last[r.path] = plain(r)

    while at < len(rows):
        for _ in range(draw.randrange(1, 4)):
            size = draw.randrange(1, 25)
            part = rows[max(0, at - 3) : at + size]
            draw.shuffle(part)  # lines of one trigger come in any order
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            at, files = at + size, files + 1
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = logs.stream_telemetry(stream, **how).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert files > 2
    return last


def test_stream_equals_batch_over_chunks_and_restarts(spark, tmp_path):
    rows = rows_of(LOG) + rows_of(LOG, "b", 0, 5) + rows_of(LOG[:9], "b", 1) + rows_of(["nothing to see"], "a", 1) + rows_of(LOG[5:20], "b", 2)
    last = chunked(spark, tmp_path, rows, LINES, 3, shown=4, most_messages=2)
    want = {r.path: plain(r) for r in logs.telemetry(spark.createDataFrame(rows, LINES), shown=4, most_messages=2).collect()}
    assert last == want and last["a"]["segment"] == 1 and not last["a"]["completed"]


def test_new_selection_discards_the_state(spark, tmp_path):
    rows = [(1, *r) for r in rows_of(LOG)] + [(2, *r) for r in rows_of(LOG[5:9], segment=0, at=0)]
    schema = "selection long, " + LINES
    last = chunked(spark, tmp_path, rows, schema, 5)
    want = {r.path: plain(r) for r in logs.telemetry(spark.createDataFrame(rows, schema)).collect()}
    assert last == want and last["a"]["selection"] == 2 and last["a"]["n_steps"] == 1 and last["a"]["warnings"] == []


def events(spark, rows):
    return logs.folded_events(spark.createDataFrame(rows, LINES)).toPandas()


def test_histories_are_bounded_and_forgotten(spark):
    """Lists hold at most twice what is kept; a log that is silent for long enough is forgotten."""
    handle, processor = Handle(), logs.LogProcessor(shown=5, most_residuals=20, most_messages=3, keep_ms=1000)
    processor.init(handle)
    log = ["Time = 1"] + [f"s:  Solving for U, Initial residual = {i}, Final residual = 1, No Iterations 1" for i in range(90)] + [f"warning {i}" for i in range(9)]
    frames = events(spark, rows_of(log))
    for at in range(0, len(frames), 7):
        (out,) = processor.handleInputRows(("a",), iter([frames[at : at + 7]]), Clock(at))
        assert len(handle.states["residuals"].value or []) <= 40 and handle.timers == [at + 1000]
    row = out.iloc[0]
    assert row.n_residuals == 90 and [r["initial"] for r in row.residuals] == [85.0, 86.0, 87.0, 88.0, 89.0] and row.warnings == ["warning 6", "warning 7", "warning 8"]
    assert handle.states["residuals"].puts < 5
    assert [r[3] for r in handle.states["residuals"].value][-20:] == [float(i) for i in range(70, 90)]
    assert list(processor.handleExpiredTimer(("a",), None, None)) == []
    assert all(not s.exists() for s in handle.states.values())


def test_silent_logs_expire_in_a_stream(spark, tmp_path):
    """A log is forgotten after keep_ms, so its next lines begin a run anew; one that isn't silent goes on."""
    seen = []

    def run(rows, keep_ms):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(LINES).json(f"{tmp_path}/in")
        query = logs.stream_telemetry(stream, keep_ms=keep_ms).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append({r.path: r.n_steps for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/cp").start()
        until = time.time() + 60  # with timers there is always one more batch, so nothing ends by itself
        while not any(p["numInputRows"] for p in query.recentProgress) and time.time() < until:
            time.sleep(0.1)
        query.stop()

    run(rows_of(["Time = 1", "Time = 2"]), 1)
    run(rows_of(["Time = 7"], "b"), 1)  # "a" has been silent for over a millisecond
    run(rows_of(["Time = 3"], at=100), 1)
    assert [s["a"] for s in seen if "a" in s] == [2, 1]


def test_a_new_log_asks_little_of_its_state(spark, monkeypatch):
    """Most logs of a trigger may be new ones: theirs is neither cleared nor read."""
    handle, processor = Handle(), logs.LogProcessor(shown=5, most_residuals=20, most_messages=3, keep_ms=None)
    processor.init(handle)
    asked = []
    for name in ("clear", "get"):
        monkeypatch.setattr(f"tests.fakes.Held.{name}", lambda self, n=name, f=getattr(type(handle.states["run"]), name): (asked.append(n), f(self))[1])
    (out,) = processor.handleInputRows(("a",), iter([events(spark, rows_of(LOG))]), Clock(0))
    assert out.iloc[0].n_steps == 3 and asked == []
