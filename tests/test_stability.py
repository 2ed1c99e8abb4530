"""Checks are due once for each state of the files, after they were left alone."""

import time

import pandas as pd

from runsight.streaming import stability
from tests.fakes import Clock, Handle


class Watch:
    """A processor with a clock that the test moves; timers fire when they are passed."""

    def __init__(self, stable_ms=15_000):
        self.handle, self.processor, self.seq = Handle(), stability.StabilityProcessor(stable_ms), 0
        self.processor.init(self.handle)

    def look(self, now, signature, busy=False, modified_ms=None):
        self.seq += 1
        rows = pd.DataFrame([(1, self.seq, signature, modified_ms, busy), (1, self.seq - 1, "older", None, True)], columns=["case", "seq", "signature", "modified_ms", "busy"])
        (out,) = self.processor.handleInputRows(("c",), iter([rows]), Clock(now))
        return self._said(out)

    def move(self, now):
        out = []
        for at in [t for t in self.handle.timers if t <= now]:
            self.handle.deleteTimer(at)
            out += [self._said(f) for f in self.processor.handleExpiredTimer(("c",), Clock(now), None)]
        return out

    @staticmethod
    def _said(frame):
        r = frame.iloc[0]
        return (r.state, r.stable_ms, r.next_check_ms)


def test_due_once_after_15_seconds():
    w = Watch()
    assert w.look(0, "a") == ("stabilizing", 0, 15_000)
    assert w.look(9_000, "a") == ("stabilizing", 9_000, 6_000)
    assert w.move(14_999) == [] and w.move(15_000) == [("due", 15_000, None)] and w.move(99_000) == []
    assert w.look(100_000, "a") == ("completed", 100_000, None)


def test_a_change_starts_anew():
    w = Watch()
    w.look(0, "a")
    assert w.look(14_000, "b") == ("stabilizing", 0, 15_000) and w.handle.timers == [29_000]
    assert w.move(15_000) == [] and w.move(29_000) == [("due", 15_000, None)]
    assert w.look(30_000, "a") == ("stabilizing", 0, 15_000)  # back to a: it is other files again


def test_busy_defers_and_old_files_are_due_at_once():
    w = Watch()
    assert w.look(0, "a", busy=True) == ("deferred", 0, None) and w.move(60_000) == []
    assert w.look(60_000, "a") == ("due", 60_000, None)
    w = Watch()
    assert w.look(100_000, "a", modified_ms=70_000) == ("due", 30_000, None)
    assert w.look(100_000, "b", modified_ms=95_000) == ("stabilizing", 5_000, 10_000)
    assert w.look(101_000, None) == ("unavailable", None, None) and w.handle.timers == []
    assert w.look(103_000, "b", modified_ms=95_000) == ("stabilizing", 8_000, 7_000)


def test_results_of_changed_files_are_discarded(spark):
    results = spark.createDataFrame([("c", "a", 1), ("d", "x", 2), ("e", "x", 3)], "case string, signature string, n int")
    latest = spark.createDataFrame([("c", "b"), ("d", "x")], "case string, signature string")
    assert sorted((r.case, r.n, r.current) for r in stability.current_results(results, latest).collect()) == [("c", 1, False), ("d", 2, True), ("e", 3, False)]


def test_stream_of_looks(spark, tmp_path):
    schema = "case int, seq long, signature string, modified_ms long, busy boolean"
    spark.createDataFrame([(1, 1, "a", None, False), (2, 1, "b", None, True)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    seen = []
    stream = stability.stream_checks(spark.readStream.schema(schema).json(f"{tmp_path}/in"), stable_ms=500)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((r.case, r.state) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    until = time.time() + 90
    while ("1", "due") not in seen and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert seen.count(("1", "due")) == 1 and ("1", "stabilizing") in seen and ("2", "deferred") in seen and ("2", "due") not in seen
