"""When to check a mesh: once for each state of its files, after they were left alone for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long files must stay as they are before a check.
STABLE_MS = 15_000
KNOWN = "signature string, observed_ms long, checked string, busy boolean"
OUT = "case string, signature string, state string, stable_ms long, next_check_ms long"


def observe(known: tuple | None, signature: str | None, modified_ms: int | None, busy: bool, now: int, stable_ms: int) -> tuple[tuple | None, tuple]:
    """What is known after a look at the files, and (signature, state, stable_ms, next_check_ms).

    state: unavailable without a mesh, deferred while the mesher works, completed if these files were checked, stabilizing
    until they have been left alone for stable_ms, then due, once. A changed signature starts the waiting anew, from the
    files' own time where that is earlier than now.
    """
    if signature is None:
        return known, (None, "unavailable", None, None)
    if known is None or known[0] != signature:
        since = now if modified_ms is None else min(now, modified_ms)
        known = (signature, since, known[2] if known else None, busy)
    _, since, checked, _ = known
    known, stable = (signature, since, checked, busy), max(0, now - since)
    if busy:
        return known, (signature, "deferred", stable, None)
    if checked == signature:
        return known, (signature, "completed", stable, None)
    if stable < stable_ms:
        return known, (signature, "stabilizing", stable, stable_ms - stable)
    return (signature, since, signature, busy), (signature, "due", stable, None)


class StabilityProcessor(StatefulProcessor):
    """A case's signature, since when it is seen, and the one last checked; a timer for when it will have been left alone."""

    def __init__(self, stable_ms: int):
        self.stable_ms = stable_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)

    def _row(self, case: str, row: tuple) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame({c: pd.Series([x], dtype=object) for c, x in zip(names, (case, *row), strict=True)})

    def _set_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        looks = pd.concat([f for f in rows])
        last = looks.sort_values("seq").iloc[-1]  # the files as they were seen last
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.known.get() if self.known.exists() else None
        signature = None if pd.isna(last.signature) else last.signature
        modified = None if pd.isna(last.modified_ms) else int(last.modified_ms)
        known, row = observe(before, signature, modified, bool(last.busy), now, self.stable_ms)
        if known is not None:
            self.known.update(known)
        self._set_timer(now + row[3] if row[3] is not None else None)
        yield self._row(key[0], row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Without another look since: the files were left alone, so a check is due."""
        before = self.known.get() if self.known.exists() else None
        if before is None or before[3] or before[2] == before[0]:
            return
        known, row = observe(before, before[0], None, False, timerValues.getCurrentProcessingTimeInMs(), self.stable_ms)
        self.known.update(known)
        if row[3] is not None:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() + row[3])
        yield self._row(key[0], row)

    def close(self) -> None:
        pass


def stream_checks(looks: DataFrame, stable_ms: int = STABLE_MS) -> DataFrame:
    """A row of OUT for each look at a case's files, and one with state due when they were left alone for stable_ms.

    looks: a stream of (case, seq, signature, modified_ms, busy); signature stands for the files (operators/catalog.py
    signature makes one), null without a mesh; the greatest seq of a trigger counts. A result of a check is current if the
    case's signature is still the one the check was due for (see current_results).
    """
    looks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = looks.selectExpr("CAST(case AS STRING) AS case", "CAST(seq AS LONG) AS seq", "CAST(signature AS STRING) AS signature", "CAST(modified_ms AS LONG) AS modified_ms", "coalesce(busy, false) AS busy")
    return rows.groupBy("case").transformWithStateInPandas(StabilityProcessor(stable_ms), OUT, "Update", "ProcessingTime")


def current_results(results: DataFrame, latest: DataFrame) -> DataFrame:
    """results (case, signature, ...) with current: whether the files are still those that were checked. A result of files
    that changed meanwhile isn't, nor is one of a case that latest (case, signature) doesn't have."""
    now = latest.selectExpr("case", "signature AS latest_signature")
    return results.join(now, "case", "left").selectExpr(*[f"`{c}`" for c in results.columns], "coalesce(signature = latest_signature, false) AS current")
