"""Lines of growing logs by byte ranges: spark.readStream.format("log_tail").load(path), or spark.read for what is there.

Spark's own file stream takes a file once and never sees what is appended, so this source keeps byte offsets. The driver
looks at sizes alone; ranges of bytes are read by the executors.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from runsight.sources.logs import LOG_NAME

SCHEMA = "path string, segment int, line_no long, line string"
ARROW = pa.schema([("path", pa.string()), ("segment", pa.int32()), ("line_no", pa.int64()), ("line", pa.string())])
#: Bytes of a range, unless the option split has another number; bytes read at a time.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes from begin up to end of a file, which is known by device and inode."""

    path: str
    segment: int
    begin: int
    end: int
    device: int
    inode: int
    rest: bool = False


def cut(path: str, state: dict, begin: int, split: int) -> list[Range]:
    """The ranges of at most split bytes from begin to the size that state has."""
    size = state["size"]
    return [Range(path, state["segment"], a, min(a + split, size), state["device"], state["inode"]) for a in range(begin, size, split)]


def line_start(f, place: int) -> int:
    """Where the line begins that the byte in front of place belongs to: behind the last \\n before it."""
    while place > 0:
        step = min(READ_BYTES, place)
        f.seek(place - step)
        found = f.read(step).rfind(b"\n")
        if found >= 0:
            return place - step + found + 1
        place -= step
    return 0


def lines_ending_in(f, begin: int, end: int, rest: bool = False) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, lines) of the lines whose \\n stands in [begin, end), some at a time; a place is where a line begins.

    A range without a \\n gives nothing and holds nothing; the one that has a line's end reads the line back to its
    begin, whichever ranges that is in. So any cuts give the same lines, and what stands behind the last \\n waits; with
    rest it is a line too.
    """
    at, start, pieces = begin, None, []
    while at < end:
        f.seek(at)
        data = f.read(min(READ_BYTES, end - at))
        if not data:
            return  # the file is shorter by now
        stop = data.rfind(b"\n")
        if stop < 0:
            if start is not None:
                pieces.append(data)
            at += len(data)
            continue
        if start is None:
            start = line_start(f, begin)
            f.seek(start)
            pieces = [f.read(at - start)] if start < at else []
        block = b"".join([*pieces, data[: stop + 1]])
        ends = np.flatnonzero(np.frombuffer(block, dtype=np.uint8) == 10)
        places = start + np.concatenate([[0], ends[:-1] + 1])
        yield places, [line.rstrip("\r") for line in block.decode("utf-8", "replace").split("\n")[:-1]]
        at, start, pieces = at + len(data), at + stop + 1, [data[stop + 1 :]]
    if rest:
        start = line_start(f, end) if start is None else start
        f.seek(start)
        if data := f.read(end - start):
            yield np.array([start]), [data.decode("utf-8", "replace").rstrip("\r")]


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA. A file that is gone or another one by now gives none: its bytes are no more."""
    try:
        f = open(part.path, "rb")
    except OSError:
        return
    with f:
        s = os.fstat(f.fileno())
        if (s.st_dev, s.st_ino) != (part.device, part.inode):
            return
        for places, lines in lines_ending_in(f, part.begin, part.end, part.rest):
            n = len(lines)
            columns = [pa.array([part.path] * n, pa.string()), pa.array(np.full(n, part.segment, dtype=np.int32)), pa.array(places, pa.int64()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def log_paths(where: str) -> list[str]:
    """The files that a path means: the logs below a folder, by their names; a file; or what a pattern matches."""
    if os.path.isdir(where):
        found = [os.path.join(folder, name) for folder, _, names in os.walk(where) for name in names if re.search(LOG_NAME, name)]
    else:
        found = [where] if os.path.exists(where) else [p for p in glob.glob(where, recursive=True) if os.path.isfile(p)]
    return sorted(found)


def look(where: str, known: dict, most: int | None = None) -> dict:
    """path: {segment, size, device, inode} of each log. A log that shrank or is another file than the known one begins a
    new segment; one that is gone keeps what was known. size grows by at most most bytes."""
    out = dict(known)
    for path in log_paths(where):
        try:
            s = os.stat(path)
        except OSError:
            continue
        before = known.get(path)
        segment, begin = 0, 0
        if before:
            again = (s.st_dev, s.st_ino) == (before["device"], before["inode"]) and s.st_size >= before["size"]
            segment, begin = (before["segment"], before["size"]) if again else (before["segment"] + 1, 0)
        size = s.st_size if most is None else min(s.st_size, begin + most)
        out[path] = {"segment": segment, "size": size, "device": s.st_dev, "inode": s.st_ino}
    return out


class LogReader(DataSourceReader):
    """The lines that are there, in ranges."""

    def __init__(self, where: str, split: int, rest: bool):
        self.where, self.split, self.rest = where, split, rest

    def partitions(self) -> list[Range]:
        found = [cut(path, state, 0, self.split) for path, state in look(self.where, {}).items()]
        for ranges in found:
            if ranges:
                ranges[-1].rest = self.rest
        return [r for ranges in found for r in ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class TailReader(DataSourceStreamReader):
    """Offsets have each log's segment, size and identity, about 100 bytes a log. A batch is the bytes between two sizes,
    or the new segment's from its begin; a replay reads the same bytes. What was known is taken from the checkpoint: Spark
    plans or commits the last batch again before it asks for the latest offset."""

    def __init__(self, where: str, split: int, most: int | None = None):
        self.where, self.split, self.most = where, split, most
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = look(self.where, self.known or {}, self.most)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.known is None:
            self.known = end
        found = []
        for path, state in end.items():
            before = start.get(path)
            begin = before["size"] if before and before["segment"] == state["segment"] else 0
            found += cut(path, state, begin, self.split)
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        if self.known is None:
            self.known = end


class LogTail(DataSource):
    """Lines of logs: path is a file, a folder or a pattern, on a mount that the driver and the executors share; split, the
    bytes of a range; most, of a stream, the bytes that a batch takes of a log; rest, of a table
    that isn't a stream, whether what stands behind the last \\n is a line. line_no is the byte at which a line begins: it orders a log's lines, and a replay gives the same.

    Lines end with \\n, a \\r before it goes, bytes that aren't UTF-8 are replaced, and what stands behind a log's last
    \\n isn't a line yet. A line may be of any length, as far as it fits a row, and no line holds up others. Logs, however
    many, are read in parallel, and a large one by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def _how(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split", SPLIT_BYTES))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._how(), self.options.get("rest", "false").lower() == "true")

    def streamReader(self, schema) -> TailReader:
        most = self.options.get("most")
        return TailReader(*self._how(), int(most) if most else None)


def register(spark) -> None:
    spark.dataSource.register(LogTail)
