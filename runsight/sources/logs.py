"""Lines of log files, in batch: numbered, whole lines only."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of log files: log, log.* and *.log.
LOG_NAME = r"(?i)(^log$|^log\.|\.log$)"


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_ns, size) of the log files below root; contents aren't read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(LOG_NAME))
    return named.select("path", (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.col("length").alias("size"))


#: Bytes at either end of a log by which it is classified.
END_BYTES = 64 << 10


def log_ends(files: DataFrame, most: int = END_BYTES) -> DataFrame:
    """files (path, ...) with head and tail, the text of the first and last most bytes: tasks read these alone, of logs on a
    mount that all executors share. A log that is gone, or can't be read, has empty ones."""

    def ends(path: str) -> tuple[str, str]:
        try:
            with open(unquote(urlparse(path).path), "rb") as f:
                head = f.read(most)
                size = f.seek(0, 2)
                f.seek(max(0, size - most))
                return head.decode("utf-8", "replace"), f.read(most).decode("utf-8", "replace")
        except OSError:
            return "", ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame([(path, *ends(path))], columns=["path", "head", "tail"])

    read = files.select("path").mapInPandas(run, "path string, head string, tail string")
    return files.join(read, "path")


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, segment, line_no, line): lines end with \\n, a \\r before it goes, what stands behind the last \\n isn't a line yet.

    A file is one task's: line numbers need its whole order. Many logs are many tasks.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.split("value", "\n", -1)
    rows = whole.select("path", F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("line_no", "line"))
    return rows.select("path", F.lit(0).alias("segment"), F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"\r+$", "").alias("line"))
