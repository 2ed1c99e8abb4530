"""Numeric history tables: text files of a time and groups of numbers, to rows, shapes, named components and series."""

from __future__ import annotations

import math
import shlex
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.columns import series_id
from runsight.functions.staging import staged
from runsight.operators import ranks, tablenames
from runsight.sources import tail

ROWS = "path string, row_no long, headers array<string>, probes int, t double, v array<double>, widths array<int>"


def tokens_of(text: str) -> list[str] | None:
    """Top-level tokens: words, and whole groups in parentheses; None if these don't balance."""
    if "(" not in text and ")" not in text:
        return text.split()
    out, depth, word = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return None
        if c.isspace() and depth == 0:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return None if depth else out + ([word] if word else [])


def numbers_of(token: str) -> list[float] | None:
    """The finite numbers of a token, however nested; None for anything else."""
    try:
        found = [float(x) for x in token.replace("(", " ").replace(")", " ").split()]
    except ValueError:
        return None
    return found if found and all(map(math.isfinite, found)) else None


def header_of(text: str) -> list[str]:
    """Column names of a header: quoted as in a shell, pieces joined until their parentheses balance."""
    try:
        words = shlex.split(text)
    except ValueError:
        words = text.split()
    out: list[str] = []
    for w in words:
        if out and out[-1].count("(") > out[-1].count(")"):
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def row_of(text: str) -> tuple[float, list[float], list[int]] | None:
    """(t, values, numbers in each group) of a row; None for one that isn't whole or holds anything but finite numbers."""
    tokens = tokens_of(text)
    groups = [numbers_of(x) for x in tokens] if tokens else []
    if len(groups) < 2 or any(g is None for g in groups) or len(groups[0]) != 1:
        return None
    return groups[0][0], [x for g in groups[1:] for x in g], [len(g) for g in groups[1:]]


#: Blanks at the ends of a line; lines of nothing but numbers' characters, blanks and parentheses; a number that Python and
#: Arrow read alike.
BLANKS, PLAIN, PLAIN_NUMBER = " \t\n\x0b\f\r", r"^[0-9+\-.eE() \t]*$", r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
PARSED = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("t", pa.float64()), ("v", pa.list_(pa.float64())), ("widths", pa.list_(pa.int32()))])


def plain_rows(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(rows, others) of lines: PARSED rows of those that have only plain numbers in groups, and the lines that row_of() has to
    judge. row_of() sees each different arrangement of groups once; numbers are cast as columns."""
    plain = pc.fill_null(pc.match_substring_regex(batch["line"], PLAIN), False)
    lines, others = batch.filter(plain), batch.filter(pc.invert(plain))
    shapes = pc.replace_substring_regex(lines["line"], r"[0-9+\-.eE]+", "1").dictionary_encode()
    widths = pa.array([r[2] if (r := row_of(x)) else None for x in shapes.dictionary.to_pylist()], pa.list_(pa.int32())).take(shapes.indices)
    lines, widths = lines.filter(widths.is_valid()), widths.filter(widths.is_valid())
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(lines["line"], "[()]", " ")))
    flat = words.flatten()
    try:
        numbers = np.asarray(flat.cast(pa.float64()))
    except pa.ArrowInvalid:
        numbers = np.asarray(pc.if_else(pc.match_substring_regex(flat, PLAIN_NUMBER), flat, "inf").cast(pa.float64()))
    ends = np.asarray(words.offsets)
    bad = np.add.reduceat(~np.isfinite(numbers), ends[:-1]) > 0 if len(lines) else np.zeros(0, bool)
    if bad.any():
        again = pa.array(bad)
        more, rest = lines.filter(again), lines.filter(pc.invert(again))
        rows, _ = plain_rows(rest)
        return rows, pa.Table.from_batches([others, more]).combine_chunks().to_batches()[0]
    first = np.zeros(len(numbers), bool)
    first[ends[:-1]] = True
    v = pa.ListArray.from_arrays(pa.array(ends - np.arange(len(ends)), pa.int32()), pa.array(numbers[~first]))
    return pa.RecordBatch.from_arrays([lines["path"], lines["line_no"], pa.array(numbers[first]), v, widths], schema=PARSED), others


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_words(text: pd.Series) -> pd.Series:
    return text.map(header_of)


def parsed_rows(lines: DataFrame) -> DataFrame:
    """(path, row_no, t, v, widths) of the lines (path, line_no, line) of tables: row_no is the line's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, others = plain_rows(batch)
            found = [(p, n, *r) for p, n, x in zip(*(others[c].to_pylist() for c in ("path", "line_no", "line")), strict=True) if (r := row_of(x)) is not None]
            yield rows
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], PARSED.types[k]) for k in range(len(PARSED))], schema=PARSED)

    rows = stripped(lines).where(~F.col("line").startswith("#")).select("path", F.col("line_no").cast("long").alias("line_no"), "line")
    return rows.mapInArrow(run, "path string, row_no long, t double, v array<double>, widths array<int>")


def stripped(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.btrim("line", F.lit(BLANKS)).alias("line")).where("line <> ''")


def table_heads(lines: DataFrame) -> DataFrame:
    """(path, headers, probes) of the tables whose lines (path, line_no, line) have a header: its last one that begins with Time,
    in any case, of which only the names behind the time are kept, and how many probes are named in all of it."""
    marked = stripped(lines).where(F.col("line").startswith("#")).withColumn("words", header_words(F.expr("substring(line, 2)")))
    first = F.lower(F.get("words", F.lit(0)))
    return marked.withColumn("first", first).groupBy("path").agg(
        F.max_by(F.expr("slice(words, 2, size(words))"), F.when(F.col("first") == "time", F.col("line_no"))).alias("headers"), F.count_if(F.col("first") == "probe").cast("int").alias("probes")
    )


def with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with headers and probes of their path, none without a header."""
    headers, probes = F.coalesce("headers", F.array().cast("array<string>")), F.coalesce("probes", F.lit(0))
    return rows.join(heads, "path", "left").withColumns({"headers": headers, "probes": probes})


def rows_of_lines(lines: DataFrame) -> DataFrame:
    """ROWS of the lines (path, line_no, line) of tables, in any partitioning: row_no is the line's number.

    A table's header and its probes are found over all of it, so both hold for every row whichever part of the file it was
    read in.
    """
    return with_heads(parsed_rows(lines), table_heads(lines)).select("path", "row_no", "headers", "probes", "t", "v", "widths")


def table_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """ROWS of the files, from any store that Spark reads; a file is read by one task."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows_of_lines(whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")))


def split_table_rows(spark: SparkSession, where: str, split: int = tail.SPLIT_BYTES) -> DataFrame:
    """ROWS of the files that where means (a file or a pattern), on a mount that all share, read in ranges of split bytes."""
    tail.register(spark)
    return rows_of_lines(spark.read.format("log_tail").option("split", split).option("rest", True).load(where))


def usual_shape(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(path, widths, headers, probes): each path's most frequent shape, of equally frequent ones that which comes first. With
    names in the header only shapes with as many groups count, or as there are probes. heads: table_heads() of rows without."""
    key = ["path", "widths"] + ["headers", "probes"] * (heads is None)
    shapes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("row_no").alias("first"))
    shapes = shapes if heads is None else with_heads(shapes, heads)
    groups = F.when(F.col("probes") > 0, F.col("probes")).otherwise(F.size("headers"))
    fit = shapes.where((F.size("headers") == 0) | (F.size("widths") == groups))
    return fit.groupBy("path").agg(F.max(F.struct("c", (-F.col("first")).alias("order"), "widths", "headers", "probes")).alias("m")).select("path", "m.widths", "m.headers", "m.probes")


def largest_shape(rows: DataFrame, source: str = "source") -> DataFrame:
    """rows of the shape with the most numbers in all files of a source, of equally large ones the greatest."""
    total = F.aggregate("widths", F.lit(0), lambda a, x: a + x)
    best = rows.groupBy(source).agg(F.max(F.struct(total.alias("s"), "widths")).alias("m")).select(source, F.col("m.widths").alias("widths"))
    return rows.join(best, [source, "widths"])


# The components of a group, by its size.
VECTOR = ("x", "y", "z")
TENSOR = tuple(a + b for a in VECTOR for b in VECTOR)
FORCE_PARTS = ("pressure", "viscous", "porous")
DESCRIPTOR = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType() if c == "at" else T.StringType()) for c in ("field", "operation", "component", "at")]))


def named(header: str, function: str, declared: list[str], operation: str | None, start: int, width: int) -> list[tuple]:
    """(field, operation, component, place) of a group of width numbers from place start on, under its header."""
    if "(" in header and header.endswith(")"):
        operation, field = header[:-1].split("(", 1)
    else:
        field = declared[0] if len(declared) == 1 and header.lower() in ("value", "values") else header
    if width == 1:
        return [(field, operation, None, start)]
    if width == 3:
        return [(field, operation, c, start + i) for i, c in enumerate(VECTOR)] + [(field, operation, "magnitude", start)]
    kind = "moment" if "moment" in header.lower() else "force"
    if width == 9 and ("force" in function.lower() or kind in header.lower()):
        return [(f"{kind} {part}", None, c, start + 3 * i + k) for i, part in enumerate(FORCE_PARTS) for k, c in enumerate(VECTOR)]
    if width == 9:
        return [(field, operation, c, start + i) for i, c in enumerate(TENSOR)]
    return [(f"{field}[{i}]", operation, None, start + i) for i in range(width)]


def described(headers: list[str], probes: int, widths: list[int], function: str, declared: list[str], operation: str | None) -> list[tuple]:
    """What a row's numbers are: by the header's names, if each group has one; else all are one group, of probes if there are
    as many, under the first name, the declared field or value."""
    if headers and len(headers) == len(widths):
        starts = [sum(widths[:i]) for i in range(len(widths))]
        return [d for h, s, w in zip(headers, starts, widths, strict=True) for d in named(h, function, declared, operation, s, w)]
    base, width = headers[0] if headers else (declared[0] if declared else "value"), sum(widths)
    if probes and probes == width:
        field, said, _, _ = named(base, function, declared, operation, 0, 1)[0]
        return [(field, said, f"probe {i}", i) for i in range(width)]
    return named(base, function, declared, operation, 0, width)


@F.pandas_udf(DESCRIPTOR)
def descriptors(headers: pd.Series, probes: pd.Series, widths: pd.Series, function: pd.Series, declared: pd.Series, operation: pd.Series) -> pd.Series:
    """described() for each row; called for the different tables, not for their rows."""
    columns = zip(headers, probes, widths, function, declared, operation, strict=True)
    return pd.Series([[dict(zip(("field", "operation", "component", "at"), d, strict=True)) for d in described(list(h), int(n), [int(x) for x in w], f, list(d) if d is not None else [], o)] for h, n, w, f, d, o in columns])


SERIES = "series_id string, label string, function_name string, function_type string, source string, region string, field string, operation string, component string"


def discovered(rows: DataFrame, files: DataFrame, specs: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, series) of table rows (ROWS, or parsed_rows() with their table_heads() beside them), whose paths are below the folder of tables; files: (path, modified_ns); specs:
    the declared functions (tablenames.SPECS).

    A source's files are its restarts: the last one's folders name the function. Of its shapes the largest counts, the
    first file that has it gives header and probes, later samples replace earlier ones of the same time. Numbers become
    series by descriptors(), vectors have a magnitude besides. series: SERIES and modified_ns, the newest of the files
    that count; points: (series_id, t, v, i, n), i the place in order of t, n how many; each row of a table parsed once. A source
    without rows has no series.
    """
    placed = tablenames.with_functions(files.select("path"), specs)
    owner = tablenames.source_functions(files.select("path"), specs).drop("files")
    rows = staged(rows, "table-rows")  # parsed once
    # a row for each table; the tables' own rows are met again only as they are merged
    usual = staged(largest_shape(usual_shape(rows, heads).join(placed.select("path", "source", "start"), "path")), "shapes")
    first = usual.groupBy("source").agg(F.min_by(F.struct("headers", "probes", "widths"), F.struct("start", "path")).alias("h"))
    newest = usual.select("source", "path").distinct().join(files.select("path", "modified_ns"), "path").groupBy("source").agg(F.max("modified_ns").alias("modified_ns"))
    known = specs.dropDuplicates(["function"]).select("function", "fields", "operation")
    tables = first.join(owner, "source").join(known, "function", "left").join(newest, "source")
    told = tables.withColumn("d", F.explode(descriptors("h.headers", "h.probes", "h.widths", "type", F.coalesce("fields", F.array().cast("array<string>")), "operation")))
    parts = ["function", "type", "region", "d.field", "d.operation", "d.component", "source"]
    label = F.array_join(F.filter(F.array(F.col("function"), F.col("d.operation"), F.col("d.field"), F.col("d.component")), lambda x: x.isNotNull() & (x != "")), " ")
    series = told.select(
        series_id(*[F.col(c) for c in parts]).alias("series_id"), label.alias("label"), F.col("function").alias("function_name"), F.col("type").alias("function_type"), "source", "region",
        F.col("d.field").alias("field"), F.col("d.operation").alias("operation"), F.col("d.component").alias("component"), "modified_ns", F.col("d.at").alias("at"),
    )
    series = staged(series, "series")
    kept = rows.join(usual.select("path", "widths", "source", "start"), ["path", "widths"]).select("source", "t", "v", "start", "path", "row_no")
    # all series of a source have its times, so their places are numbered once; the merge stays in the tasks of the ranges
    merged = kept.repartitionByRange("source", "t").groupBy("source", "t").agg(F.max_by("v", F.struct("start", "path", "row_no")).alias("v"))
    merged = ranks.placed(merged, "source", "t")
    ids = series.groupBy("source").agg(F.collect_list(F.struct("series_id", "component", "at")).alias("ids"))  # a few of each source
    each = merged.join(ids, "source").select("t", "v", "i", "n", F.explode("ids").alias("s")).where(F.col("s.at") < F.size("v"))
    norm = F.sqrt(F.aggregate(F.slice("v", F.col("s.at") + 1, F.lit(3)), F.lit(0.0), lambda a, x: a + x * x))
    value = F.when(F.col("s.component") == "magnitude", norm).otherwise(F.get("v", F.col("s.at")))
    return each.select(F.col("s.series_id").alias("series_id"), "t", value.alias("v"), "i", "n"), series.drop("at")
