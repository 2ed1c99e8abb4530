"""Names of numeric tables: which declared function wrote a table, by the folders of its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared functions, one row each.
SPECS = "function string, type string, fields array<string>, region string, operation string"
#: A folder that names the time at which a run was started.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: The folder of all tables, and the type of a table that no declared function wrote.
ROOT, GENERIC = "postProcessing", "generic_table"
#: From how many values on a series that never changes counts as constant.
LEAST_CONSTANT = 20


def function_specs(spark: SparkSession, declared: list[tuple]) -> DataFrame:
    """declared functions (casedict.declared_functions) as rows of SPECS."""
    return spark.createDataFrame(declared, SPECS)


def with_functions(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, source, function, type, region, start) of each different path below the folder of tables.

    The last folder that is a number is the start of the run, 0 without one; source is the path without it. Of the
    folders before it the first that names a declared function gives function and type; its region is the declared one,
    else the folder before. Without a declared function the last folder gives the function (the file's name without its
    ending, if there is none) and the one before the region. A null path is left out.
    """
    parts = F.split("path", "/")
    rows = paths.where("path IS NOT NULL").select("path").distinct().withColumn("parts", parts)
    numbers = F.transform("parts", lambda p, i: F.when((i < F.size("parts") - 1) & p.rlike(NUMBER), i))
    rows = rows.withColumn("at", F.array_max(numbers))
    rows = rows.withColumn("before", F.slice("parts", F.lit(1), F.coalesce("at", F.size("parts") - 1)))
    folders = rows.select("path", F.posexplode("before").alias("place", "function"))
    # a declared function is known once, whatever the number of its rows
    known = specs.select("function", "type", F.col("region").alias("own_region")).dropDuplicates(["function"])
    first = folders.join(known, "function").groupBy("path").agg(F.min_by(F.struct("function", "type", "own_region", "place"), "place").alias("m"))
    out = rows.join(first, "path", "left")
    file = F.regexp_replace(F.element_at("parts", -1), r"^(.+)\.[^.]+$", "$1")

    def folder(at: Column) -> Column:
        return F.when(at >= 0, F.get("before", at))

    last = F.size("before") - 1
    declared = F.col("m").isNotNull()
    return out.select(
        "path",
        F.concat_ws("/", F.lit(ROOT), F.array_join(F.filter("parts", lambda p, i: F.col("at").isNull() | (i != F.col("at"))), "/")).alias("source"),
        F.when(declared, F.col("m.function")).otherwise(F.coalesce(folder(last), file)).alias("function"),
        F.when(declared, F.col("m.type")).otherwise(F.lit(GENERIC)).alias("type"),
        F.when(declared, F.coalesce("m.own_region", folder(F.col("m.place") - 1))).otherwise(folder(last - 1)).alias("region"),
        F.coalesce(F.get("parts", F.col("at")).try_cast("double"), F.lit(0.0)).alias("start"),
    )


def source_functions(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """(source, function, type, region, files): with_functions() for each source, whose restarts' tables are merged; of
    different answers that of the last start counts, then of the greatest path."""
    last = F.max_by(F.struct("function", "type", "region"), F.struct("start", "path"))
    return with_functions(paths, specs).groupBy("source").agg(last.alias("m"), F.count(F.lit(1)).alias("files")).select("source", "m.*", "files")


def constant_series(points: DataFrame) -> DataFrame:
    """(series_id, n, constant): whether all of at least LEAST_CONSTANT values of a series are equal; null values don't count."""
    n = F.count("v")
    same = (n >= LEAST_CONSTANT) & F.coalesce(F.min("v") == F.max("v"), F.lit(False))
    return points.groupBy("series_id").agg(n.alias("n"), same.alias("constant"))


def unknown_names(given: Column, known: list[str]) -> Column:
    """The names in an array that aren't known, in order, once each; null for a null array."""
    return F.array_sort(F.array_except(given, F.array(*map(F.lit, known)).cast("array<string>")))
