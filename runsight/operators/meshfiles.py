"""Which mesh of a case is the newest complete one, by its files."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.operators.tablenames import NUMBER

# The files that a mesh needs, its folders, and what is said where there is none.
CORE = ("points", "faces", "owner", "neighbour", "boundary")
MESH = "polyMesh"
DECOMPOSED = "Only decomposed processor meshes were found; reconstruct an undecomposed mesh before the automatic check."
NONE_YET = "No complete undecomposed polyMesh was found yet."


def mesh_probe(files: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, source, signature, newest_ns, reason) of each of cases (case), by files (case, path, modified_ns, size) with
    paths below the case.

    A mesh is complete if each of the CORE files is there, or else its .gz. The one of the largest time counts, of equal
    ones the first by name, that of constant comes last. signature: text of the folder and the files with sizes and times.
    Without a complete mesh, reason says whether there are decomposed ones.
    """
    parts = F.split("path", "/")
    rows = files.withColumns({"folder": F.get(parts, F.lit(0)), "inner": F.get(parts, F.lit(1)), "name": F.get(parts, F.lit(2)), "depth": F.size(parts)})
    time = F.when(F.col("folder") == "constant", float("-inf")).when(F.col("folder").rlike(NUMBER), F.col("folder").try_cast("double"))
    core = rows.where((F.col("depth") == 3) & (F.col("inner") == MESH)).withColumns({"time": time, "of": F.regexp_replace("name", r"\.gz$", "")}).where(F.col("of").isin(*CORE) & F.col("time").isNotNull() & (F.col("time") < float("inf")))
    # of a file and its .gz the plain one counts
    one = core.groupBy("case", "folder", "time", "of").agg(F.min_by(F.struct("name", "size", "modified_ns"), F.length("name")).alias("f"))
    place = F.array_position(F.array(*map(F.lit, CORE)), F.col("of"))
    meshes = one.groupBy("case", "folder", "time").agg(F.count(F.lit(1)).alias("n"), F.max("f.modified_ns").alias("newest_ns"), F.sort_array(F.collect_list(F.struct(place.alias("k"), "f"))).alias("l")).where(F.col("n") == len(CORE))
    best = meshes.withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("time"), "folder"))).where("k = 1")
    source = F.concat_ws("/", "folder", F.lit(MESH))
    signature = F.concat_ws("|", source, F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["f"]["name"], x["f"]["size"].cast("string"), x["f"]["modified_ns"].cast("string"))), "|"))
    split = rows.groupBy("case").agg(F.bool_or(F.col("folder").rlike(r"^processor\d+$") & (F.col("depth") > 1)).alias("split"))
    out = cases.join(best.select("case", source.alias("source"), signature.alias("signature"), "newest_ns"), "case", "left").join(split, "case", "left")
    reason = F.when(F.col("source").isNull(), F.when(F.coalesce("split", F.lit(False)), DECOMPOSED).otherwise(NONE_YET))
    return out.select("case", "source", "signature", "newest_ns", reason.alias("reason"))


def is_case(files: DataFrame) -> DataFrame:
    """(case, is_case) by files (case, path): a case has a system/controlDict, and something in constant or in a folder that is
    a time in plain digits."""
    folder = F.get(F.split("path", "/"), F.lit(0))
    held = (folder == "constant") | folder.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return files.groupBy("case").agg((F.bool_or(F.col("path") == "system/controlDict") & F.bool_or(held & F.contains("path", F.lit("/")))).alias("is_case"))


@F.pandas_udf(T.BooleanType())
def inside(path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a file's real place is below a folder; paths that aren't of a file system with links are."""
    out = []
    for p, r in zip(path, root, strict=True):
        url = urlparse(p)
        real = os.path.realpath(unquote(url.path)) if url.scheme in ("", "file") else None
        out.append(real is None or os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r))
    return pd.Series(out, dtype="boolean")


def case_files(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """(path, modified_ns, size) of the files below a case's folder (or a folder in it), paths relative to that folder; contents
    aren't read. A link out of the case is left out, and it alone."""
    folder = os.path.join(root, below)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    held = files.where(inside("path", F.lit(root)))
    return held.select(F.substring_index("path", f"{folder.rstrip('/')}/", -1).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.col("length").alias("size"))
