"""Mesh layers: which request holds for a patch, and whether it was met."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BooleanType())
def whole_match(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """Whether the pattern matches the whole text; an invalid one matches nothing."""
    out = []
    for p, t in zip(pattern, text, strict=True):
        try:
            out.append(re.fullmatch(p, t) is not None)
        except re.error:
            out.append(False)
    return pd.Series(out, dtype="boolean")


def match_layers(rows: DataFrame, requests: list[tuple[str, int]]) -> DataFrame:
    """rows (patch, ...) with selector and requested_layers: the request of the patch's own name, else the first in order
    whose pattern matches all of it, else null. requests: (selector, layers), as in the settings file."""
    none = F.array().cast("array<struct<pos:int,selector:string,requested_layers:int>>")
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("selector"), F.lit(n).alias("requested_layers")) for i, (s, n) in enumerate(requests)]) if requests else none
    pairs = rows.select("patch").distinct().select("patch", F.inline(entries))
    hits = pairs.withColumn("exact", F.col("selector") == F.col("patch")).where(F.col("exact") | whole_match("selector", "patch"))
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("patch").orderBy(F.desc("exact"), "pos"))).where("rank = 1")
    return rows.join(first.select("patch", "selector", "requested_layers"), "patch", "left")


def layer_status(average: Column, requested: Column) -> Column:
    return (
        F.when(requested.isNull(), "unknown").when(requested == 0, "not_requested").when(F.coalesce(average, F.lit(0.0)) <= 0, "missing")
        .when(average + 1e-9 < requested, "partial").otherwise("met")
    )


def layer_coverage(rows: DataFrame, requests: list[tuple[str, int]], cases: DataFrame) -> DataFrame:
    """(path, rows, missing, partial, unmatched, status) for each of cases (path, add_layers), over rows (path, patch,
    average_layers) as layer_table gives them.

    Without rows a case is not_configured where layers are switched off, else unavailable. A missing layer weighs more than
    a partial one, that more than requests for layers that no patch has taken: unmatched, by name in the file's order. A
    patch without a request is unknown, and so is then the case.
    """
    of = match_layers(rows, requests).withColumn("status", layer_status(F.col("average_layers"), F.col("requested_layers")))
    counted = of.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(~F.col("status").isin("met", "not_requested")).alias("open"), F.collect_set("selector").alias("taken"),
    )
    out = cases.join(counted, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "missing", "partial", "open")})
    wanted = F.array(*[F.lit(s) for s, n in requests if n > 0]).cast("array<string>")
    taken = F.coalesce("taken", F.array().cast("array<string>"))
    out = out.withColumn("unmatched", F.filter(wanted, lambda s: ~F.array_contains(taken, s)))
    status = (
        F.when((F.col("rows") == 0) & ~F.coalesce("add_layers", F.lit(True)), "not_configured").when(F.col("rows") == 0, "unavailable").when(F.col("missing") > 0, "missing")
        .when(F.col("partial") > 0, "partial").when((F.size("unmatched") > 0) | (F.col("open") > 0), "unknown").otherwise("met")
    )
    return out.select("path", "rows", "missing", "partial", "unmatched", status.alias("status"))
