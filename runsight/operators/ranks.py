"""Places, neighbours and medians in an order that spans many tasks: no window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.staging import staged, unstage


def placed(dealt: DataFrame, key: str, order: str) -> DataFrame:
    """dealt, in ranges of key and order, with i, the rows in front of each within its key, and n, the rows of the key.

    A range is one task's, in order, so a row's place in it is known as it is written; the rows of a range and key have one
    number in front of them, from a table of a row for each. Nothing is shuffled or ordered again. Values of order must
    differ within a key.
    """
    written = staged(dealt.sortWithinPartitions(key, order).withColumn("written", F.monotonically_increasing_id()), "ranges")
    # the number's upper bits are the task's, the lower 33 count its rows
    ranged = written.withColumn("range", F.shiftright("written", 33))
    sizes = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("size"), F.min("written").alias("first"))
    front = F.sum("size").over(Window.partitionBy(key).orderBy("range")) - F.col("size")
    starts = staged(sizes.select(key, "range", (front - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy(key)).alias("n")), "starts")
    return ranged.join(starts, [key, "range"]).select(*dealt.columns, (F.col("written") + F.col("shift")).alias("i"), "n")


def numbered(rows: DataFrame, key: str, order: str, *, weight: str | None = None, previous: bool = False) -> DataFrame:
    """rows with i, the weight of the rows in front of each within its key by order (from 0; a row weighs 1 without a
    weight), n, the weight of all of the key, and with previous before, the value of order in front; staged.

    Rows are dealt by ranges of key and order and written with the number of their range. Ranges are numbered on their
    own; what is in front of a range comes from a table of a row for each range and key. So a key of any size is the work
    of as many tasks as it has ranges. Values of order must differ within a key.
    """
    if weight is None and not previous:
        return placed(rows.repartitionByRange(key, order), key, order)
    dealt = staged(rows.repartitionByRange(key, order).withColumn("range", F.spark_partition_id()), "ranges")
    w: Column = F.col(weight) if weight else F.lit(1)
    ranges = Window.partitionBy(key).orderBy("range")
    sizes = dealt.groupBy(key, "range").agg(F.sum(w).cast("long").alias("size"), F.max(order).alias("last"))
    starts = sizes.select(key, "range", (F.sum("size").over(ranges) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy(key)).alias("n"), F.lag("last").over(ranges).alias("last"))
    inside = Window.partitionBy(key, "range").orderBy(order)
    out = dealt.join(starts, [key, "range"]).withColumn("i", F.col("start") + F.sum(w).over(inside) - w)
    if previous:
        out = out.withColumn("before", F.coalesce(F.lag(order).over(inside), F.col("last")))
    out = staged(out.select(*rows.columns, F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), *(["before"] if previous else [])), "numbered")
    unstage(dealt)
    return out


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the exact median of value, of an even number the mean of both in the middle. Equal values are counted
    in the map tasks, then the different ones are numbered over many tasks."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    placed = numbered(counted, key, value, weight="c")
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = placed.where((F.col("i") <= upper) & (F.col("i") + F.col("c") > lower))
    return middle.groupBy(key).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
