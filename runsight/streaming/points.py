"""Series from table files that come in any order, again or late: the batch merge of restarts, kept up as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from runsight.operators.series import restart_upsert


def stream_upsert(rows: DataFrame) -> DataFrame:
    """restart_upsert over a stream of (series_id, start, path, row_no, t, v), in update mode: a sample each time a later
    start, or a later row of one file, changes it. An aggregation by (series_id, t) without watermark, for a restart may
    write over any time; its state, in RocksDB, is one winner for each sample. A file that comes again changes nothing."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return restart_upsert(rows)


def keep_points(rows: DataFrame, path: str, **options: str) -> StreamingQuery:
    """Starts a query that writes the changed samples of every batch below path, a folder each: a batch that runs again
    writes its folder again. options: of the stream's writer, checkpointLocation above all."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if options.pop("once", None) else {"processingTime": options.pop("every", "2 seconds")}
    return stream_upsert(rows).writeStream.outputMode("update").foreachBatch(write).options(**options).trigger(**trigger).start()


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, t, v) as of now: of each sample what the last batch wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy("series_id", "t").agg(F.max_by("v", "batch").alias("v"))
