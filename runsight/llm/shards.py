"""Sharding by a two-pass external shuffle: records scattered into buckets that fit memory, each bucket shuffled and written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, renamed, staged, table, text_key

SHARDS, SEED = 16, 20
#: Bytes of text in a bucket, on average; a task holds one bucket.
BUCKET_BYTES = 16 << 20
#: Fewest buckets, so that a small table is the work of several tasks too.
FEWEST_BUCKETS = 64
#: Buckets whose numbers of rows are added up together; most buckets whose starts are broadcast, 16 bytes each.
RUN, MOST_BROADCAST = 4096, 1 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places: from the last place down, each is swapped with one drawn from those up to it."""
    draw = np.random.default_rng([seed, bucket])
    order = list(range(n))
    partners = draw.integers(0, np.arange(n, 0, -1), endpoint=False).tolist()
    for i, j in zip(range(n - 1, 0, -1), partners, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_pass(seed: int):
    """A partition, which is one bucket in order of its draws, to the same rows in drawn order with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        bucket = rows.column("bucket")[0].as_py()
        order = fisher_yates(rows.num_rows, seed, bucket)
        fields = [f for f in rows.schema if f.name != "draw"] + [pa.field("place", pa.int64())]
        step = max(1, rows.num_rows * BUCKET_BYTES // max(1, 4 * rows.nbytes))  # a quarter of a bucket at a time
        for at in range(0, rows.num_rows, step):
            part = rows.take(pa.array(order[at : at + step])).combine_chunks()
            place = pa.array(np.arange(at, at + part.num_rows))
            columns = [part.column(f.name) for f in fields[:-1]] + [place]
            yield from pa.Table.from_arrays(columns, schema=pa.schema(fields)).to_batches()

    return run


def bucket_starts(written: DataFrame) -> DataFrame:
    """(bucket, start): the rows in all buckets before it. Runs of RUN buckets are added up first, then each by itself;
    what one task or the driver holds is a number for each run or each bucket of a run."""
    sizes = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = {r.run: r.n for r in sizes.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for run in sorted(runs):
        before.append((run, total))
        total += runs[run]
    starts = written.sparkSession.createDataFrame(before, "run long, before long")
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    return sizes.join(starts, "run").select("bucket", (F.col("before") + inside).alias("start"))


def shuffled(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard and slot behind its columns, in an order drawn from seed over all rows; written in the shared folder.

    First pass: each row draws a number from a seeded hash of its id, its text and, for repeated rows, its place, and
    goes to the bucket of that number; there are as many buckets as the bytes of the texts fill. Second pass: a bucket,
    one task's, is put in order of its draws, shuffled by Fisher-Yates and written. Buckets behind one another are the
    shuffled table, cut into shards whose numbers of rows are at most one apart; slot counts from 0 in a shard.

    No column decides where rows go together: a source, an id or a text with any share of the rows is spread like
    others. Buckets hold bucket_bytes on average; a larger text makes a larger bucket. docs must be read from files (or
    staged), so that a task run again finds its rows in the same order. Then a retry gives the same rows the same place.

    Null ids and texts are values like others; an empty table stays empty. Columns named shard or slot are replaced.
    """
    named, old = numbered(docs, ("shard", "slot"))
    text = F.coalesce(F.col(f"c{old.index(text_col)}").cast("string"), F.lit(""))
    total = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()
    buckets = max(FEWEST_BUCKETS, -(-(total.bytes or 0) // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), F.col(f"c{old.index(id_col)}").cast("string"), text_key(text), F.monotonically_increasing_id())
    drawn = named.withColumn("draw", draw).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(buckets)).cast("int"))
    scattered = drawn.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("draw")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in named.schema]
    written = staged(scattered.mapInArrow(shuffle_pass(seed), ", ".join([*kept, "bucket int", "place long"])), "shuffled")
    at = F.col("start") + F.col("place")
    few, more = divmod(total.n, shards)
    front = F.lit(more * (few + 1))
    shard = F.when(at < front, F.floor(at / (few + 1))).otherwise(more + F.floor((at - front) / max(few, 1)))
    slot = F.when(at < front, at % (few + 1)).otherwise((at - front) % max(few, 1))
    starts = bucket_starts(written)
    out = written.join(F.broadcast(starts) if buckets <= MOST_BROADCAST else starts, "bucket")
    return renamed(out, old, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The shards as Parquet below path, a folder shard=N for each; a file's rows are in order of slot.

    Files hold runs of slots: rows are dealt by shard and a range of slots, so a shard is written by several tasks.
    """
    rows = shuffled(docs, **how)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    rows = shuffled(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
