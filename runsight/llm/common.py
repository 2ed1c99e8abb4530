"""What the operators of this subpackage share: tables, text identity, staged tables, batches of texts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
BLOCK_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _own_dirs[app]


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, new: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs without the columns named in new, the others as c0, c1, ..., which no operator uses otherwise; and their names."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = [i for i, c in enumerate(docs.columns) if c not in new]
    return named.select(*[F.col(f"c{i}").alias(f"c{n}") for n, i in enumerate(kept)]), [docs.columns[i] for i in kept]


def renamed(df: DataFrame, names: list[str], *more: Column | str) -> DataFrame:
    """The columns c0, c1, ... of df under their names again, and more behind them."""
    out = df.select(*[F.col(f"c{i}") for i in range(len(names))], *more)
    return out.toDF(*names, *out.columns[len(names) :])


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: equal texts share them, different ones don't (half of SHA-256); null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no, key, text, copies, first_id) for each different text, staged; null is the empty text.

    no numbers the texts in order of their least id (null ids last), those of one id in order of their key. Copies are
    folded in the map tasks, so a text with any number of them is one row from each task.
    """
    rows = docs.select(text_key(docs[text_col]).alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].alias("id"))
    heads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    heads = staged(heads.orderBy(F.col("first_id").asc_nulls_last(), "key").withColumn("no", F.monotonically_increasing_id()), "heads")
    texts = staged(rows.groupBy("key").agg(F.first("text").alias("text")).join(heads, "key").select("no", "key", "text", "copies", "first_id"), "texts")
    unstage(heads)
    return texts


def blocks(batches: Iterator[pa.RecordBatch], size_of: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column size_of (text or binary) has about limit bytes in each; a larger row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        lengths = np.array(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        group = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def hash_group(seed: int, n: int, *columns: Column) -> Column:
    """A number below n, drawn from the columns' values and the seed: the same on every run and retry."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(n))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in links (a, b): nodes that links connect, over however many steps, share a root.

    Every round each node takes the least of its neighbours and itself in a random order as its parent, and links are
    drawn anew between parents; those inside one parent go. The rounds, about the logarithm of the nodes, cut the
    lineage with staged tables; nothing but whether links are left reaches the driver.
    """

    def rank(name: str) -> Column:
        return F.struct(F.xxhash64(name).alias("r"), F.col(name).alias("n"))

    left = staged(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("least")).select("node", F.least(rank("node"), "least")["n"].alias("root"))
        if roots is not None and left.isEmpty():
            unstage(left)
            return roots
        parents = staged(parents, "parents")
        of = {c: parents.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"}
        before, left = left, staged(left.join(of["a"], "a").join(of["b"], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct(), "links")
        unstage(before)
        if roots is None:
            roots = parents
        else:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            before, roots = roots, staged(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            unstage(before, parents)
