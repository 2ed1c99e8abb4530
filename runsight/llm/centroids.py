"""Centroid clustering: plain Lloyd rounds in whole numbers, the same on any number of machines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .integers import integers, usable

CLUSTERS, ROUNDS, DIMENSIONS = 40, 5, 64
#: Rows whose differences from a centroid are held at a time.
BLOCK_ROWS = 4096


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row: the centroid with the smallest squared distance, of equal ones the first."""
    distances = np.empty((len(centroids), len(block)), dtype=np.int64)
    for number, centroid in enumerate(centroids):
        apart = block - centroid
        distances[number] = np.einsum("ij,ij->i", apart, apart)
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(block))]


def row_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """At most BLOCK_ROWS rows at a time, and their column v as a matrix."""
    for frame in frames:
        for at in range(0, len(frame), BLOCK_ROWS):
            part = frame.iloc[at : at + BLOCK_ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def sum_pass(centroids, clusters: int, dimensions: int):
    """Vectors to (cluster, n, sums): a row for each cluster that the partition has vectors of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((clusters, dimensions), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for _, block in row_blocks(frames):
            cluster, _ = nearest(block, centroids.value)
            order = np.argsort(cluster, kind="stable")
            present, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            sums[present] += np.add.reduceat(block[order], first, axis=0)
            counts[present] += n
        there = np.flatnonzero(counts)
        if len(there):
            yield pd.DataFrame({"cluster": there.astype(np.int32), "n": counts[there], "sums": list(sums[there])})

    return run


def label_pass(centroids):
    """(id, v) to (id, cluster, distance)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, block in row_blocks(frames):
            cluster, distance = nearest(block, centroids.value)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "cluster": cluster.astype(np.int32), "distance": distance})

    return run


def first_centroids(rows: DataFrame, clusters: int, prefix: str) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order: clusters rows at most reach the driver."""
    mark = F.sha2(F.concat(F.lit(prefix), F.coalesce("id", F.lit(""))), 256)
    drawn = rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()
    return np.array([r.v for r in drawn], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each becomes the floor of its vectors' mean, one without vectors stays.

    A partition sends one row for each of its clusters; a row for each cluster reaches the driver.
    """
    clusters, dimensions = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    parts = rows.select("v").mapInPandas(sum_pass(shared, clusters, dimensions), "cluster int, n long, sums array<long>")
    exact: list[Column] = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dimensions)]
    shared.destroy()
    return out


def clustered(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, prefix: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is clustered.

    Components x become floor(256 * x). The first centroids are the vectors whose ids, behind prefix, have the smallest
    SHA-256. Each round assigns all vectors to the nearest centroid by squared distance (of equal ones the smallest
    number) and moves each centroid to the floor of its vectors' mean; one without vectors stays. A last assignment
    gives cluster and distance. cluster_inertia and inertia sum the distances of the cluster and of all, null if they
    don't fit a long; centroid_sha256 is of the final centroid's components joined by commas.

    Centroids go to the tasks (clusters x dimensions numbers), and one row of sums for each cluster comes back from each
    partition, so no key is hot and nothing else is shuffled. Sums are of whole numbers: any partitioning and any retry
    gives the same. Rounds read the vectors anew; only ids, clusters and distances are written.

    Left out are vectors that are null, have another number of components than dimensions, or hold one that is null, not
    finite, or 2**19 or more in size, whose squares might not fit a long. Repeated rows and ids are vectors of their own;
    a null id counts as an empty one for its hash. With fewer vectors than clusters each is a first centroid; equal
    vectors then leave all but the first of their centroids empty. An empty table stays empty. Other columns of vectors
    aren't read, so their names may clash.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType
    seen = vectors.select(vectors[id_col].cast("string").alias("id"), vectors[vec_col].alias("v"))
    rows = seen.where((F.size("v") == dimensions) & usable(F.col("v"))).select("id", integers(F.col("v")).alias("v"))
    centroids = first_centroids(rows, clusters, prefix)
    if not len(centroids):
        return spark.createDataFrame([], "id string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    labelled = staged(rows.mapInPandas(label_pass(shared), "id string, cluster int, distance long"), "clustered")
    shared.destroy()
    sums = {r.cluster: int(r.s) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = [(c, fits(s), fits(sum(sums.values())), marks[c]) for c, s in sums.items()]
    of_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = labelled.join(F.broadcast(of_cluster), "cluster")  # a row for each cluster
    return out.select(F.col("id").cast(id_type).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """The same in SQL: a pair of tables for each round."""
    steps = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "flat AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM kept, range(1, 65) r(i))",
        "first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM kept QUALIFY cluster < 40)",
        "c0 AS MATERIALIZED (SELECT cluster, i, v[i] AS c FROM first, range(1, 65) r(i))"]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, cluster := cluster)) AS best FROM
  (SELECT rid, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM flat JOIN c{n} USING (i) GROUP BY rid, cluster) GROUP BY rid)""")
        if n < ROUNDS:
            steps.append(f"""m{n} AS (SELECT best.cluster AS cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM flat JOIN a{n} USING (rid) GROUP BY ALL)""")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster, i))")
    steps.append(f"marks AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(best.cluster AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{ROUNDS} USING (rid) JOIN marks ON marks.cluster = best.cluster"""


OP13_SQL = _sql()
