"""Embedding near-dedup: spherical k-means cells, cosines in blocks within cells, one representative of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, block_roots
from .common import components, numbered, renamed, staged, table

#: Vectors of a cell, on average; most cells; vectors of the sample for each cell that the centres are fitted on.
CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL = 256, 1 << 14, 32
#: Cells in which a vector is compared: its own, and as a guest those of the next nearest centres.
PROBES = 4
#: Vectors of a block; a task compares two blocks at a time.
BLOCK_ROWS = 512
ROUNDS = 8


def spherical_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of unit vectors by Lloyd rounds; a centre that loses all its vectors stays where it was."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)]
    for _ in range(ROUNDS):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(near, kind="stable")
        present, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], first, axis=0)
        size = np.linalg.norm(total, axis=1)
        centres = centres.copy()
        centres[present[size > 0]] = total[size > 0] / size[size > 0, None]
    return centres


def with_units(vectors: DataFrame, vec_col: str) -> DataFrame:
    """vectors with __unit, the vector at length 1 in double precision, and __node, 16 bytes that stand for its direction.
    Both are null for a vector that is null, zero or holds null or non-finite components.

    Components are divided by the largest before the norm is taken, so it neither overflows nor vanishes.
    """
    rows = vectors.withColumn("__v", F.transform(vectors[vec_col], lambda x: x.cast("double")))
    finite = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("__most", F.when(finite, F.array_max(F.transform("__v", lambda x: F.abs(x)))))
    rows = rows.withColumn("__v", F.when(F.col("__most") > 0, F.transform("__v", lambda x: x / F.col("__most"))))
    rows = rows.withColumn("__norm", F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x)))
    node = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "__v")), 16, "0") for seed in (1, 2)]))
    rows = rows.withColumn("__node", F.when(F.col("__v").isNotNull(), node)).withColumn("__unit", F.transform("__v", lambda x: x / F.col("__norm")))
    return rows.drop("__v", "__most", "__norm")


PLACED = "node binary, copies long, unit array<double>, cell long, home long, cells array<long>"


def cell_pass(models, probes: int):
    """(node, copies, unit, dim) to a row for each cell in which the vector is compared; cells has them all, its home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                centres = models.value.get(int(dim))
                if centres is None or len(centres) == 1:
                    cells = np.zeros((part.num_rows, 1), dtype=np.int64)
                else:
                    unit = np.asarray(part.column(2).flatten()).reshape(part.num_rows, dim)
                    near = unit @ centres.T
                    cells = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, len(centres))]
                cells = cells + (int(dim) << 32)  # vectors of different length share no cell
                m = cells.shape[1]
                at = pa.array(np.repeat(np.arange(part.num_rows), m))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * m), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(cells.ravel()), pa.array(np.repeat(cells[:, 0], m)), lists.take(at)], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


FOUND = "node binary, links long, root binary"


def own_pairs(cell: int, a: pa.Table, b: pa.Table) -> np.ndarray:
    """Which pairs are this cell's: of the homes that both are compared in, the smaller one's."""
    cells = [np.asarray(t.column("cells").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (a, b)]
    home = [np.asarray(t.column("home")) for t in (a, b)]
    in_b = (home[0][:, None, None] == cells[1][None]).any(axis=2)
    in_a = (home[1][None, :, None] == cells[0][:, None]).any(axis=2)
    ha, hb = home[0][:, None], home[1][None]
    return np.where(in_a & in_b, np.minimum(ha, hb), np.where(in_b, ha, hb)) == cell


def compare_blocks(cosine: float):
    """Two blocks of a cell to a row for each vector with links: how many, and the least vector they lead to here."""

    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = np.array_equal(second, []) and bool(rows.column("same")[0].as_py())
        a = rows.take(pa.array(first))
        b = a if one else rows.take(pa.array(second))
        empty = pa.Table.from_pylist([], schema=pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())]))
        if not a.num_rows or not b.num_rows:
            return empty
        dim = len(rows.column("unit")[0])
        x, y = (np.asarray(t.column("unit").combine_chunks().flatten()).reshape(t.num_rows, dim) for t in (a, b))
        near = x @ y.T >= cosine
        if one:
            np.fill_diagonal(near, False)
        if not near.any():
            return empty
        left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        a, b, near = a.take(pa.array(left)), b.take(pa.array(right)), near[np.ix_(left, right)]
        near &= own_pairs(rows.column("cell")[0].as_py(), a, b)
        links = [near @ np.asarray(b.column("copies")), near.T @ np.asarray(a.column("copies"))]
        nodes = a.column("node").to_pylist() + ([] if one else b.column("node").to_pylist())
        roots = block_roots(nodes, near, one)
        count = links[0] if one else np.concatenate(links)
        keep = np.flatnonzero(count)
        return pa.table({"node": pa.array([nodes[i] for i in keep], pa.binary()), "links": pa.array(count[keep]), "root": pa.array([roots[i] for i in keep], pa.binary())})

    return run


def fitted(units: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each length of which there are vectors for more than one cell, each on a bounded sample. A table of
    vectors has one length, or a few."""
    models = {}
    for dim, n in units.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * CELL_ROWS).orderBy("dim").collect():
        cells = min(MOST_CELLS, n // CELL_ROWS)
        if cells > 1:
            share = min(1.0, SAMPLE_PER_CELL * cells / n)
            drawn = units.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 20)) < int(share * (1 << 20))))
            sample = drawn.select("node", F.transform("unit", lambda x: x.cast("float")).alias("unit")).toArrow().sort_by("node")
            points = np.asarray(sample.column("unit").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
            if len(points) >= cells:
                models[dim] = spherical_centres(points / np.linalg.norm(points, axis=1, keepdims=True), cells)
    return models


def with_groups(vectors: DataFrame, *, cosine: float = 0.95, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vectors with n_links, component_id and kept behind its columns.

    n_links: the other vectors found with a cosine of at least cosine. component_id: the smallest id reachable by
    links, its own included. kept: whether the vector is that representative.

    Vectors of one direction are folded first. Spherical k-means centres, fitted on a bounded sample, make cells; a
    vector is compared in its own and, as a guest, in the next nearest. Cells of any size are cut into blocks, and two
    blocks at a time are multiplied; a block gives counts and one link a vector, never its pairs. A pair is found if one
    is compared in the other's own cell; with a single cell, that is below 512 vectors, all pairs are found.

    Vectors that are null, zero or hold null or non-finite components link with nothing; nor do those of different
    length. Null ids don't count for the smallest. Repeated rows and ids are vectors of their own. Columns with the
    new names are replaced; an empty table stays empty.
    """
    named, old = numbered(vectors, ("n_links", "component_id", "kept"))
    known_as = named.select("*", F.col(f"c{old.index(id_col)}").alias("__id"), F.col(f"c{old.index(vec_col)}").alias("__vec"))
    rows = with_units(known_as, "__vec")
    units = rows.select(F.col("__node").alias("node"), F.col("__unit").alias("unit"), F.col("__id").alias("id")).where("node is not null")
    units = staged(units.groupBy("node").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("id")).withColumn("dim", F.size("unit")), "units")
    models = vectors.sparkSession.sparkContext.broadcast(fitted(units))
    placed = staged(units.select("node", "copies", "unit", "dim").mapInArrow(cell_pass(models, probes), PLACED), "placed")
    found = staged(block_pairs(placed, BLOCK_ROWS).groupBy("cell", "i", "j", "against_guests").applyInArrow(compare_blocks(cosine), FOUND), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = units.select("node", "copies", "id").join(counts, "node", "left").join(roots, "node", "left")
    known = staged(known.select("node", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "node").alias("top")), "known")
    tops = staged(known.groupBy("top").agg(F.min("id").alias("component_id")), "tops")
    results = known.join(tops, "top").select(F.col("node").alias("__node"), F.col("n_links").alias("__n"), F.col("component_id").alias("__component"))
    component = F.when(F.col("__node").isNull(), F.col("__id")).otherwise(F.col("__component"))
    out = rows.join(results, "__node", "left").withColumn("component_id", component)
    return renamed(out, old, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return with_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
