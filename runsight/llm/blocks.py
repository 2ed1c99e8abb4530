"""All pairs within cells of any size, two blocks of rows at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def block_pairs(placed: DataFrame, block_rows: int) -> DataFrame:
    """placed (node, cell, home, ...) with i, j, against_guests, side and same: a row for each pair of blocks of a cell that
    a row is in. Blocks, drawn by hash, have about block_rows rows; rows whose home is another cell are guests. Home
    blocks meet each other and the guests' blocks; guests don't meet.
    """
    is_guest = F.col("cell") != F.col("home")
    sizes = placed.groupBy("cell").agg(F.count_if(~is_guest).alias("own"), F.count_if(is_guest).alias("guests"))
    blocks = {c: F.ceil(F.col(c) / block_rows).cast("int") for c in ("own", "guests")}
    sized = placed.join(staged(sizes.select("cell", *[n.alias(c) for c, n in blocks.items()]).where("own > 0"), "sizes"), "cell")
    block = F.pmod(F.xxhash64(F.lit(3), "node"), F.when(is_guest, F.col("guests")).otherwise(F.col("own"))).cast("int")
    sized = sized.withColumn("block", block)

    def entry(i, j, side, guests):
        return F.struct(i.alias("i"), j.alias("j"), side.alias("side"), F.lit(guests).alias("against_guests"))

    at, zero, one = F.col("block"), F.lit(0), F.lit(1)
    others = F.transform(F.sequence(zero, F.col("own") - 1), lambda j: entry(F.least(at, j), F.greatest(at, j), F.when(at <= j, zero).otherwise(one), False))
    guests = F.when(F.col("guests") > 0, F.transform(F.sequence(zero, F.greatest(F.col("guests") - 1, zero)), lambda j: entry(at, j, zero, True))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int,against_guests:boolean>>"))
    hosts = F.transform(F.sequence(zero, F.col("own") - 1), lambda i: entry(i, at, one, True))
    dealt = sized.withColumn("pair", F.explode(F.when(is_guest, hosts).otherwise(F.concat(others, guests))))
    same = (F.col("pair.i") == F.col("pair.j")) & ~F.col("pair.against_guests")
    return dealt.select(*placed.columns, "pair.i", "pair.j", "pair.against_guests", "pair.side", same.alias("same"))


def hosts_and_guests(hosts: DataFrame, guests: DataFrame, block_rows: int) -> DataFrame:
    """hosts and guests (sid, cell, ...; alike) with i, j and side: a row for each pair of a block of guests (side 0) and one
    of hosts (1) of a cell that a row is in. Cells without guests are left out."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    sizes = staged(counted(hosts, "own").join(counted(guests, "others"), "cell"), "sizes")

    def dealt(rows: DataFrame, mine: str, theirs: str, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(3), "sid"), F.col(mine)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        return rows.join(sizes, "cell").select(*rows.columns, block.alias("i" if side else "j"), met.alias("j" if side else "i"), F.lit(side).alias("side"))

    return dealt(hosts, "own", "others", 1).unionByName(dealt(guests, "others", "own", 0))


def block_roots(nodes: list[bytes] | np.ndarray, near: np.ndarray, one: bool) -> list[bytes] | np.ndarray:
    """For each node the least one that links lead to. nodes: those of near's rows, and unless both are one block, of its columns."""
    some = np.asarray([n.hex() for n in nodes]) if isinstance(nodes, list) else nodes
    _, at, label = np.unique(some, return_index=True, return_inverse=True)
    rows, columns = near.shape
    a, b = label[:rows], label if one else label[rows:]
    far = len(nodes)
    while True:
        new_a = np.minimum(a, np.where(near, b[None], far).min(axis=1)) if columns else a
        new_b = np.minimum(b, np.where(near, new_a[:, None], far).min(axis=0)) if rows else b
        if one:
            new_a = new_b = np.minimum(new_a, new_b)
        if np.array_equal(new_a, a) and np.array_equal(new_b, b):
            break
        a, b = new_a, new_b
    found = at[a if one else np.concatenate([a, b])]
    return [nodes[i] for i in found] if isinstance(nodes, list) else nodes[found]
