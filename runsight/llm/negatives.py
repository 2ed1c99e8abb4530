"""Hard-negative mining: candidates in buckets of falling norm, pruned by the bound that Cauchy-Schwarz sets on a score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table, unstage
from .integers import integers, products, usable

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Rows of a bucket; buckets of a chunk and anchors of a block, which a task compares, as powers of two.
BUCKET_BITS, CHUNK_BITS, BLOCK_BITS = 12, 3, 14
#: Anchors whose scores with a bucket are held at a time.
SLICE = 512
#: Scores are whole numbers, norms aren't: a bound counts as this much larger.
SLACK = 1 + 1e-9
#: Below any score.
NONE = -(1 << 62)
LOW, HIGH = NONE + 1, 1 << 62


def first_of(scores: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's open scores and their ids, those of equal scores by id; columns are in order of id."""
    left = np.where(open_, scores, NONE)
    rows, best, who = np.arange(len(left)), np.full((len(left), k), NONE), np.full((len(left), k), -1)
    for i in range(min(k, left.shape[1])):
        at = left.argmax(axis=1)  # of equal scores the first column
        best[:, i] = left[rows, at]
        who[:, i] = np.where(best[:, i] > NONE, ids[at], -1)
        left[rows, at] = NONE
    return best, who


class Running:
    """The k best scores so far of each window of some anchors, and the limit that a bucket has to reach for more."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), NONE, dtype=np.int64)
        self.id = np.full((*low.shape, k), -1, dtype=np.int64)

    def needed(self) -> np.ndarray:
        """The least score that still counts, of each window."""
        return np.maximum(self.low, self.score[:, :, -1])

    def offer(self, at: np.ndarray, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        score, who = np.concatenate([self.score[at, w], scores], axis=1), np.concatenate([self.id[at, w], ids], axis=1)
        order = np.lexsort((who, -score), axis=1)[:, : self.k]
        self.score[at, w], self.id[at, w] = np.take_along_axis(score, order, axis=1), np.take_along_axis(who, order, axis=1)


def search(anchors: dict[str, np.ndarray], buckets: list[dict[str, np.ndarray]], k: int, same_label: bool) -> Running:
    """The k best candidates of each anchor's windows, buckets in order of falling norm.

    A bucket is left out for an anchor if the product of both norms reaches no window's limit: neither its lower end nor
    the score of its k-th candidate so far.
    """
    found = Running(anchors["low"], anchors["high"], k)
    for bucket in buckets:
        reach = anchors["norm"] * bucket["norm"].max() * SLACK
        asking = np.flatnonzero((found.needed() <= reach[:, None]).any(axis=1))
        for at in (asking[i : i + SLICE] for i in range(0, len(asking), SLICE)):
            scores = products(anchors["v"][at], bucket["v"])
            fit = (anchors["label"][at][:, None] == bucket["label"]) == same_label
            fit &= anchors["no"][at][:, None] != bucket["no"]
            needed = found.needed()[at]
            for w in range(found.low.shape[1]):
                open_ = fit & (scores >= needed[:, w, None]) & (scores <= anchors["high"][at, w, None])
                some = np.flatnonzero(open_.any(axis=1))
                if len(some):
                    found.offer(at[some], w, *first_of(scores[some], open_[some], bucket["id"], k))
    return found


FOUND = "anchor long, w int, score long, id long"


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.combine_chunks().flatten()).astype(dtype).reshape(rows, -1)


def search_pass(k: int, same_label: bool):
    """The anchors of a block and the candidates of a chunk to FOUND: at most k rows for each window of an anchor."""

    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        asked, offered = rows.take(pa.array(np.flatnonzero(side == 0))), rows.take(pa.array(np.flatnonzero(side == 1)))
        empty = pa.table({"anchor": pa.array([], pa.int64()), "w": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        if not asked.num_rows or not offered.num_rows:
            return empty

        def arrays(t: pa.Table) -> dict[str, np.ndarray]:
            return {c: np.asarray(t.column(c)) for c in ("no", "id", "label", "norm", "bucket")} | {"v": matrix(t.column("v"), np.int32)}

        anchors = arrays(asked) | {c: matrix(asked.column(c), np.int64) for c in ("low", "high")}
        given = arrays(offered.sort_by([("bucket", "ascending"), ("id", "ascending"), ("no", "ascending")]))
        cuts = np.flatnonzero(np.diff(given["bucket"])) + 1
        parts = {c: np.split(x, cuts) for c, x in given.items()}
        found = search(anchors, [{c: parts[c][i] for c in parts} for i in range(len(cuts) + 1)], k, same_label)
        a, w, i = np.nonzero(found.score > NONE)
        return pa.table({"anchor": pa.array(anchors["no"][a]), "w": pa.array(w.astype(np.int32)), "score": pa.array(found.score[a, w, i]), "id": pa.array(found.id[a, w, i])})

    return run


def in_buckets(rows: DataFrame, part: Column) -> DataFrame:
    """rows with part, and bucket and chunk, which number them by falling norm within a part; staged."""
    sorted_ = rows.withColumn("part", part).orderBy("part", F.desc("norm"), "no").withColumn("at", F.monotonically_increasing_id())
    numbers = {"bucket": F.shiftright("at", BUCKET_BITS), "chunk": F.shiftright("at", BUCKET_BITS + CHUNK_BITS)}
    return staged(sorted_.withColumns(numbers).drop("at"), "buckets")


def in_blocks(anchors: DataFrame) -> DataFrame:
    """anchors with block: those that need norms alike stand together; staged. need is the least norm that a candidate
    must have to reach the lower end of any window."""
    limits = F.array_min("low")
    need = F.when(F.col("norm") > 0, limits / F.col("norm")).otherwise(F.when(limits > 0, float("inf")).otherwise(0.0))
    rows = anchors.withColumn("need", need.cast("double")).orderBy("part", "need", "no")
    return staged(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "blocks")


def met(blocks: DataFrame, candidates: DataFrame, chunks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """FOUND of the blocks' anchors among the chunks of their part (part, chunk, norm) that a block's need lets them reach."""
    blocks_at = blocks.groupBy("part", "block").agg(F.min("need").alias("need"))
    pairs = staged(blocks_at.join(chunks, "part").where(F.col("need") <= F.col("norm") * SLACK).select("part", "block", "chunk"), "pairs")
    columns = ["no", "id", "label", "v", "norm"]
    asked = blocks.join(pairs, ["part", "block"]).select("part", "block", "chunk", F.lit(0).alias("side"), *columns, F.lit(-1).cast("long").alias("bucket"), "low", "high")
    none = F.lit(None).cast("array<long>")
    offered = candidates.join(pairs, ["part", "chunk"]).select("part", "block", "chunk", F.lit(1).alias("side"), *columns, "bucket", none.alias("low"), none.alias("high"))
    found = staged(asked.unionByName(offered).groupBy("part", "block", "chunk").applyInArrow(search_pass(k, same_label), FOUND), "found")
    unstage(pairs)
    return found


def best(found: DataFrame, k: int) -> DataFrame:
    """FOUND with rank from 1: the k best of each window."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(candidates: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """FOUND with rank: the k best candidates (part, chunk, bucket, no, id, label, v, norm) in each window of the anchors
    (part, no, id, label, v, norm, low, high).

    Each anchor meets the chunk of its part with the largest norms first. The k-th score it found there becomes its
    window's lower end, which the other chunks must be able to reach.
    """
    sizes = staged(candidates.groupBy("part", "chunk").agg(F.max("norm").alias("norm")), "sizes")
    tops = sizes.groupBy("part").agg(F.min("chunk").alias("chunk"))
    blocks = in_blocks(anchors)
    first = met(blocks, candidates, sizes.join(tops, ["part", "chunk"]), k, same_label)
    kth = best(first, k).where(F.col("rank") == k).groupBy(F.col("anchor").alias("no")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("of"))
    raised = F.transform("low", lambda low, w: F.greatest(low, F.try_element_at("of", w)))
    known = in_blocks(anchors.join(kth, "no", "left").withColumn("low", raised).drop("of"))
    rest = met(known, candidates, sizes.join(tops, ["part", "chunk"], "left_anti"), k, same_label)
    out = staged(best(first.unionByName(rest), k), "best")
    unstage(sizes, blocks, first, known, rest)
    return out


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the anchors.

    is_anchor: a condition on the columns id_col, vec_col and label_col. A score is the inner product of floor(256 * x)
    of the components, higher ones first, of equal ones that of the smaller id. An anchor's positives are its best other
    rows of the same label; for each of them the best rows of another label whose scores lie between least_percent and
    most_percent of the positive's are its negatives, rank from 1.

    Candidates are sorted by norm and cut into buckets; no score exceeds the product of the norms, so a bucket matters to
    an anchor only if that product reaches the window's lower end and the last score it would displace. Blocks of
    anchors meet chunks of buckets, the largest norms first; positives are sought among a label's own buckets. A task
    holds one block and one chunk, and gives at most a few rows for each window: a label or a group of copies with any
    share of the rows is just more chunks. Where all norms are alike nothing is pruned, and all anchors meet all rows.

    Rows take no part if id, label or vector is null or empty, or a component is null, not finite, or 2**19 or more in
    size, whose products might not fit a long. Rows with another number of components than the anchor aren't compared
    with it. Repeated rows and ids are rows of their own, and an anchor's copy may be its positive. An anchor without
    positives, and a positive without negatives, give no row. ids and labels are whole numbers. Other columns aren't
    read, so their names may clash; an empty table stays empty.
    """
    seen = vectors.select(vectors[id_col].alias(id_col), vectors[vec_col].alias(vec_col), vectors[label_col].alias(label_col))
    good = seen.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vec_col)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(F.col(vec_col)).alias("v"), is_anchor.alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = staged(rows.withColumns({"norm": norm, "dim": F.size("v"), "asks": F.coalesce("asks", F.lit(False)), "no": F.monotonically_increasing_id()}), "vectors")
    by_label, by_length = F.struct("dim", "label"), F.struct("dim", F.lit(0).cast("long").alias("label"))
    asking = rows.where("asks").drop("asks", "dim")
    parts = rows.where("asks").select("no", by_label.alias("part"))

    def windows(low: Column, high: Column) -> list[Column]:
        return [low.alias("low"), high.alias("high")]

    whole = windows(F.array(F.lit(LOW).cast("long")), F.array(F.lit(HIGH).cast("long")))
    labels = in_buckets(rows, by_label)
    near = searched(labels, asking.join(parts, "no").select("*", *whole), positives, True)
    unstage(labels)
    found = near.select("anchor", (F.col("rank") - 1).alias("p"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # the ends of a window, without a product that might not fit: s = 100 a + b
    a = F.expr("positive_score div 100 - CASE WHEN positive_score % 100 < 0 THEN 1 ELSE 0 END")
    b = F.col("positive_score") - a * 100
    low, high = a * least_percent + F.ceil(b * least_percent / 100), a * most_percent + F.floor(b * most_percent / 100)
    found = staged(found.select("*", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high"), "positives")
    unstage(near)
    order = F.sort_array(F.collect_list(F.struct("p", "low", "high")))
    asked = found.groupBy(F.col("anchor").alias("no")).agg(order.alias("windows"))
    pad = F.array_repeat(F.struct(F.lit(0).alias("p"), F.lit(HIGH).cast("long").alias("low"), F.lit(NONE).cast("long").alias("high")), positives)
    asked = asked.withColumn("windows", F.slice(F.concat("windows", pad), 1, positives))  # as many for each; those behind are empty
    lengths = asking.join(rows.where("asks").select("no", by_length.alias("part")), "no").join(asked, "no")
    lengths = lengths.select("*", *windows(F.col("windows.low"), F.col("windows.high"))).drop("windows")
    lengths_in = in_buckets(rows, by_length)
    far = searched(lengths_in, lengths, negatives, False)
    unstage(lengths_in)
    nth = Window.partitionBy("anchor").orderBy("p")
    of_window = found.withColumn("w", F.row_number().over(nth) - 1).drop("low", "high", "p")
    anchors = rows.where("asks").select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id"))
    out = far.join(of_window, ["anchor", "w"]).join(anchors, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """WITH good AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.no AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.no <> b.no AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
near AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT near.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
