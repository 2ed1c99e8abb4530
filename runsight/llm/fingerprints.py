"""Document fingerprints: the least hashes of a text's Lempel-Ziv phrases, compared as sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, renamed, table
from .rolling import mix, powers, sums

#: Hashes in a fingerprint. The likeness of two larger sets has a standard error of about 0.04.
LEAST = 128


def parse(text: str, seen: set[str], start: int, at: int) -> tuple[list[int], int]:
    """Goes on parsing from place at, in a phrase that began at start: the ends of the new phrases, and the start of the open one.

    A phrase is the shortest stretch that isn't in the dictionary yet (LZ78); it goes into it.
    """
    ends, put = [], seen.add
    for end in range(at + 1, len(text) + 1):
        phrase = text[start:end]
        if phrase not in seen:
            put(phrase)
            ends.append(end)
            start = end
    return ends, start


def signatures(texts: list[str], ends: list[list[int]]) -> list[np.ndarray]:
    """For each text its LEAST smallest phrase hashes, ascending. Phrases end at ends, each where the next begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    running = sums(mix(codes + np.uint64(1)), 0)
    base = np.cumsum([0] + [len(t) for t in texts])
    counts = [len(e) for e in ends]
    stop = np.concatenate([np.asarray(e, dtype=np.int64) + b for e, b in zip(ends, base, strict=False)]) if ends else np.zeros(0, dtype=np.int64)
    first = np.cumsum([0, *counts])
    begin = np.empty_like(stop)
    begin[1:] = stop[:-1]
    begin[first[:-1][np.asarray(counts, dtype=np.int64) > 0]] = base[:-1][np.asarray(counts, dtype=np.int64) > 0]
    down = powers(0, len(codes) + 1)[1]
    hashes = (mix((running[stop] - running[begin]) * down[begin] + (stop - begin).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return [np.unique(hashes[a:b])[:LEAST] for a, b in zip(first[:-1], first[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two phrase sets from their signatures: of the LEAST smallest of both, the share in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    keep = np.ones(len(both), dtype=bool)
    keep[1:] = ~twice
    rank = np.cumsum(keep)
    return float(np.count_nonzero(twice & (rank[1:] <= LEAST)) / min(LEAST, int(rank[-1])))


def as_string(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the column fingerprint behind its own: a hexadecimal string, for likeness() of from_string().

    Each whole text is parsed into LZ78 phrases, the phrase set is hashed and its least hashes are kept, in one pass
    without a shuffle. Equal texts have equal fingerprints; a null or empty text has the empty one. Repeated rows stay,
    a column named fingerprint is replaced, an empty table stays empty.
    """
    docs, old = numbered(docs, ("fingerprint",))
    kept = docs.columns
    source = docs.select(*kept, F.coalesce(F.col(f"c{old.index(text_col)}").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            texts = batch.column(len(kept)).to_pylist()
            found = signatures(texts, [parse(t, set(), 0, 0)[0] for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(map(as_string, found), pa.string())], names=[*kept, "fingerprint"])

    return renamed(source.mapInArrow(run, source.drop("__text").schema.add("fingerprint", "string")), old, "fingerprint")


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, guest, id, text) in order within partitions: each bucket's rows by id, and behind them, as guests, the
    rows of the next bucket's first id (of the first bucket's behind the last).

    Bounds are buckets - 1 approximate quantiles of the ids, taken in a pass over the ids alone; only they and the
    least id reach the driver.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    least, bounds = rows.agg(F.min("id"), F.percentile_approx("id", shares, 20 * buckets)).first()
    bounds = sorted({b for b in bounds or [] if b > least}) if buckets > 1 else []
    places = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    own = F.when(F.col("id").isNull(), len(bounds)).otherwise(F.size(F.filter(places, lambda b: b <= F.col("id"))))
    guest = F.when(F.array_contains(places, F.col("id")), own - 1).when(F.col("id") == F.lit(least), F.lit(len(bounds)))
    at = F.explode(F.filter(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.struct(guest.alias("bucket"), F.lit(True).alias("guest"))), lambda x: x["bucket"].isNotNull()))
    dealt = rows.select("id", "text", at.alias("at")).select(F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"), "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions(F.asc("bucket"), F.asc("guest"), F.asc_nulls_last("id"), F.asc("text"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows of (id, text, next text), each with the results of the edit."""
    whole, edited, texts, following = [], [], [], []
    for _, text, after in rows:
        n = len(text)
        cut = n - n // 4
        new = text[:cut] + after[: n // 4]
        seen: set[str] = set()
        ends, start = parse(text[:cut], seen, 0, 0)
        # both texts begin alike, so the dictionary up to there is built once
        edited.append(ends + parse(new, set(seen), start, cut)[0])
        whole.append(ends + parse(text, seen, start, cut)[0])
        texts.append(new)
    own = signatures([t for _, t, _ in rows], whole)
    other = signatures(texts, edited)
    # the next document is mostly the next row
    alone = [i for i in range(len(rows)) if i + 1 == len(rows) or rows[i + 1][1] is not rows[i][2]]
    extra = signatures([rows[i][2] for i in alone], [parse(rows[i][2], set(), 0, 0)[0] for i in alone])
    behind = dict(zip(alone, extra, strict=True))
    following = [behind.get(i, own[i + 1] if i + 1 < len(rows) else None) for i in range(len(rows))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array(map(as_string, own), pa.string()),
            pa.array(map(as_string, other), pa.string()),
            pa.array(map(likeness, own, other), pa.float64()),
            pa.array(map(likeness, own, following), pa.float64()),
        ],
        names=[c.split()[0] for c in EDITED.split(", ")],
    )


def edit_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of with_next() to those of EDITED."""
    done: list[tuple] = []
    bucket = first = waiting = None
    for batch in blocks(batches, "text"):
        for at, guest, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at != bucket:
                if waiting:  # no guest came: its bucket is the only one
                    done.append((*waiting, first))
                bucket, first, waiting = at, text, None
            if waiting:
                done.append((*waiting, text))
            waiting = None if guest else (id_, text)
        if done:
            yield edited_rows(done)
            done = []
    if waiting:
        done.append((*waiting, first))
    if done:
        yield edited_rows(done)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """A row of EDITED for each document: its fingerprint against that of its edited text and of the next document.

    The edited text ends, instead of in its last n_chars // 4 characters, in the first as many of the next document's.
    Next goes by ascending id (equal ids by text, null ids last), behind the last comes the first; a lone document is
    its own next. Texts are shuffled once, to buckets of neighbouring ids; a third of all rows may not share one id.
    Null is the empty text; two empty texts are alike (1), an empty one and another are not (0). Ids are whole numbers;
    others stop the job.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, id_col, text_col, buckets).mapInArrow(edit_pass, EDITED)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
