"""Substring dedup by level-wise doubling: windows repeated at one length alone are tried at twice that length."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct_texts, numbered, renamed, staged, table, text_key, unstage
from .rolling import anchored, byte_values, covered, words_of

LEVEL = "h long, g long, no long, lo int, hi int"

#: A unit gives, for texts as bytes, one value for each word or byte of all of them and where each text's begin.
Unit = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def byte_unit(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return byte_values()[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.cumsum([0] + [len(t) for t in texts])


def levels(window: int, least: int) -> list[int]:
    """The lengths tried, each about twice the one before; the first is least or more, the last the window."""
    out = [window]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


def ranges_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of a column of lists of (lo, hi)."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), np.asarray(flat.field(0), dtype=np.int64), np.asarray(flat.field(1), dtype=np.int64)


def living(begin: np.ndarray, window: int, spans: pa.Array | None) -> np.ndarray:
    """Which starts of windows are left: those in the spans, or all that fit in their text."""
    n = int(begin[-1])
    if spans is None:
        sizes = np.diff(begin)
        fit = sizes >= window
        return covered(n, begin[:-1][fit], begin[1:][fit] - window)
    row, lo, hi = ranges_of(spans)
    return covered(n, begin[row] + lo, begin[row] + hi)


def level_pass(unit: Unit, window: int, k: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(no, text[, spans]) to a row for each anchor of length k of the windows that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            values, begin = unit(texts)
            alive = living(begin, window, None if first else batch.column(2))
            h, lo, hi, *g = anchored(values, alive, window, k, second=k == window)
            row = np.searchsorted(begin, lo, side="right") - 1
            lo, hi = (lo - begin[row]).astype(np.int32), (hi - begin[row]).astype(np.int32)
            g = g[0] if g else np.zeros(len(h), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), batch.column(0).take(pa.array(row)), pa.array(lo), pa.array(hi)], names=["h", "g", "no", "lo", "hi"])

    return run


def repeated_windows(texts: DataFrame, unit: Unit, window: int, lengths: list[int], copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(no, spans), and the same with text: the windows (starts lo to hi) of texts (no, text; numbers differ) whose anchors of
    all the lengths are repeated; with the window itself as the last length, exactly the repeated windows. Both are staged,
    but with the window as the last length the second is what that was tried on.

    copies: (no, text) of texts that several documents have, so that all their windows count as repeated.

    At each length the anchors of the windows left are counted, combined in the map tasks: a passage in many documents
    is one row from each. Those that repeat go back to the texts; texts without any are left behind before the next
    length. All joins go by the anchor or the text's number, at every size.
    """
    source, spans = texts.select("no", "text"), None
    for k in lengths:
        rows = source.mapInArrow(level_pass(unit, window, k, spans is None), LEVEL)
        on = ["h", "g"] if k == window else ["h"]
        counted = rows.select(*on, F.lit(1).alias("times"))
        if copies is not None:
            counted = counted.unionByName(copies.select("no", "text").mapInArrow(level_pass(unit, window, k, True), LEVEL).select(*on, F.lit(2).alias("times")))
        often = staged(counted.groupBy(*on).agg(F.sum("times").alias("times")).where("times > 1").select(*on), "often")
        again = rows.select(*on, "no", "lo", "hi").join(often, on)
        before, spans = spans, staged(again.groupBy("no").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
        unstage(often)
        if before is not None:
            unstage(before)
        if k != window:
            tried, source = source, staged(source.select("no", "text").join(spans, "no"), "alive")
            if before is not None:
                unstage(tried)
    return spans, source


def keep_rest(window: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kept columns, text, whole, spans) to the kept columns, n_words, n_removed and the words left once those in repeated
    windows are gone; whole: all windows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            texts, whole = (batch.column(kept + i).to_pylist() for i in range(2))
            row, lo, hi = ranges_of(batch.column(kept + 2))
            at = np.searchsorted(row, np.arange(len(texts) + 1))
            out: list[tuple] = []
            for i, text in enumerate(texts):
                words = text.encode().split()
                n = len(words)
                gone = np.zeros(n, dtype=bool)
                if whole[i] and n >= window:
                    gone[:] = True
                elif at[i] < at[i + 1]:
                    gone = covered(n, lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]] + window - 1)
                out.append((n, int(gone.sum()), b" ".join(itertools.compress(words, ~gone))))
            n, r, rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(rest, pa.binary())], names=[*batch.schema.names[:kept], "n_words", "n_removed", "kept"])

    return run


def kept_words(docs: DataFrame, *, window: int = 35, least: int = 8, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns named in keep (none of them __key, __text, whole or spans), with n_words, n_removed and kept: the words
    left, joined by one space (UTF-8)."""
    keep = docs.columns if keep is None else keep
    texts = distinct_texts(docs.withColumn("__none", F.lit(None).cast("long")), "__none", text_col)
    copied = texts.where("copies > 1")
    spans, tried = repeated_windows(texts.where("copies = 1"), words_of, window, levels(window, least), copied)
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    marks = texts.select("no", F.col("key").alias("__key"), (F.col("copies") > 1).alias("whole")).join(spans, "no", "left").where("whole or spans is not null")
    marks = staged(marks.select("__key", "whole", F.coalesce("spans", none).alias("spans")), "marks")
    unstage(texts, spans, *([tried] if len(levels(window, least)) > 1 else []))
    rows = docs.select(*keep, text_key(docs[text_col]).alias("__key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text")).join(marks, "__key", "left")
    rows = rows.select(*keep, "__text", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("spans", none).alias("spans"))
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    return rows.mapInArrow(keep_rest(window, len(keep)), schema)


def drop_repeated_substrings(docs: DataFrame, *, window: int = 35, least: int = 8, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text behind its columns.

    A word goes if a window of so many words covers it whose words also start anywhere else, in the same document too;
    windows are judged on the input. Words are runs of other characters than \x20 and \x09-\x0D, unchanged.

    A null text has no words: 0, 0 and the empty text. Repeated rows are documents of their own, so their windows are
    repeated; null and repeated ids don't matter. Columns with the new names are replaced, any other may have any name;
    an empty table stays empty. Windows are told apart by 95 bits of two hashes.
    """
    named, old = numbered(docs, ("n_words", "n_removed", "kept_text"))
    done = kept_words(named, window=window, least=least, text_col=f"c{old.index(text_col)}")
    return renamed(done, old, "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"))


def with_rest_as_text(docs: DataFrame, *, window: int = 35, least: int = 8, text_col: str = "text") -> DataFrame:
    """docs with the kept words as their text; a text that loses nothing stays as it is, a document that loses all goes.
    Null and empty texts and texts without words stay; any column may have any name."""
    named, old = numbered(docs)
    text = f"c{old.index(text_col)}"
    done = kept_words(named, window=window, least=least, text_col=text)
    stay = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return renamed(stay.withColumn(text, F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.decode("kept", "UTF-8"))), old)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = kept_words(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM starts) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM repeated
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs
), kept AS (
  SELECT words.r, count(gone.i) AS n_removed, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY words.i), '') AS s
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.r = kept.r
"""
