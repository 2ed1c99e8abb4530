"""Suffix-array dedup of bytes: later copies of long strings go, the first stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct_texts, numbered, renamed, staged, table, text_key, unstage
from .rolling import BASES, anchored, covered, mix, powers, sums
from .substrings import byte_unit, levels, living, ranges_of, repeated_windows

#: Different contexts of one anchor that go into one suffix array; a commoner anchor's windows are dealt by longer anchors.
MOST_CONTEXTS = 4096
#: Bytes of contexts in a suffix array, once the groups in it are whole.
ARRAY_BYTES = 1 << 17

PLACE = "struct<no long, lo int>"


def prefix_ranks(symbols: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of each place by the 1, 2, 4, ... symbols from it, up to at least length (prefix doubling); equal strings share
    one. Beyond the end there is less than any symbol."""
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)]
    span = 1
    while span < length:
        behind = np.zeros_like(ranks[-1])
        behind[:-span] = ranks[-1][span:]
        ranks.append(np.unique(ranks[-1] << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64) + np.uint64(1))
        span *= 2
    return ranks


def common_lengths(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols from places a and b on are equal, up to most."""
    out, size = np.zeros(len(a), dtype=np.int64), len(ranks[0])
    for level in reversed(range(len(ranks))):
        x, y = a + out, b + out
        inside = (x < size) & (y < size)
        same = inside & (ranks[level][np.where(inside, x, 0)] == ranks[level][np.where(inside, y, 0)])
        out += same.astype(np.int64) << level
    return np.minimum(out, most)


def previous_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry the common length with the entry before it, in this order, whose place is smaller: with the nearest
    one, for those further off have no more in common. common[i]: of entries i - 1 and i.

    Everything between an entry and its candidate has larger places, so a candidate that is too large hands on its own.
    """
    n = len(place)
    at, least = np.arange(n) - 1, common.copy()
    least[:1] = 0
    left = np.flatnonzero((at >= 0) & (place[at] > place))
    while len(left):
        over = at[left]
        least[left] = np.minimum(least[left], least[over])
        at[left] = at[over]
        left = left[(at[left] >= 0) & (place[at[left]] > place[left])]
    least[at < 0] = 0
    return least


def longest_previous(symbols: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """The longest previous factor of each position, up to window: how much of what starts there also starts at a smaller place.

    In suffix order, the previous and the next entry of a smaller place have the most in common with an entry.
    """
    ranks = prefix_ranks(symbols, window)
    order = np.lexsort((place, ranks[-1]))
    common = np.zeros(len(order), dtype=np.int64)
    common[1:] = common_lengths(ranks, order[:-1], order[1:], window)
    before = previous_smaller(place[order], common)
    behind = previous_smaller(place[order][::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(before, behind)
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2] - 1


CONTEXT = f"h long, cid binary, place {PLACE}, hi int"


def context_pass(window: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(no, text, spans) to a row for each anchor's run of living windows; cid stands for the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            values, begin = byte_unit(texts)
            h, lo, hi = anchored(values, living(begin, window, batch.column(2)), window, k)
            row = np.searchsorted(begin, lo, side="right") - 1
            cid = np.empty(len(h), dtype=[("a", "<u8"), ("b", "<u8")])
            cid["a"], cid["b"] = (span_hashes(values, lo, hi - lo + window, which) for which in (0, 1))
            place = pa.StructArray.from_arrays([batch.column(0).take(pa.array(row)), pa.array((lo - begin[row]).astype(np.int32))], names=["no", "lo"])
            ids = pa.array(cid.view("V16").tolist() if len(cid) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h), ids, place, pa.array((hi - begin[row]).astype(np.int32))], names=["h", "cid", "place", "hi"])

    return run


def span_hashes(values: np.ndarray, at: np.ndarray, lengths: np.ndarray, which: int) -> np.ndarray:
    """A hash of so many values from each place, by differences of running sums."""
    running = sums(values, which)
    size = lengths.astype(np.uint64)
    return mix((running[at + lengths] - running[at]) * powers(which, len(values) + 1)[1][at] + size * np.uint64(BASES[1 - which]))


ROW = "grp long, no long, lo int, bytes binary"


def gather_pass(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(no, text, heads) to the contexts' bytes, those of one anchor under its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows: list[tuple] = []
            for no, text, heads in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                rows += [(x["h"], no, x["lo"], data[x["lo"] : x["hi"] + window]) for x in heads]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["grp", "no", "lo", "bytes"])

    return run


GONE = "no long, lo int, hi int"


def later_windows(rows: pa.Table, window: int) -> pa.RecordBatch:
    """The windows in the contexts whose longest previous factor is a whole window."""
    data = rows.column("bytes").to_pylist()
    no, lo = (np.asarray(rows.column(c)).astype(np.int64) for c in ("no", "lo"))
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(data)), sizes + 1)
    start = np.arange(len(of)) - begin[of]
    # each context ends with a symbol of its own, so nothing in common reaches over it
    symbols = np.frombuffer(b"".join(d + b"\0" for d in data), dtype=np.uint8).astype(np.int64)
    symbols[begin + sizes] = 256 + np.arange(len(data))
    text = np.unique(no, return_inverse=True)[1].astype(np.int64)
    late = longest_previous(symbols, text[of] << 32 | lo[of] + start, window) >= window
    a, b = runs(late)
    return pa.RecordBatch.from_arrays([pa.array(no[of[a]]), pa.array((start[a] + lo[of[a]]).astype(np.int32)), pa.array((start[b] + lo[of[b]]).astype(np.int32))], names=["no", "lo", "hi"])


def array_pass(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of grp to the later windows: a suffix array over as many whole groups as make ARRAY_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in blocks(batches, "bytes", ARRAY_BYTES // 4):
            grp = np.asarray(batch.column(0))
            if size >= ARRAY_BYTES:
                cut = 0 if grp[0] != last else int(np.argmax(grp != last)) if (grp != last).any() else len(grp)
                if cut < len(grp):
                    yield later_windows(pa.Table.from_batches([*held, batch.slice(0, cut)]), window)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column(3).nbytes
            last = grp[-1]
        if held:
            yield later_windows(pa.Table.from_batches(held), window)

    return run


def later_copies(texts: DataFrame, window: int, least: int) -> DataFrame:
    """(no, gone): for texts (no, text; numbers differ and order them), the windows of each that also start earlier, as starts
    lo to hi; staged. Texts without repeated anchors are left behind.

    Contexts of one anchor, folded where their bytes are equal, make a group of a suffix array. An anchor with too many is
    split: its windows are dealt anew by anchors of twice the length. Those of the window's own length have one context.
    """
    lengths = levels(window, least)
    spans, alive = repeated_windows(texts, byte_unit, window, lengths[:-1] or lengths)
    unstage(spans)
    source, gone = alive, []
    for k in lengths:
        found = source.select("no", "text", "spans").mapInArrow(context_pass(window, k), CONTEXT)
        more = F.first(F.col("hi") - F.col("place.lo")).alias("more")
        firsts = staged(found.groupBy("cid").agg(F.min("place").alias("head"), F.first("h").alias("h"), more, F.count(F.lit(1)).alias("c")), "firsts")
        # the same bytes as an earlier context: all their windows are later ones
        again = found.join(firsts.where("c > 1").select("cid", "head"), "cid").where(F.col("place") != F.col("head"))
        gone.append(staged(again.select("place.no", "place.lo", "hi"), "again"))
        # a lone context repeats nothing, for its windows hold the anchor at different places
        sizes = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        dealt = staged(firsts.join(sizes, "h").select("h", "n", "head.no", "head.lo", (F.col("head.lo") + F.col("more")).alias("hi")), "dealt")
        entries = F.collect_list(F.struct("h", "lo", "hi")).alias("heads")
        lists = dealt.where(F.col("n") <= MOST_CONTEXTS).groupBy("no").agg(entries)
        heads = staged(source.select("no", "text").join(lists, "no").mapInArrow(gather_pass(window), ROW), "contexts")
        gone.append(staged(heads.repartition("grp").sortWithinPartitions("grp").mapInArrow(array_pass(window), GONE), "gone"))
        split = dealt.where(F.col("n") > MOST_CONTEXTS).groupBy("no").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        before, source = source, staged(source.select("no", "text").join(split, "no"), "split")
        unstage(before, firsts, dealt, heads)
    unstage(source)
    both = gone[0]
    for part in gone[1:]:
        both = both.unionByName(part)
    out = staged(both.groupBy("no").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")), "later")
    unstage(*gone)
    return out


LEFT = "n_bytes long, n_removed long, n_spans long, kept binary"


def keep_bytes(window: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kept columns, text, whole, gone) to the kept columns and LEFT; whole: all goes that is as long as a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            texts, whole = (batch.column(kept + i).to_pylist() for i in range(2))
            row, lo, hi = ranges_of(batch.column(kept + 2))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[tuple] = []
            for i, text in enumerate(texts):
                data = text.encode()
                if whole[i] and len(data) >= window:
                    out.append((len(data), len(data), 1, b""))
                elif whole[i] or at[i] == at[i + 1]:
                    out.append((len(data), 0, 0, data))
                else:
                    gone = covered(len(data), lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]] + window - 1)
                    out.append((len(data), int(gone.sum()), len(runs(gone)[0]), np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *columns], names=[*batch.schema.names[:kept], *(c.split()[0] for c in LEFT.split(", "))])

    return run


def kept_bytes(docs: DataFrame, *, window: int = 100, least: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns named in keep (none of them __key, __text, __id, whole or gone), with n_bytes, n_removed, n_spans and kept."""
    keep = docs.columns if keep is None else keep
    texts = distinct_texts(docs, id_col, text_col)
    later = later_copies(texts.select("no", "text"), window, least)
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    marks = staged(texts.select("no", F.col("key").alias("__key"), "copies", F.col("first_id").alias("__first")).join(later, "no", "left").where("copies > 1 or gone is not null").select("__key", "__first", F.coalesce("gone", none).alias("gone")), "marks")
    unstage(texts, later)
    rows = docs.select(*keep, docs[id_col].alias("__id"), text_key(docs[text_col]).alias("__key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text")).join(marks, "__key", "left")
    # a copy behind the first document of its text
    whole = F.col("gone").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    rows = rows.select(*keep, "__text", whole.alias("whole"), F.coalesce("gone", none).alias("gone"))
    schema = docs.select(*keep).schema
    for name, kind in (c.split() for c in LEFT.split(", ")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(keep_bytes(window, len(keep)), schema)


def drop_later_copies(docs: DataFrame, *, window: int = 100, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal runs) and kept_bytes behind its columns.

    Texts are UTF-8 bytes. A byte goes if a string of window bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in its own. Strings are judged on the input.

    Anchors of strings that occur once are dropped length by length (as in substrings.py). What is left is gathered by
    anchor and put into suffix arrays with their common lengths; previous and next smaller places give the longest
    previous factor, and a place goes where that is a whole window. Equal stretches are folded first, combined in the
    map tasks; an anchor with over MOST_CONTEXTS different surroundings is split by longer anchors, so no group in a task
    is larger than that.

    Ids are of any type that can be ordered. Null is the empty text. Null ids come last; different texts of one id are
    ordered by the hash of their text; rows that repeat both are one document, each with its result. Columns with the new
    names are replaced, any other may have any name; an empty table stays empty.
    """
    named, old = numbered(docs, ("n_bytes", "n_removed", "n_spans", "kept_bytes"))
    done = kept_bytes(named, window=window, least=least, id_col=f"c{old.index(id_col)}", text_col=f"c{old.index(text_col)}")
    return renamed(done, old, "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_bytes"))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    done = kept_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
