"""Packing: token pieces into sequences by first-fit decreasing, in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, table
from .counts import Library
from .rolling import mix

#: Tokens in a group, about. Groups are drawn by hash, so they are alike in size however the rows are dealt.
GROUP_TOKENS = 1 << 21

PIECES = "grp long, doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Bins in the order they were opened; a tournament over their free room finds the first that still fits."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which it takes."""
        room, at = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_, left = at - self.leaves, room[at] - size
        room[at] = left
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins, each a list of positions in sizes; every size is from 1 to capacity. Equal sizes keep their order."""
    tree, bins = CapacityTree(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (position, start, length) in which only the last is not full: the emptiest bins' pieces are cut into the others' gaps."""
    used = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    out = [[(i, 0, sizes[i]) for i in bins[b]] for b in order]
    left = [capacity - used[b] for b in order]
    lo, hi = 0, len(out) - 1
    while lo < hi:
        if not left[lo]:
            lo += 1
        elif not out[hi]:
            out.pop()
            hi -= 1
        else:
            i, start, length = out[hi].pop()
            take = min(length, left[lo])
            out[lo].append((i, start, take))
            left[lo] -= take
            left[hi] += take
            if take < length:
                out[hi].append((i, start + take, length - take))
    return [b for b in out if b]


def tail_by_powers(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """One bin that isn't full as bins of a power of two each, the largest first; they need no padding."""
    total, out, at = sum(p[2] for p in pieces), [], 0
    pieces = list(pieces)
    if total == capacity:
        return [pieces]
    for bit in reversed(range(total.bit_length())):
        room, bin_ = total & (1 << bit), []
        while room:
            i, start, length = pieces[at]
            take = min(room, length)
            bin_.append((i, start, take))
            room -= take
            if take < length:
                pieces[at] = (i, start + take, length - take)
            else:
                at += 1
        if bin_:
            out.append(bin_)
    return out


def pack_group(pdf: pd.DataFrame, capacity: int, width: int) -> pd.DataFrame:
    """One group's pieces, in sequences numbered from grp * 2^32."""
    kind = "Int64" if pd.api.types.is_numeric_dtype(pdf["doc_id"]) or pdf["doc_id"].isna().all() else "object"
    pdf = pdf.sort_values(["doc_id", "start", "doc_tokens", "ids"], na_position="first", kind="stable").reset_index(drop=True)
    sizes = pdf["length"].tolist()
    small = [i for i, n in enumerate(sizes) if n < capacity]
    bins = [[(i, 0, n)] for i, n in enumerate(sizes) if n == capacity]
    filled = fill(first_fit_decreasing([sizes[i] for i in small], capacity), [sizes[i] for i in small], capacity)
    filled = [[(small[i], start, n) for i, start, n in b] for b in filled]
    if filled:
        bins += filled[:-1] + tail_by_powers(filled[-1], capacity)
    base, rows = int(pdf["grp"].iloc[0]) << 32, []
    doc_id, start_of, doc_tokens, ids = (pdf[c].tolist() for c in ("doc_id", "start", "doc_tokens", "ids"))
    for b, bin_ in enumerate(bins):
        offset = 0
        for i, start, n in bin_:
            piece = np.frombuffer(ids[i], dtype=f"<u{width}")[start : start + n].astype("<u4").tobytes()
            rows.append((doc_id[i], start_of[i] + start, n, doc_tokens[i], base + b, offset, piece))
            offset += n
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return out.astype({"doc_id": kind})


def drawn(row: int, times: int, task: int, start: int, groups: int) -> int:
    """The group of a piece: of a row by its hash, the copy of it in the task, the task and, for a full piece, its place."""
    with np.errstate(over="ignore"):
        x = np.array([row], dtype=np.int64).view(np.uint64)
        for part in (times, task, start):
            x = mix(x + np.uint64(part + 1) * np.uint64(0x9E3779B97F4A7C15))
    return int(x[0] % np.uint64(groups))


def token_pieces(capacity: int, width: int, end_id: int, tokenizer: str, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, text) to PIECES: tokenises and cuts each document into pieces of capacity and a rest.

    Full pieces, which are sequences, go to any group, so a long document isn't one group's. Repeated rows are told apart
    by their number in the task: whatever order the task reads them in, the same pieces go to the same groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, task = Library.of(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in blocks(batches, "text"):
            cols: dict[str, list] = {c: [] for c in ("grp", "doc_id", "start", "length", "doc_tokens", "ids")}
            row, doc_id = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, d, ids in zip(row, doc_id, library.ids(batch.column(2).to_pylist()), strict=True):
                seen[r] = times = seen.get(r, -1) + 1
                ids = np.append(ids, np.uint32(end_id))
                packed, n = ids.astype(f"<u{width}").tobytes(), len(ids)
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    g = drawn(r, times, task, start if length == capacity else -1, groups)
                    for c, v in zip(cols, (g, d, start, length, n, packed[start * width : (start + length) * width]), strict=True):
                        cols[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else batch.column(1).type if c == "doc_id" else pa.int64()) for c, v in cols.items()], names=list(cols))

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_tokens: int = GROUP_TOKENS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit).

    A document's ids, with end_id behind them, are cut into pieces of capacity and a rest. Each randomised group of
    documents, of about group_tokens tokens, is packed by itself: full pieces are sequences; rests go first-fit decreasing
    into bins found by a tournament tree, then the emptiest bins' pieces are cut into the other bins' gaps; the one bin
    left over is cut into sequences of a power of two, which aren't padded. So no sequence of a group needs padding.

    A null or empty text is end_id alone; ids are of any type, a null one stays null; repeated rows are documents of their
    own and go to different groups; an empty table gives no rows; other columns are left out.
    """
    width = 2 if Library.of(tokenizer).size <= 1 << 16 else 4
    named = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-((total["size"] or 0) // 4 + total["rows"]) // group_tokens))
    rows = named.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("row"), "doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(token_pieces(capacity, width, end_id, tokenizer, groups), PIECES.replace("doc_id long", f"doc_id {kind}"))
    return pieces.groupBy("grp").applyInPandas(lambda pdf: pack_group(pdf, capacity, width), PACKED.replace("doc_id long", f"doc_id {kind}"))


def with_digest(packed: DataFrame) -> DataFrame:
    """The columns of the packing query: the ids as their CRC-32 (Spark's own, of the binary)."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_digest(pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json")))
