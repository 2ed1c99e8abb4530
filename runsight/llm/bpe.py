"""Byte-level BPE encoding and decoding by merge ranks, with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, renamed, table
from .pieces import PieceCache, pieces

#: Matches of the split pattern, and pieces of a few matches, that a process keeps the ids of; about 200 bytes each.
MATCHES, PIECES = 1_200_000, 200_000

_codecs: dict[tuple[str, str], Codec] = {}


class RankQueue:
    """Places waiting in a bucket for each merge rank, and a bitmap of two levels of the buckets in use, the lower 256 wide.

    The lowest rank in use is found by find-first-set from the top level down; adding and emptying a bucket touch one
    bit a level.
    """

    __slots__ = ("buckets", "low", "top")

    def __init__(self):
        self.top, self.low, self.buckets = 0, {}, {}

    def add(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [place]
            part = rank >> 8
            self.low[part] = self.low.get(part, 0) | 1 << (rank & 255)
            self.top |= 1 << part
        else:
            bucket.append(place)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its places, ascending; their bucket is empty from now on."""
        part = (self.top & -self.top).bit_length() - 1
        bits = self.low[part]
        first = bits & -bits
        self.low[part] = bits ^ first
        if bits == first:
            self.top ^= 1 << part
        rank = part << 8 | first.bit_length() - 1
        places = self.buckets.pop(rank)
        if len(places) > 1:
            places.sort()
        return rank, places


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the split pattern: the pair of lowest rank is joined, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is joined to the left
    before = list(range(-1, n - 1))  # before[i]: where the part in front of i starts
    queue, get = RankQueue(), ranks.get
    pair_rank = [-1] * n  # the rank under which the pair that starts at i waits; other entries of i are stale
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair_rank[i] = rank
            queue.add(rank, i)
    while queue.top:
        rank, places = queue.pop()
        for i in places:
            if pair_rank[i] != rank:
                continue
            j = end[i]
            stop = end[j]
            end[i], end[j], pair_rank[i], pair_rank[j] = stop, 0, -1, -1
            if stop < n:
                before[stop] = i
                new = get(piece[i : end[stop]])
                if new is not None:
                    pair_rank[i] = new
                    queue.add(new, i)
            left = before[i]
            if left >= 0:
                new = get(piece[left:stop])
                pair_rank[left] = -1 if new is None else new
                if new is not None:
                    queue.add(new, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes by one rank file, one for each process."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        # a match that has left its cache costs a merge, a piece only its matches' look-up: most of the room is for matches
        self.matches = PieceCache(lambda found: [struct.pack(f"<{len(x)}I", *x) for x in (merge(m.encode(), self.ranks) for m in found)], MATCHES)
        self.cache = PieceCache(self._encode, PIECES)

    @staticmethod
    def of(path: str, pattern: str) -> Codec:
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = Codec(path, pattern)
        return _codecs[path, pattern]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        self.matches.learn({m for ms in found for m in ms})
        known = self.matches.known
        return [b"".join(map(known.__getitem__, ms)) for ms in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [pieces(t) for t in texts]
        self.cache.learn({p for ps in cut for p in ps})
        known = self.cache.known
        return [b"".join(map(known.__getitem__, ps)) for ps in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def bpe_encode(docs: DataFrame, *, ranks: str, pattern: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit) behind its columns, and with decode the bytes they stand for.

    Each match of the split pattern is merged by itself, special strings are ordinary text. Rows aren't moved: one pass
    of the workers over the texts, no shuffle. A null or empty text has empty ids; repeated rows stay; columns named
    ids or decoded are replaced; an empty table stays empty.
    """
    # columns go under names of their own, so that any name may clash
    docs, old = numbered(docs, ("ids", "decoded"))
    kept = docs.columns
    source = docs.select(*kept, F.coalesce(F.col(f"c{old.index(text_col)}").cast("string"), F.lit("")).alias("__text"))
    added = ["ids", "decoded"] if decode else ["ids"]
    schema = source.drop("__text").schema
    for name in added:
        schema = schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for batch in blocks(batches, "__text"):
            ids = codec.encode(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([codec.decode(b) for b in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return renamed(source.mapInArrow(run, schema), old, *added)


def bpe_decode(encoded: DataFrame, *, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the column decoded (binary) behind its columns; null ids decode to no bytes."""
    encoded, old = numbered(encoded, ("decoded",))
    kept = encoded.columns
    source = encoded.select(*kept, F.coalesce(F.col(f"c{old.index(ids_col)}"), F.lit(b"")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for batch in blocks(batches, "__ids"):
            decoded = [codec.decode(b) for b in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(decoded, pa.binary())], names=[*kept, "decoded"])

    return renamed(source.mapInArrow(run, source.drop("__ids").schema.add("decoded", "binary")), old, "decoded")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, decode=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
