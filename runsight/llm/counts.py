"""Token counts: short texts piece by piece, huge ones in overlapping chunks spliced at stable common boundaries."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, numbered, renamed, table, text_key
from .pieces import PieceCache, every_space_cuts, is_settled, pieces, settled_parts

#: Characters of a chunk, and by how many each chunk reaches into its neighbours.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Bytes before the end of a cut-off chunk in which boundaries may come out otherwise than in the whole text: longer
#: than any added token and than the one character that the split pattern looks ahead.
MARGIN = 64

_libraries: dict[str, Library] = {}


def direct_encoder(spec: dict) -> Callable[[str], list[int]] | None:
    """tiktoken for a vocabulary of the tokenizers library whose merges come in order of their ids, and only for settled
    texts: there the classes of the split pattern don't depend on a library's version of Unicode. None for other vocabularies."""
    import public_tokenizers
    import tiktoken

    model = spec["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if odd or -1 in ids or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or not byte_of.keys() <= model["vocab"].keys():
        return None
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if set(t) <= byte_of.keys()}
    reached = {*ids, *(model["vocab"][c] for c in byte_of)}
    ranks = {t: i for t, i in ranks.items() if i in reached}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Library:
    """The tokenizers library for one vocabulary file, one for each process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Whether a text's tokens are bytes of it in order, and the split pattern that pieces() needs holds.
        self.byte_level = bool(spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache = PieceCache(self._encode)
        self.direct = direct_encoder(spec) if self.byte_level else None

    @staticmethod
    def of(path: str) -> Library:
        if path not in _libraries:
            _libraries[path] = Library(path)
        return _libraries[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [not self.byte_level or any(a in t for a in self.added) for t in texts]
        return [self._encode([t])[0] if w else b"".join(self.parts(t)) for t, w in zip(texts, whole, strict=True)]

    def parts(self, text: str) -> list[bytes]:
        """The ids of parts of a text that the split pattern keeps apart."""
        if self.direct is None:
            return self.cache.of(pieces(text))
        if is_settled(text):
            return [np.array(self.direct(text), dtype="<u4").tobytes()]
        if not every_space_cuts(text):
            return self.cache.of(pieces(text))
        cut = list(settled_parts(text))
        other = [n for n, part in enumerate(cut) if not is_settled(part)]
        for n, found in zip(other, self.cache.of([cut[n] for n in other]), strict=True):
            cut[n] = found
        return [part if isinstance(part, bytes) else np.array(self.direct(part), dtype="<u4").tobytes() for part in cut]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<u4") for b in self.packed(texts)]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Byte places at which a match of the split pattern or an added token starts, the tokens before each, and all tokens."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        added = set(self.added)
        sizes = np.fromiter((len(t.encode()) if t in added else len(t) for t in e.tokens), dtype=np.int64, count=len(e.ids))
        words = np.fromiter((-1 if w is None else w for w in e.word_ids), dtype=np.int64, count=len(e.ids))
        starts = np.cumsum(sizes) - sizes
        first = np.ones(len(words), dtype=bool)
        first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        at = np.flatnonzero(first)
        return starts[at], at, len(e.ids)


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) in characters: chunk n covers its own chunk characters and overlap more on either side."""
    cuts = list(range(0, len(text), chunk)) or [0]
    return [(max(0, c - overlap), min(len(text), c + chunk + overlap)) for c in cuts]


def stable(library: Library, piece: str, at: int, zone_left: int, zone_right: int, last: bool) -> tuple:
    """(places in the left zone, tokens before them, places in the right zone, tokens before them, all tokens).

    at: byte place of the piece in its text; zone_left and zone_right: bytes at its ends shared with the neighbours.
    """
    places, before, total = library.boundaries(piece)
    size = len(piece.encode())
    left = (places > 0) & (places <= zone_left)
    right = (places > 0) & (places >= size - zone_right) & (places < size - MARGIN) & (not last)
    return places[left] + at, before[left], places[right] + at, before[right], total


def spliced_count(library: Library, text: str, chunk: int, overlap: int) -> int:
    """The text's tokens from overlapping chunks; while two neighbours share no boundary, all overlaps get four times as wide."""
    if overlap >= chunk or len(text) <= chunk:
        return len(library._encode([text])[0]) // 4
    cuts, total, before = chunks_of(text, chunk, overlap), 0, None
    at = [0, *np.cumsum([len(text[a:b].encode()) for a, b in zip([c[0] for c in cuts[:-1]], [c[0] for c in cuts[1:]], strict=True)]).tolist()]
    for n, (a, b) in enumerate(cuts):
        shared_left = len(text[a : cuts[n - 1][1]].encode()) if n else 0
        shared_right = len(text[cuts[n + 1][0] : b].encode()) if n + 1 < len(cuts) else 0
        lp, lc, rp, rc, all_ = stable(library, text[a:b], at[n], shared_left, shared_right, n + 1 == len(cuts))
        if before is not None:
            common, i, j = np.intersect1d(before[0], lp, return_indices=True)
            if not len(common):
                return spliced_count(library, text, chunk, overlap * 4)
            total += int(before[1][i[0]]) - int(lc[j[0]])
        before = (rp, rc)
    return total + all_


def _long(values) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


CHUNKS = "key binary, idx long, chunks long, at long, shared_left long, shared_right long, piece string"
ENCODED = "key binary, idx long, chunks long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>, total long"


def token_counts(docs: DataFrame, *, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens behind its columns: the text's UTF-8 bytes and its tokens as the library counts them.

    A text of up to chunk characters is encoded in one task, piece by piece with a cache. A longer one is cut into
    chunks that overlap; tasks encode chunks, whichever texts they come from, and give the boundaries in the overlaps.
    A boundary where both neighbours start a match of the split pattern is stable: from there the pattern goes on by
    what follows alone. Counts are spliced there. Texts with neighbours that share none are counted with wider
    overlaps, at last whole.

    Null is the empty text: 0 and 0. Repeated rows and ids stay; columns named n_bytes or n_tokens are replaced, any
    other may have any name; an empty table stays empty. For tokenizers that aren't byte-level every text is encoded whole.
    """
    byte_level = Library.of(tokenizer).byte_level
    docs, old = numbered(docs, ("n_bytes", "n_tokens"))
    text_col = f"c{old.index(text_col)}"
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(text_key(docs[text_col]).alias("key"), text.alias("text"))
    is_short = F.char_length("text") <= chunk if byte_level else F.lit(True)

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(tokenizer)
        for batch in blocks(batches, "text"):
            counts = [len(b) // 4 for b in library.packed(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cuts, at = chunks_of(whole, chunk, overlap), 0
                for n, (a, b) in enumerate(cuts):
                    shared_left = len(whole[a : cuts[n - 1][1]].encode()) if n else 0
                    shared_right = len(whole[cuts[n + 1][0] : b].encode()) if n + 1 < len(cuts) else 0
                    yield pa.RecordBatch.from_pylist([dict(key=key, idx=n, chunks=len(cuts), at=at, shared_left=shared_left, shared_right=shared_right, piece=whole[a:b])])
                    if n + 1 < len(cuts):
                        at += len(whole[a : cuts[n + 1][0]].encode())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(tokenizer)
        for batch in batches:
            rows = [(r["key"], r["idx"], r["chunks"], *stable(library, r["piece"], r["at"], r["shared_left"], r["shared_right"], r["idx"] + 1 == r["chunks"])) for r in batch.to_pylist()]
            if rows:
                key, idx, n, lp, lc, rp, rc, total = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(idx, pa.int64()), pa.array(n, pa.int64()), _long(lp), _long(lc), _long(rp), _long(rc), pa.array(total, pa.int64())], names=[c.split()[0] for c in ENCODED.split(", ")])

    def count_widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(tokenizer)
        for batch in blocks(batches, "text"):
            counts = [spliced_count(library, t, chunk, overlap * 4) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    # each different text is counted once: copies of a huge text would otherwise mix their chunks
    short = texts.where(is_short).mapInArrow(count_short, "key binary, n_tokens long").groupBy("key").agg(F.first("n_tokens").alias("n_tokens"))
    counted = short
    if byte_level:
        huge = texts.where(~is_short).groupBy("key").agg(F.first("text").alias("text"))
        encoded = huge.mapInArrow(cut, CHUNKS).repartition("key", "idx").mapInArrow(encode, ENCODED)
        order = Window.partitionBy("key").orderBy("idx")
        spliced = (
            encoded.withColumns({"next_at": F.lead("left_at").over(order), "next_n": F.lead("left_n").over(order)})
            .withColumn("splice", F.array_min(F.array_intersect("right_at", "next_at")))
            .withColumn(
                "share",
                F.when(F.col("idx") == F.col("chunks") - 1, F.col("total")).otherwise(
                    F.element_at("right_n", F.array_position("right_at", F.col("splice")).cast("int")) - F.element_at("next_n", F.array_position("next_at", F.col("splice")).cast("int"))
                ),
            )
            .groupBy("key")
            .agg(F.sum("share").alias("n_tokens"), F.bool_or(F.col("share").isNull()).alias("open"))
        )
        widened = huge.join(spliced.where("open").select("key"), "key", "left_semi").mapInArrow(count_widened, "key binary, n_tokens long")
        counted = short.unionByName(spliced.where("not open").select("key", "n_tokens")).unionByName(widened)
    rows = docs.select("*", F.octet_length(text).cast("long").alias("n_bytes"), text_key(docs[text_col]).alias("key"))
    return renamed(rows.join(counted, "key", "left"), old, "n_bytes", "n_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
