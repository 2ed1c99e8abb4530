"""Packing, token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runsight.llm import bpe, counts, packing
from runsight.llm.pieces import pieces

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")

ODD = [
    (0, None), (1, ""), (2, " "), (3, "  a  b \n\n  c"), (4, "x <|endoftext|>  <|endoftext|> y"), (5, "\t\n 　 \x1c x \x85y"), (6, "it's 12 ½ ² é́ 日本語 🙂🙂"),
    (7, "a" * 5000), (8, "word " * 3000), (8, "word " * 3000), (None, "no id"), (9, " lead and trail "), (10, "'s 's'll"), (11, " x  y"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t 　\x1cab'sé1½.-日", max_size=40))
def test_pieces_encode_alone(text):
    library = counts.Library.of(JSON)
    assert "".join(pieces(text)) == text
    assert library.ids([text])[0].tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merges_are_tiktokens(text):
    codec = bpe.Codec.of(RANKS, P.PATTERN)
    if not hasattr(codec, "other"):
        codec.other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    (ids,) = codec.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == codec.other.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_matches_merge(encoding):
    codec, draw = bpe.Codec.of(RANKS, P.PATTERN), random.Random(3)
    for alphabet in ("a", "ab", "abcdefghij", "=-"):
        text = "".join(draw.choice(alphabet) for _ in range(20_000))
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_rank_queue_orders():
    queue, draw = bpe.RankQueue(), random.Random(1)
    put = defaultdict(list)
    for i in range(5000):
        rank = draw.choice([0, 63, 64, 4095, 4096, 50_000, draw.randrange(1 << 18)])
        queue.add(rank, i)
        put[rank].append(i)
    seen = []
    while queue.top:
        seen.append(queue.pop())
    assert seen == sorted(put.items())


def test_bpe_query(spark, make_docs, sf_dir, encoding):
    rows = bpe.op10_byte_bpe(spark, sf_dir.write(make_docs(ODD))).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for d, t in ODD:
        ids = encoding.encode_ordinary(t or "")
        want.append((d is None, d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_clashing_names_empty_table_round_trip(spark, make_docs):
    out = bpe.bpe_encode(make_docs(ODD, extra=True), ranks=RANKS, pattern=P.PATTERN)
    assert out.columns.count("ids") == 1 and "key" in out.columns
    back = bpe.bpe_decode(out, ranks=RANKS, pattern=P.PATTERN).collect()
    assert all(r.decoded.decode() == (r.text or "") for r in back)
    assert bpe.bpe_encode(make_docs([]), ranks=RANKS, pattern=P.PATTERN).count() == 0


def test_count_query(spark, make_docs, sf_dir, library):
    rows = counts.op9_token_counts(spark, sf_dir.write(make_docs(ODD))).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    assert got == sorted((d is None, d or 0, len((t or "").encode()), k, k > 512) for (d, t), k in zip(ODD, n, strict=True))
    assert counts.op9_token_counts(spark, sf_dir.write(make_docs([]))).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(200, 80), (700, 100)])
def test_huge_texts_are_spliced(spark, make_docs, library, chunk, overlap):
    draw = random.Random(5)
    words = ["the", " ", "<|endoftext|>", "日本語", "\n\n", "it's", "12", "  ", "x" * 300, "-" * 90, "é"]
    rows = [(i, "".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(400))) for i in range(12)] + [(20, "a" * 3000), (21, "ab " * 900), (21, "ab " * 900)]
    out = counts.token_counts(make_docs(rows, extra=True), tokenizer=JSON, chunk=chunk, overlap=overlap)
    assert {(r.doc_id, r.n_tokens) for r in out.collect()} == {(d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in rows}
    assert out.count() == len(rows)
    lib = counts.Library.of(JSON)
    assert all(counts.spliced_count(lib, t, chunk, overlap) == len(library.encode(t, add_special_tokens=False).ids) for _, t in rows)


def test_sentencepiece_like_tokenizers_count_whole(spark, make_docs):
    path = P.path("word_bpe_49k.json")
    other, rows = Tokenizer.from_file(path), [(1, "Some  WORDS here"), (2, "x" * 100)]
    out = counts.token_counts(make_docs(rows), tokenizer=path, chunk=10, overlap=4).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {d: len(other.encode(t, add_special_tokens=False).ids) for d, t in rows}


def check_packing(rows, docs, library, capacity=2048):
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, (ids, *copies) in want.items():
        cover = sorted(parts[d])
        assert sum(n for _, n, _, _ in cover) == len(ids) * (1 + len(copies))
        for start, n, crc, total in cover:
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
        if not copies:
            assert [s for s, *_ in cover] == np.cumsum([0] + [n for _, n, _, _ in cover])[:-1].tolist()
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return sequences


def test_packing_query(spark, make_docs, sf_dir, library):
    draw = random.Random(2)
    rows = [*ODD, *((100 + i, "some words " * draw.randrange(1, 900)) for i in range(150))]
    out = packing.op3_packing(spark, sf_dir.write(make_docs(rows))).collect()
    check_packing(out, rows, library)
    assert packing.op3_packing(spark, sf_dir.write(make_docs([]))).count() == 0


def test_packing_many_groups(spark, make_docs, library):
    rows = [(i, "w " * (i % 70)) for i in range(300)]
    out = packing.pack_documents(make_docs(rows, extra=True), tokenizer=JSON, capacity=64, group_tokens=512)
    assert out.select((packing.F.col("sequence_id") / 2**32).cast("int").alias("g")).distinct().count() > 3
    check_packing(packing.with_digest(out).collect(), rows, library, 64)


def test_first_fit_decreasing_is_the_plain_one():
    draw = random.Random(4)
    for n in (0, 1, 2, 17, 300):
        sizes, bins = [draw.randrange(1, 101) for _ in range(n)], []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            for b in bins:
                if sum(sizes[j] for j in b) + sizes[i] <= 100:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert packing.first_fit_decreasing(sizes, 100) == bins


def test_settled_parts():
    from runsight.llm.pieces import every_space_cuts, is_settled, settled_parts

    library, draw = counts.Library.of(JSON), random.Random(6)
    assert library.direct is not None

    def want(text):
        return np.array(library.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    for _ in range(400):
        text = "".join(draw.choices(["a", "Bc", " ", " ", "é", "日", "\n", ".", "'s", "1", "  ", "\u00a0", "ß x", "\r\n", "'", "٣", "😀"], k=draw.randrange(40)))
        if every_space_cuts(text):
            assert "".join(settled_parts(text)) == text
        assert library.packed([text])[0] == want(text)
    settled = [chr(c) for c in range(0x20, 0xE000) if is_settled(chr(c))]
    assert len(settled) > 32000
    for at in range(0, len(settled), 500):
        text = "".join(f"a{c}1 {c}.{c}" for c in settled[at : at + 500])
        assert library.packed([text])[0] == want(text)


def test_clashing_names(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None), (3, "ü " * 50)]).withColumnsRenamed({"lang": "__key", "source": "__text", "n_chars": "c0"})
    from runsight.llm import fingerprints

    for out in (counts.token_counts(docs, tokenizer=JSON), bpe.bpe_encode(docs, ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN), fingerprints.fingerprints(docs)):
        assert out.columns[:5] == docs.columns
        assert sorted((r.doc_id, r["__key"], r["__text"], r.c0) for r in out.collect()) == [(1, "en", "src", 3), (2, "en", "src", 0), (3, "en", "src", 100)]
