"""Substring dedup and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from runsight.llm import rolling, substrings


def brute_words(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept))
    return out


def texts_with_repeats(draw, n, size, words=("a", "b", "é", "日本", "the", "x.", "y\x1cz")):
    shared = [" ".join(draw.choices(words, k=draw.randrange(5, 60))) for _ in range(4)]
    rows = [(None if i == 3 else i, draw.choice([" ", "\n", "\t\v"]).join([" ".join(draw.choices(words, k=draw.randrange(size))), draw.choice(shared), " ".join(draw.choices(words, k=draw.randrange(size))), draw.choice(shared)])) for i in range(n)]
    return [*rows, (50, None), (51, ""), (52, " \n"), rows[1], rows[1], (53, rows[2][1]), (54, "a " * 300), (55, "a " * 5)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("window,seed", [(35, 1), (8, 2), (3, 3)])
def test_words_in_repeated_windows_go(spark, make_docs, window, seed):
    rows = texts_with_repeats(random.Random(seed), 25, 60)
    out = substrings.drop_repeated_substrings(make_docs(rows, extra=True), window=window, least=2).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=key) == sorted(brute_words(rows, window), key=key)


def test_substring_query(spark, make_docs, sf_dir):
    rows = texts_with_repeats(random.Random(9), 30, 90)
    out = substrings.op1_substring_dedup(spark, sf_dir.write(make_docs(rows))).collect()
    want = [(d, n, r, hashlib.sha256(kept.encode()).hexdigest()) for d, n, r, kept in brute_words(rows, 35)]
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    assert substrings.op1_substring_dedup(spark, sf_dir.write(make_docs([]))).count() == 0


def test_levels_double():
    assert substrings.levels(35, 8) == [9, 18, 35] and substrings.levels(100, 20) == [25, 50, 100] and substrings.levels(3, 8) == [3]


def test_anchors_are_alike_in_equal_windows(monkeypatch):
    monkeypatch.setattr(rolling, "SEGMENT", 64)
    draw = np.random.default_rng(1)
    values = rolling.mix(draw.integers(0, 3, 500).astype(np.uint64) + np.uint64(1))
    alive = np.ones(500 - 20 + 1, dtype=bool)
    h, lo, hi = rolling.anchored(values, alive, 20, 6)
    by_start = {s: x for x, a, b in zip(h, lo, hi, strict=True) for s in range(a, b + 1)}
    assert sorted(by_start) == list(range(481))
    for s in range(481):
        assert by_start[s] == min(rolling.window_hashes(values[s : s + 20], 6)).view(np.int64)


def test_words_of_long_words(monkeypatch):
    monkeypatch.setattr(rolling, "SEGMENT", 4)
    texts = [b"abc " * 20 + b"x" * 100, b"", b" \n", b"abc"]
    values, begin = rolling.words_of(texts)
    assert begin.tolist() == [0, 21, 21, 21, 22] and len({*values.tolist()}) == 2 and values[0] == values[21]


def brute_bytes(rows, window):
    """In order of id (null last), then of the text's hash; rows that repeat id and text are one document."""
    order = sorted({(d is None, d or 0, hashlib.sha256((t or "").encode()).digest()[:16], (t or "").encode()) for d, t in rows})
    seen, done = set(), {}
    for late, d, _, data in order:
        gone = set()
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            if s in seen:
                gone |= set(range(i, i + window))
            seen.add(s)
        spans = sum(1 for i in gone if i - 1 not in gone)
        done[late, d, data] = (len(data), len(gone), spans, bytes(b for i, b in enumerate(data) if i not in gone))
    return [(d, *done[d is None, d or 0, (t or "").encode()]) for d, t in rows]


@pytest.mark.parametrize("window,most,seed", [(100, 4096, 1), (12, 4096, 2), (12, 2, 3), (7, 1, 4)])
def test_later_copies_go(spark, make_docs, monkeypatch, window, most, seed):
    from runsight.llm import suffixes

    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    rows = texts_with_repeats(random.Random(seed), 25, 40)
    rows += [(30, rows[4][1]), (4, rows[6][1]), (None, rows[5][1]), (60, "ab" * 200)]
    out = suffixes.drop_later_copies(make_docs(rows, extra=True), window=window, least=3).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out), key=key) == sorted(brute_bytes(rows, window), key=key)


def test_suffix_query(spark, make_docs, sf_dir):
    from runsight.llm import suffixes

    rows = texts_with_repeats(random.Random(12), 40, 80)
    out = suffixes.op5_suffix_array_dedup(spark, sf_dir.write(make_docs(rows)))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(*x, hashlib.sha256(kept).hexdigest()) for *x, kept in brute_bytes(rows, 100)]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert suffixes.op5_suffix_array_dedup(spark, sf_dir.write(make_docs([]))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    from runsight.llm import suffixes

    draw = random.Random(seed)
    data = draw.choice(["ab" * 30, "a" * 40, "".join(draw.choices("ab", k=70)), "".join(draw.choices("abc", k=200)) * 2])
    place = list(range(len(data)))
    if seed % 2:
        draw.shuffle(place)
    window = draw.choice([1, 5, 16, 33])

    def common(i, j):
        n = 0
        while n < window and max(i, j) + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        return n

    want = [max([common(i, j) for j in range(len(data)) if place[j] < place[i]], default=0) for i in range(len(data))]
    got = suffixes.longest_previous(np.frombuffer(data.encode(), dtype=np.uint8).astype(np.int64), np.array(place), window)
    assert got.tolist() == want


def test_string_ids_and_texts_beyond_a_segment(spark, make_docs):
    from runsight.llm import suffixes

    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefgh ", k=400))
    long = "".join(draw.choices("xyz ", k=rolling.SEGMENT - 150)) + passage + "".join(draw.choices("uvw ", k=900))
    rows = [(1, long), (2, passage + "!"), (3, long + passage)]
    docs = make_docs(rows)
    named = docs.withColumn("doc_id", docs.doc_id.cast("string")).withColumnRenamed("lang", "__key").withColumnRenamed("source", "__text")
    out = suffixes.drop_later_copies(named).collect()
    assert sorted((int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out) == sorted(brute_bytes(rows, 100))
    assert {r["__key"] for r in out} == {"en"} and {r["__text"] for r in out} == {"src"}
    out = substrings.drop_repeated_substrings(named).collect()
    assert sorted((int(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out) == sorted(brute_words(rows, 35))
    assert {r["__key"] for r in out} == {"en"}
