"""Lempel-Ziv fingerprints against a plain version."""

import hashlib
import random

import pytest

from runsight.llm import fingerprints as fp


def phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def jaccard(a, b):
    a, b = phrases(a), phrases(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def corpus(draw, n):
    words = ["alpha", "beta", "gâ", "日本", "🙂", "delta", "of", "the"]
    return [(i * 3, " ".join(draw.choices(words, k=draw.randrange(0, 200)))) for i in range(n)]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        new = t[: n - n // 4] + after[: n // 4]
        out.append((d, n, hashlib.sha256(new.encode()).hexdigest(), jaccard(t, new), jaccard(t, after)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r[:3])


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_edits_against_brute_force(spark, make_docs, monkeypatch, buckets):
    rows = [*corpus(random.Random(buckets), 40), (1, None), (2, ""), (2, "x"), (2, "x"), (None, "no id"), (None, None), (500, "ab" * 3000)]
    out = fp.edited_fingerprints(make_docs(rows, extra=True), buckets=buckets).collect()
    want = sorted(brute(rows), key=key)
    got = sorted(out, key=lambda r: key(tuple(r)))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want, strict=True):
        if r.n_chars <= 40:  # small sets are kept whole
            assert r.near_edited == pytest.approx(w[3]) and abs(r.near_next - w[4]) < 0.2
        assert abs(r.near_edited - w[3]) < 0.2 and abs(r.near_next - w[4]) < 0.2


def test_lone_and_empty_tables(spark, make_docs, sf_dir):
    (row,) = fp.op2_fingerprints(spark, sf_dir.write(make_docs([(7, "abcdefgh")]))).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    (row,) = fp.edited_fingerprints(make_docs([(None, None)])).collect()
    assert (row.n_chars, row.near_edited, row.near_next, row.fingerprint) == (0, 1, 1, "")
    assert fp.op2_fingerprints(spark, sf_dir.write(make_docs([]))).count() == 0


def test_fingerprints_of_texts(spark, make_docs):
    rows = [*corpus(random.Random(1), 20), (90, None), (91, "dup dup dup"), (92, "dup dup dup")]
    out = {r.doc_id: r for r in fp.fingerprints(make_docs(rows, extra=True)).collect()}
    assert out[91].fingerprint == out[92].fingerprint and out[90].fingerprint == ""
    edited = {r.doc_id: r.fingerprint for r in fp.edited_fingerprints(make_docs(rows)).collect()}
    assert all(edited[d] == out[d].fingerprint for d in out)
    assert fp.likeness(*(fp.from_string(out[d].fingerprint) for d in (91, 92))) == 1
