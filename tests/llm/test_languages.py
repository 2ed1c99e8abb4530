"""Language identification: the models against a plain version, and held-out accuracy."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from runsight.llm import languages as lid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ción", "os", "ña", "que"]}


def speak(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 5))) for _ in range(n))


def raw_counts(words, order):
    out = {}
    for w in words:
        for n, g in lid.grams(w, order):
            out.setdefault(n, Counter())[g] += 1
    return out


def test_probabilities_sum_to_one():
    draw = random.Random(1)
    words = speak(draw, "cc", 300).split()
    counts = raw_counts(words, 4)
    alphabet = 1 + len(counts[1])
    fitted, unseen = lid.kneser_ney(counts, 4, alphabet)
    logs = {g: p for found, ps, _ in fitted.values() for g, p in zip(found, ps, strict=True)}
    weights = {g: w for found, _, ws in fitted.values() for g, w in zip(found, ws, strict=True)}
    characters = sorted(counts[1])

    def p(gram):
        if gram in logs:
            return 2 ** logs[gram]
        return 2 ** weights.get(gram[:-1], 0.0) * p(gram[1:]) if len(gram) > 1 else 2**unseen

    for context in ["", "c", " ", " o", "ció", " xx", "q"]:
        assert sum(p(context + c) for c in characters) + 2**unseen * (2 ** weights.get(context, 0) if context else 1) <= 1.001
        assert sum(p(context + c) for c in characters) > 0.9
    models = lid.assemble(["cc"], [counts], 4)
    for word in ["ción", "os", "zzz", "osos", "a"]:
        padded = f" {word} "
        want = -sum(math.log2(p(padded[max(0, i - 3) : i + 1])) for i in range(1, len(padded)))
        assert models.word_bits([word, "os"])[0, 0] == pytest.approx(want)


def rows_of(draw, n):
    rows = []
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        rows.append((i, speak(draw, lang, draw.choice([3, 30, 200])), lang))
    return rows


def test_held_out_documents(spark, tmp_path):
    rows = rows_of(random.Random(2), 300)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 ½ --", None), (None, "ka lo mi", "zz"), (903, "ka lo tu", None), rows[0], (904, "ж" * 50, None), (905, "x" * 30000, "aa")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, "s", 1) for r in rows + odd], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = lid.op6_language_id(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[904].rejected and by[904].lang_pred in SYLLABLES and by[None].lang_pred in SYLLABLES
    held = [r for r in rows if by[r[0]].held_out]
    assert len(held) > 40 and np.mean([by[d].lang_pred == lang for d, _, lang in held]) > 0.98
    assert np.mean([by[d].rejected for d, _, _ in rows]) < 0.02


def test_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None, "k")], "doc_id long, text string, lang string, score string")
    (row,) = lid.identify(docs, lid.fit_on_documents(docs)).collect()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
    assert lid.identify(docs.limit(0), lid.fit_on_documents(docs.limit(0))).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
