"""The pipeline against plain versions of its stages."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_languages import speak
from tests.llm.test_substrings import brute_words


def documents(draw):
    passage = speak(draw, "aa", 50)
    rows = [(i, speak(draw, draw.choice(["aa", "bb", "cc"]), 120)) for i in range(60)]
    rows += [(100 + i, t.replace("ka", "lo", 1)) for i, (_, t) in enumerate(rows[:10])]
    rows += [(200 + i, speak(draw, "aa", 40) + " " + passage) for i in range(4)]
    return [*rows, (300, None), (301, ""), (302, "1 2 3"), (303, passage), (304, rows[5][1]), rows[6]]


def test_stages_and_run(spark, tmp_path):
    rows = documents(random.Random(4))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    lang = lambda t: None if not t else "aa" if "ka" in t or "lo" in t else "bb" if "ein" in t or "sch" in t else "cc"
    spark.createDataFrame([(d, t, lang(t), "s", len(t or "")) for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert seen[0] == sorted(r for r in rows if r[0] not in (300, 301, 302))
    heads = {c for _, n, c in brute_components(seen[0])}
    assert seen[1] == sorted({r for r in seen[0] if r[0] in heads})
    rest = {d: (kept if gone else dict(seen[1])[d]) for d, n, gone, kept in brute_words(seen[1], 35) if not gone or gone < n}
    assert dict(seen[2]) == rest and 303 not in rest
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in rest.items()}
    assert {r.doc_id for r in out} == set(ids) and sum(r.length for r in out) == sum(map(len, ids.values()))
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in out)


def test_long_texts_and_clashing_columns(spark, tmp_path):
    """A text of 400,000 characters and columns with names that operators use pass through every stage."""
    draw = random.Random(9)
    rows = [(i, speak(draw, "aa" if i % 2 else "bb", 60)) for i in range(40)] + [(90, speak(draw, "aa", 80_000)), (91, None), (92, "")]
    more = {c: "x" for c in ("key", "ids", "no", "cid", "component_id", "kept", "n_words", "sequence_id", "c0")}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more)
    spark.createDataFrame([(d, t, None if not t else "aa" if d % 2 or d == 90 else "bb", "s", 1, *more.values()) for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(rows[40][1]) > 200_000
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *more]
    left = {r.doc_id: r for r in docs.collect()}
    assert left.keys() == set(range(40)) | {90} and left[90].text == rows[40][1] and all(r.key == "x" and r.c0 == "x" for r in left.values())
    pieces = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).where("doc_id = 90").collect()
    assert len(pieces) > 10 and sum(r.length for r in pieces) == pieces[0].doc_tokens


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
