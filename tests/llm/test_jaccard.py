"""N-gram Jaccard join against brute force."""

import random
import re

import pytest

from runsight.llm import common, jaccard


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=5, percent=75):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(draw, n):
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "A"]
    base = [[draw.choice(words) for _ in range(draw.choice([3, 5, 6, 9, 40, 120]))] for _ in range(n)]
    passage = [draw.choice(words) for _ in range(30)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(draw.randrange(4)):
            c = list(b)
            for _ in range(draw.randrange(1, 4)):
                c[draw.randrange(len(c))] = draw.choice(words)
            rows.append(c)
        rows.append(passage + b[:8])
    texts = [draw.choice([" ", "\n", "\t "]).join(r) for r in rows]
    return [(i * 2 + 1, t if draw.random() < 0.8 else t.upper()) for i, t in enumerate(texts)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("met", [True, False])
def test_components_against_brute_force(spark, make_docs, monkeypatch, seed, met):
    if not met:  # without groups all links come from the bounds alone
        monkeypatch.setattr(jaccard, "similar_groups", lambda sets: spark.createDataFrame([], "sid long, home long"))
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)
    rows = corpus(random.Random(seed), 25)
    rows += [(500, None), (501, ""), (502, " \n"), rows[0], rows[0], (None, rows[1][1]), (None, "nobody has this text at all"), (0, rows[2][1]), (0, "one"), (7, "ONE")]
    out = jaccard.with_components(make_docs(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(brute(rows), key=key)


def test_query_and_empty_table(spark, make_docs, sf_dir):
    rows = corpus(random.Random(5), 10)
    out = jaccard.op7_jaccard_join(spark, sf_dir.write(make_docs(rows)))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute(rows), key=key)
    assert jaccard.op7_jaccard_join(spark, sf_dir.write(make_docs([]))).count() == 0


def test_one_of_each_stays(spark, make_docs):
    rows = corpus(random.Random(8), 10)
    rows += [rows[0], (500, None), (501, ""), (None, rows[1][1]), (None, "a text of its own here and there"), (None, "a text of its own here and there")]
    docs = make_docs(rows, extra=True)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    want = {(c if c is not None else d) for d, n, c in brute(rows) if n and (c is not None or d is not None)}
    got = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert got == sorted({*want, 500, 501})
    assert sum(r.doc_id is None for r in out.collect()) == 1


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    nodes = list(range(400))
    draw.shuffle(nodes)
    links = list(zip(nodes[:150], nodes[1:151], strict=True)) + [(nodes[200], x) for x in nodes[201:300]] + [(5, 5)]
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, by.values())) == [100, 151] and set(nodes[:151]) in by.values()
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_groups_and_clashing_names(spark, make_docs, monkeypatch):
    """Many edited copies of one text, some too far from it to link with it but linked with others; string ids."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(70):
        c = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 4, 5, 7])):
            c[at] = draw.choice(words)
        rows.append((1001 + i, " ".join(c)))
    docs = make_docs(rows)
    named = docs.withColumn("doc_id", docs.doc_id.cast("string")).withColumnsRenamed({"lang": "__key", "source": "key", "n_chars": "home"})
    out = jaccard.with_components(named).collect()
    assert sorted((int(r.doc_id), r.n_shingles, int(r.component_id)) for r in out) == sorted(brute(rows))
    assert {(r["__key"], r["key"]) for r in out} == {("en", "src")}
    stay = jaccard.one_of_each(named)
    assert stay.columns == named.columns and sorted(int(r.doc_id) for r in stay.collect()) == sorted({c for _, _, c in brute(rows)})
