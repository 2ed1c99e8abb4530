"""Embedding near-dedup against brute force."""

import numpy as np

from runsight.llm import vectors


def brute(rows, cosine=0.95):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if j < i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, links[i], least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def clusters(seed, n, dim=16):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = draw.normal(size=dim)
        rows.append(x)
        for _ in range(int(draw.integers(0, 4)) + (60 if i == 3 else 0)):
            rows.append(x * draw.uniform(0.1, 9) + draw.normal(size=dim) * 0.15 * draw.uniform(0, 1))
    return [(7 * i % 1009, [float(np.float32(v)) for v in r]) for i, r in enumerate(rows)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def table(spark, rows):
    return spark.createDataFrame([(d, v, 1, "x", 2) for d, v in rows], "vec_id long, embedding array<float>, label int, node string, n_links int")


ODD = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None, 1.0]), (2004, [float("nan")] * 16), (2005, [float("inf"), 1.0]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, [1.0, 2.0])]


def test_all_pairs_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rows = clusters(1, 80)
    rows += [*ODD, rows[0], rows[0], (3000, rows[3][1]), (2001, [1e-30, 0.0]), (2002, [3e38, 0.0])]
    out = vectors.with_groups(table(spark, rows)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=key)
    assert got == sorted(((d, n, c, bool(k) if d is not None else c is None) for d, n, c, k in brute(rows)), key=key)


def test_recall_over_many_cells(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 30)
    rows = [(i, v) for i, (_, v) in enumerate(clusters(2, 250, 32))]
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r.vec_id: r for r in vectors.op4_embedding_near_dedup(spark, str(tmp_path)).collect()}
    want = {d: (n, c) for d, n, c, _ in brute(rows)}
    assert all(out[d].n_links <= n for d, (n, _) in want.items())  # no link below, none twice
    assert sum(r.n_links for r in out.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(out[d].component_id == c for d, (_, c) in want.items()) >= 0.98 * len(rows)


def test_empty_table(spark):
    out = vectors.with_groups(table(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "embedding", "label", "node", "n_links", "component_id", "kept"]
