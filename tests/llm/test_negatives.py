"""Hard negatives against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import negatives


def brute(rows, every, positives=5, n_negatives=3):
    good = []
    for no, (d, v, label) in enumerate(rows):
        if d is not None and label is not None and v and all(x is not None and abs(x) < 1 << 19 for x in v):
            good.append((no, d, [int(np.floor(256 * x)) for x in v], label))
    out = []
    for no, d, v, label in good:
        if d % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), e, m == label) for o, e, w, m in good if o != no and len(w) == len(v)]
        near = sorted((s, e) for s, e, same in scored if same)[:positives]
        for s, e in near:
            hard = sorted((t, g) for t, g, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:n_negatives]
            out += [(d, e, i + 1, g, -s, -t) for i, (t, g) in enumerate(hard)]
    return sorted(out)


def made(seed, n, dim, spread):
    """Vectors around a few directions; spread: how much norms differ."""
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = middles[draw.integers(6)] + 0.6 * draw.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v * np.exp(spread * draw.normal())], int(draw.integers(4))))
    return rows


def run(spark, rows, every):
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, part string, rank int").repartition(3)
    out = negatives.hard_negatives(vectors, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


ODD = [(8000, None, 1), (8001, [], 1), (8002, [None, 1.0], 1), (8004, [float("nan")] * 8, 1), (8008, [float("inf")] * 8, 1), (8012, [9e5] * 8, 1), (8016, [1.0] * 8, None), (None, [1.0] * 8, 1), (8020, [0.0] * 8, 1), (8024, [1.0, 2.0], 1), (8028, [2.0, 1.0], 1), (8029, [1.5, 0.2], 2), (8032, [3.0], 9)]


@pytest.mark.parametrize("spread", [0.0, 1.2])
def test_against_brute_force(spark, monkeypatch, spread):
    for name, bits in (("BUCKET_BITS", 3), ("CHUNK_BITS", 1), ("BLOCK_BITS", 4), ("SLICE", 5)):
        monkeypatch.setattr(negatives, name, bits)
    rows = made(3, 240, 8, spread)
    copy = rows[17][1]
    rows += [*ODD, rows[4], rows[4], *[(400 + i, copy, i % 3) for i in range(130)]]  # repeated rows, and a third of the rows with one vector
    got = run(spark, rows, 4)
    assert got == brute(rows, 4) and len(got) > 100


def test_norms_prune_buckets():
    """With norms that fall, few buckets are multiplied, and the result is that of all."""
    draw = np.random.default_rng(5)
    v = (draw.normal(size=(4000, 8)) * np.exp(-np.arange(4000) / 300)[:, None] * 5000).astype(np.int64)
    norm = np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    all_of = {"no": np.arange(4000), "id": np.arange(4000), "label": np.arange(4000) % 3, "norm": norm, "v": v}
    buckets = [{c: x[np.sort(part)] for c, x in all_of.items()} for part in np.array_split(order, 40)]
    anchors = {c: x[:50] for c, x in all_of.items()} | {"low": np.full((50, 1), negatives.LOW), "high": np.full((50, 1), negatives.HIGH)}
    multiplied = []
    real = negatives.products
    try:
        negatives.products = lambda a, b: multiplied.append(len(a)) or real(a, b)
        found = negatives.search(anchors, buckets, 5, True)
    finally:
        negatives.products = real
    assert sum(multiplied) < 50 * 40 / 4
    for i in range(50):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(4000) if j != i and j % 3 == i % 3)[:5]
        assert found.id[i, 0].tolist() == [j for _, j in want]


def test_products_stay_exact():
    a = np.array([[2**26 + 1] * 64])
    assert negatives.products(a, a)[0, 0] == 64 * (2**26 + 1) ** 2


def test_empty_table(spark):
    assert run(spark, [], 4) == []
    assert run(spark, [(1, [1.0], 2)], 4) == []
