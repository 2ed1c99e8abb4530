"""Lloyd rounds against plain Python."""

import hashlib

import numpy as np
import pytest

from runsight.llm import centroids


def plain(rows, clusters, rounds, dimensions):
    kept = []
    for d, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and abs(x) < 1 << 19 for x in v):
            kept.append((d, [int(np.floor(256 * float(x))) for x in v]))
    marks = sorted((hashlib.sha256(f"2:{'' if d is None else d}".encode()).hexdigest(), v) for d, v in kept)
    centres = [v for _, v in marks[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), m in zip(kept, members, strict=True) if m == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(d, *near(v)) for d, v in kept]
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(x for _, x, _ in last)
    return [(d, n, x, sum(y for _, y, m in last if m == n), total, mark[n]) for d, x, n in last]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(seed, n, dimensions):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(4, dimensions))
    return [(int(i), [float(np.float32(x)) for x in middles[i % 4] + 0.3 * draw.normal(size=dimensions)]) for i in range(n)]


ODD = [(900, None), (901, [1.0]), (902, []), (903, [None] * 5), (904, [float("nan")] * 5), (905, [float("-inf")] * 5), (906, [600000.0] * 5), (907, [500000.0] * 5), (None, [0.5] * 5), (None, [-0.5] * 5), (2**60 + 1, [0.25] * 5)]


@pytest.mark.parametrize("clusters", [1, 7, 500])
def test_against_plain(spark, monkeypatch, clusters):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 50)
    rows = made(1, 300, 5)
    rows += [*ODD, rows[0], rows[0], (3, rows[1][1]), *[(1000 + i, rows[2][1]) for i in range(150)]]  # repeated rows and ids, a third of the rows alike
    vectors = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    out = centroids.clustered(vectors, clusters=clusters, rounds=3, dimensions=5)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(plain(rows, clusters, 3, 5), key=key)


def test_ties_and_empty_clusters():
    cluster, distance = centroids.nearest(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [4, 4]


def test_empty_table(spark):
    out = centroids.clustered(spark.createDataFrame([], "vec_id int, embedding array<double>"))
    assert out.count() == 0 and dict(out.dtypes)["vec_id"] == "int"
