"""The shuffled shards: whole, even, drawn by the seed and the same again."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import shards
from runsight.llm.common import staged


def texts(n):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{j}" for j in draw.integers(0, 90, draw.integers(0, 40)))) for i in range(n)]
    rows += [(5, "copy")] * (n // 3) + [(None, None), (n, ""), (n + 1, "é" * 9), (n + 2, None), (n + 3, "x" * 300_000)]
    return rows


@pytest.mark.parametrize("n", [0, 7, 1000])
def test_rows_are_even_and_whole(spark, make_docs, n):
    rows = texts(n) if n else []
    docs = staged(make_docs(rows, extra=True).withColumn("slot", F.lit("s")), "docs")
    out = shards.shuffled(docs, shards=16, bucket_bytes=2000)
    assert out.columns == [c for c in docs.columns if c != "slot"] + ["shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.source, r.ids) for r in got) == Counter((d, t, "src", "i") for d, t in rows)
    sizes = Counter(r.shard for r in got)
    if rows:
        few = len(rows) // 16
        assert sorted(sizes.values(), reverse=True) == ([few + 1] * (len(rows) % 16) + [few] * (16 - len(rows) % 16))[: len(sizes)]
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())


def test_same_again_and_other_seeds(spark, make_docs):
    docs = staged(make_docs([(i, f"text {i}") for i in range(500)]).repartition(3), "docs")
    first, again, other = (sorted((r.shard, r.slot, r.doc_id) for r in shards.shuffled(docs, seed=s).collect()) for s in (1, 1, 2))
    assert first == again and first != other


def test_order_is_drawn(spark, make_docs):
    """Neither ids nor copies stand together: every shard gets its part of both, and neighbours aren't neighbours."""
    rows = [(i, f"text {i}") for i in range(4000)] + [(7, "copy")] * 2000
    got = shards.shuffled(staged(make_docs(rows), "docs"), shards=8).collect()
    copies, low = Counter(r.shard for r in got if r.text == "copy"), Counter(r.shard for r in got if r.text != "copy" and r.doc_id < 2000)
    assert all(180 < copies[s] < 320 and 180 < low[s] < 320 for s in range(8))  # 250 each, standard deviation 13
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.text != "copy"]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 12


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shards.fisher_yates(4, s, 3)) for s in range(4800))
    assert len(seen) == 24 and max(abs(k - 200) for k in seen.values()) < 75  # standard deviation 14
    assert [shards.fisher_yates(n, 1, 1).tolist() for n in (0, 1)] == [[], [0]]


def test_files_hold_the_order(spark, make_docs, tmp_path):
    docs = staged(make_docs([(i, f"text {i}") for i in range(300)]), "docs")
    shards.write_shards(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "shard", "slot", "_metadata.file_path", "_metadata.row_index").collect()
    assert len({r.doc_id for r in back}) == 300 and len({r.shard for r in back}) == 4
    by_file = {}
    for r in sorted(back, key=lambda r: r.row_index):
        by_file.setdefault(r.file_path, []).append(r.slot)
    assert all(s == sorted(s) for s in by_file.values())


def test_query(spark, make_docs, sf_dir):
    rows = texts(200)
    got = shards.op12_sharding(spark, sf_dir.write(make_docs(rows))).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
