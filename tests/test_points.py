"""Files of a restarted run in any order, late and again, end with the batch merge."""

import random

from runsight.operators.series import restart_upsert
from runsight.streaming import points

SCHEMA = "series_id string, start double, path string, row_no long, t double, v double"


def test_any_order_of_files_equals_the_batch(spark, tmp_path):
    draw = random.Random(8)
    files = []
    for start in (0.0, 4.0, 7.0, 4.0):
        path = f"case/{start}/f{len(files)}"
        files.append([(s, start, path, n, start + n // 2, draw.random()) for s in ("p", "U") for n in range(draw.randrange(3, 12))])
    want = sorted(tuple(r) for r in restart_upsert(spark.createDataFrame([r for f in files for r in f], SCHEMA)).collect())
    order = [2, 0, 3, 1, 2, 0]  # late files, and two that come again
    for at in (order[:2], order[2:]):  # the second half after a restart
        for i in at:
            spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = points.keep_points(stream, f"{tmp_path}/out", once=True, checkpointLocation=f"{tmp_path}/cp")
        assert query.awaitTermination(120)
    got = points.read_points(spark, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in got.collect()) == want
