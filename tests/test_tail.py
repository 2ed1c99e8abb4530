"""The tail of growing logs: the lines of a plain reader for any cuts, any chunks and any number of logs."""

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators import catalog as C
from runsight.sources import logs, tail


def plain(data: bytes):
    at, out = 0, []
    for line in data.split(b"\n")[:-1]:
        out.append((at, line.decode("utf-8", "replace").rstrip("\r")))
        at += len(line) + 1
    return out


TEXT = b"first\r\n\n" + "größer € line\n".encode() + b"bad \xff\xe2\x82\n" + b"x" * 5000 + b"\r\r\n" + b"\n" * 7 + b"no end yet"


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("read", [1, 5, 4096])
def test_any_cuts_give_the_same_lines(tmp_path, monkeypatch, split, read):
    if split < 3 and read == 1:
        pytest.skip("slow")
    monkeypatch.setattr(tail, "READ_BYTES", read)
    (tmp_path / "log").write_bytes(TEXT)
    with open(tmp_path / "log", "rb") as f:
        got = [(int(p), x) for begin in range(0, len(TEXT), split) for places, lines in tail.lines_ending_in(f, begin, min(begin + split, len(TEXT))) for p, x in zip(places, lines, strict=True)]
    assert got == plain(TEXT)


def ranges_to_rows(reader, start, end):
    return [(r["segment"], r["line_no"], r["line"]) for part in reader.partitions(start, end) for b in reader.read(part) for r in b.to_pylist()]


@pytest.mark.parametrize("split", [3, 1 << 20])
def test_appends_restarts_and_replays(tmp_path, split):
    f = tmp_path / "log"
    reader, seen = tail.TailReader(str(f), split), []
    offset = reader.initialOffset()
    assert reader.latestOffset() == {}
    for text, mode in (("a\nb", "w"), ("c\r\nd\n", "a"), ("", "a"), ("e\n", "w"), ("f\ng", "a")):
        with open(f, mode, newline="") as out:
            out.write(text)
        before, offset = offset, reader.latestOffset()
        rows = ranges_to_rows(reader, before, offset)
        again = tail.TailReader(str(f), split)  # after a restart the checkpoint has the offsets
        assert ranges_to_rows(again, before, offset) == rows and again.latestOffset() == offset
        reader, seen = again, seen + rows
    assert seen == [(0, 0, "a"), (0, 2, "bc"), (0, 6, "d"), (1, 0, "e"), (1, 2, "f")]
    gone = offset
    (tmp_path / "other").write_text("new file\n")
    (tmp_path / "other").replace(f)
    now = reader.latestOffset()
    assert now[str(f)]["segment"] == 2 and ranges_to_rows(reader, gone, now) == [(2, 0, "new file")]
    assert ranges_to_rows(reader, before, gone) == []  # those bytes are no more


def test_a_long_line_holds_up_nothing(tmp_path):
    """A line of 100 MB comes with the batch that has its end; the lines behind it too, and batches in between pass."""
    f = tmp_path / "log"
    reader, offset, seen = tail.TailReader(str(f), 16 << 20), {}, []
    for text in (b"start\n" + b"y" * (60 << 20), b"y" * (40 << 20), b"\nbehind\n"):
        with open(f, "ab") as out:
            out.write(text)
        before, offset = offset, reader.latestOffset()
        seen.append([(at, len(line), line[:3]) for _, at, line in ranges_to_rows(reader, before, offset)])
    assert seen == [[(0, 5, "sta")], [], [(6, 100 << 20, "yyy"), (7 + (100 << 20), 6, "beh")]]


def test_batch_equals_the_reader_of_whole_files(spark, tmp_path):
    draw = random.Random(4)
    for i in range(6):
        text = "".join("".join(draw.choices("ab é\r", k=draw.randrange(40))) + "\n" for _ in range(draw.randrange(200)))
        (tmp_path / f"case{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"case{i % 2}" / f"log.{i}").write_bytes((text + "tail" * (i % 2)).encode())
    (tmp_path / "notes.txt").write_text("not a log\n")
    tail.register(spark)
    df = spark.read.format("log_tail").option("split", 100).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got, want = {}, {}
    for r in df.orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append(r.line)
    for r in logs.log_lines(spark, *[f"{tmp_path}/case{i}/*" for i in (0, 1)]).orderBy("path", "line_no").collect():
        want.setdefault(r.path.removeprefix("file://"), []).append(r.line)
    assert got == want and len(got) == 6


def test_stream_of_many_logs_over_restarts(spark, tmp_path):
    tail.register(spark)
    logs_at = [tmp_path / f"log.{i}" for i in range(5)]
    whole = {f: "".join(f"line {j} of {f.name}\n" for j in range(30)) + "rest" for f in logs_at}

    def run():
        query = spark.readStream.format("log_tail").option("split", 64).load(str(tmp_path)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()

    for a, b in ((0, 50), (50, 51), (51, 400), (400, 10_000)):
        for i, f in enumerate(logs_at):
            if i < 3 or a >= 51:  # some logs appear later
                with open(f, "a") as out:
                    out.write(whole[f][0 if i >= 3 and a == 51 else a : b])
        run()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{tmp_path}/out").orderBy("path", "line_no").collect()
    got = {}
    for r in rows:
        assert r.segment == 0
        got.setdefault(r.path, []).append((r.line_no, r.line))
    assert got == {str(f): plain(text.encode()) for f, text in whole.items()}


def test_candidates_by_heads_and_tails(spark, tmp_path):
    """The ends of logs alone are read; they give workflow, score and choice."""
    files = {
        "log.simpleFoam": "OpenFOAM v2412\nTime = 1\n", "log.checkMesh": "OpenFOAM v2412\nMesh OK.\n", "run/log.x": "x" * 200_000 + "\nSolving for U", "log.long": "simpleFoam starts\n" + "y" * 200_000, "log.empty": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = logs.log_ends(logs.log_files(spark, str(tmp_path))).withColumn("case", F.lit("c")).withColumn("path", F.substring_index("path", f"{tmp_path}/", -1))
    assert max(len(r.head) + len(r.tail) for r in found.collect()) == 2 * (64 << 10)
    cases = spark.createDataFrame([("c", "simpleFoam", None, "log.long")], "case string, application string, explicit_log string, saved_log string")
    newest = found.agg(F.max("modified_ns")).first()[0]
    out = {r.path: (r.workflow, r.score, r.saved, r["rank"]) for r in C.log_candidates(found, cases, F.lit(newest / 1e9 + 1)).collect()}
    assert out["log.simpleFoam"][:2] == ("solver", 335) and out["log.checkMesh"][:2] == ("utility", 50 + 25 + 10 - 300)
    assert out["log.long"] == ("solver", 900 + 200 + 25 + 10, True, 1) and out["run/log.x"][:2] == ("solver", 50 + 25) and "log.empty" not in out
    assert logs.log_ends(spark.createDataFrame([("/no/such",)], "path string")).first()[1:] == ("", "")


def test_available_now_over_a_replaced_log(spark, tmp_path):
    """Segments and places go on over restarts of a stream that ends by itself, also behind a log that was replaced."""
    tail.register(spark)
    f = tmp_path / "log.a"

    def run():
        stream = spark.readStream.format("log_tail").load(str(tmp_path)).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        assert stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(100)

    f.write_text("one\ntwo\n")
    run()
    (tmp_path / "new").write_text("three\nlonger than before\n")
    (tmp_path / "new").replace(f)
    run()
    for more in ("four\n", "five\n"):
        with open(f, "a") as out:
            out.write(more)
        run()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.segment, r.line_no, r.line) for r in rows) == [(0, 0, "one"), (0, 4, "two"), (1, 0, "three"), (1, 6, "longer than before"), (1, 25, "four"), (1, 30, "five")]
