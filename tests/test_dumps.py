"""The data source of line files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import dumps


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(dumps.LineFiles)


def write(folder, name, lines, end="\n"):
    (folder / name).write_bytes("\n".join(lines).encode() + end.encode())


def plain(folder):
    out = []
    for file in sorted(p for p in folder.iterdir() if p.name[0] not in "._"):
        at = 0
        for line in file.read_bytes().split(b"\n"):
            if line.strip():
                out.append((line.decode().rstrip("\r"), file.name, at))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_is_in_one_range(tmp_path, size, monkeypatch):
    monkeypatch.setattr(dumps, "READ_BYTES", 13)
    rng = random.Random(size)
    for k in range(4):
        write(tmp_path, f"part-{k}", ["é" * rng.randint(0, 30) + str(i) * (i % 3) for i in range(rng.randint(0, 40))], "\n" if k % 2 else "")
    (tmp_path / "_hidden").write_text("no\n")
    reader = dumps.LineReader({"path": str(tmp_path), "rangeBytes": str(size)})
    rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == plain(tmp_path)


def test_batch_read(spark, tmp_path):
    write(tmp_path, "a", [f"line {i}\r" for i in range(1000)])
    got = spark.read.format("line_files").option("rangeBytes", "900").load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 5 and sorted(map(tuple, got.collect())) == plain(tmp_path)
    (tmp_path / "none").mkdir()
    assert spark.read.format("line_files").load(str(tmp_path / "none")).count() == 0


def test_stream_goes_on_where_it_was(spark, tmp_path):
    """A dump that grows, a line that is not finished yet, restarts, and ranges of a few lines."""
    source, out, state, mark = (tmp_path / n for n in ("in", "out", "state", "mark"))
    source.mkdir()

    def run():
        rows = spark.readStream.format("line_files").option("rangeBytes", "100").option("commitPath", str(mark)).load(str(source))
        stream = rows.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True)
        stream.start(str(out)).awaitTermination()

    write(source, "log-0", [f"zero {i}" for i in range(50)], "\nunfinished")
    run()
    assert spark.read.parquet(str(out)).count() == 50
    write(source, "log-0", [f"zero {i}" for i in range(50)], "\nunfinished no more\n")
    write(source, "log-1", [f"one {i}" for i in range(30)])
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == plain(source)
    assert json.loads(mark.read_text())["file"] in ("log-0", "log-1")  # a batch is committed when the next one is planned
    assert spark.read.parquet(str(out)).select(F.count_distinct("value")).first()[0] == 81
