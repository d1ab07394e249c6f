"""Raw frames: files cut anywhere, as a batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from twinledger.operators.running import numbered
from twinledger.plans import queries
from twinledger.sources import frames, wire
from twinledger.streaming import processors

DATA = "/root/testdata/sf0.001"
FIELDS = [*wire.NUMBERS, *wire.IDS]


@pytest.fixture(scope="module")
def records(spark):
    return queries._records(spark, DATA).filter("order_key < 400").cache()


def rows(df):
    return sorted(map(str, df.select(*FIELDS).collect()))


def test_frames_written_and_read(spark, records, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "SPLIT", 100)
    monkeypatch.setattr(frames, "HELD", 7)
    whole = records.filter(F.octet_length("record") == wire.RECORD.itemsize)
    frames.save(whole.repartition(3), str(tmp_path / "bus"))
    events, rejects = frames.read(spark, str(tmp_path / "bus"))
    assert events.rdd.getNumPartitions() > 5 and rows(events) == rows(wire.decoded(records)) and rejects.count() == 0


def test_files_cut_anywhere(spark, records, tmp_path):
    """Each file's whole frames are events, what is left at its end a reject."""
    size = wire.RECORD.itemsize
    data = b"".join(r.record for r in records.filter(F.octet_length("record") == size).limit(40).collect())
    folder = tmp_path / "bus"
    folder.mkdir()
    cuts = [0, 10 * size, 10 * size + 60, 30 * size - 1, len(data)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (folder / f"f{i}").write_bytes(data[a:b])
    (folder / "empty").write_bytes(b"")
    (folder / ".hidden").write_bytes(b"x" * size)
    events, rejects = frames.read(spark, str(folder))
    ends = [(b - a) // size for a, b in zip(cuts, cuts[1:])]
    assert events.groupBy("file").count().count() == sum(n > 0 for n in ends) and events.count() == sum(ends)
    assert {(r.file[-2:], r.offset, len(r.record)) for r in rejects.collect()} == {(f"f{i}", n * size, (b - a) % size) for i, (n, a, b) in enumerate(zip(ends, cuts, cuts[1:])) if (b - a) % size}
    assert sorted(r.offset for r in events.filter(F.col("file").endswith("f0")).collect()) == [i * size for i in range(10)]


def test_frames_as_a_stream(spark, records, tmp_path):
    whole = records.filter(F.octet_length("record") == wire.RECORD.itemsize)
    parts = whole.randomSplit([1.0, 1.0], 3)
    want = rows(wire.decoded(whole))
    for i, part in enumerate(parts):  # the second run of the query takes the new files alone
        frames.save(part.coalesce(1), str(tmp_path / f"new{i}"))
        (tmp_path / "bus").mkdir(exist_ok=True)
        (tmp_path / f"new{i}" / "part-00000").rename(tmp_path / "bus" / f"f{i}")
        events, _ = frames.subscribed(spark, str(tmp_path / "bus"))
        processors.to_parquet(events, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_ordinals_of_equal_times(spark):
    table = spark.createDataFrame([(i % 7, i % 3, i) for i in range(500)], "a int, b int, c int").repartition(5)
    got = {(r.a, r.b, r.c): r.ordinal for r in numbered(table, ["a", "b", "c"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted((i % 7, i % 3, i) for i in range(500)))}
    assert numbered(table.limit(0), ["a"]).count() == 0
