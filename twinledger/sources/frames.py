"""Files of binary records as a bus leaves them: frames of one length, one after another, as a batch and as a stream.

A file is cut into splits at borders of frames, so tasks share large files. What remains at its end and is shorter than a frame
is a row as well, which `wire.rejects` finds. A stream takes each file once, when it has been there at a look; files are
expected to be complete when they appear, as after a rename. Empty files give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import wire

FORMAT, SCHEMA = "frames", "file string, offset long, record binary"
#: Frames of a split, and those that are held at once.
SPLIT, HELD = 1 << 20, 1 << 14


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of the one file, by name."""
    system, at = _system(path)
    from pyarrow import fs

    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    inside = system.get_file_info(fs.FileSelector(at)) if found.type == fs.FileType.Directory else []
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _system(path: str):
    from pyarrow import fs

    if not urlparse(path).scheme or path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def _splits(files: list[tuple[str, int]], frame: int) -> list[Split]:
    step = SPLIT * frame
    return [Split(path, at, min(at + step, size)) for path, size in files for at in range(0, size, step)]


def _read(split: Split, frame: int) -> Iterator[pa.RecordBatch]:
    path, at, end = split.value
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        while at < end:
            data = f.read_at(min(HELD * frame, end - at), at)
            starts = range(0, len(data), frame)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(starts)), pa.array([at + i for i in starts], pa.int64()), pa.array([data[i : i + frame] for i in starts], pa.binary())],
                ["file", "offset", "record"],
            )
            at += len(data)


class _Batch(DataSourceReader):
    def __init__(self, path: str, frame: int):
        self.path, self.frame = path, frame

    def partitions(self) -> list[Split]:
        return _splits(_files(self.path), self.frame)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.frame)


class _Stream(DataSourceStreamReader):
    """Offsets are the names of the files that have been seen, with their sizes."""

    def __init__(self, path: str, frame: int):
        self.path, self.frame = path, frame

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(dict(_files(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        before = json.loads(start["files"])
        return _splits([(p, n) for p, n in json.loads(end["files"]).items() if p not in before], self.frame)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.frame)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    """Options: path, and frame, the bytes of one (those of a binary record by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _of(self, kind: type):
        return kind(self.options["path"], int(self.options.get("frame", wire.RECORD.itemsize)))

    def reader(self, schema) -> DataSourceReader:
        return self._of(_Batch)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return self._of(_Stream)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Frames)
    return spark


def read(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of the frames in a folder or file: file, offset and the fields of each; what is no whole frame."""
    frames = _registered(spark).read.format(FORMAT).options(path=path, **options).load()
    return wire.decoded(frames), wire.rejects(frames)


def subscribed(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """As `read`, of a stream of files as they arrive in a folder."""
    frames = _registered(spark).readStream.format(FORMAT).options(path=path, **options).load()
    return wire.decoded(frames), wire.rejects(frames)


def save(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Writes records as files of frames to a new folder, one for each partition. A file appears whole, under its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, at = _system(path)
        name = f"{at.rstrip('/')}/part-{task.partitionId():05d}"
        n, own = 0, f"{at.rstrip('/')}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with system.open_output_stream(own) as f:
            for b in batches:
                for record in b.column(0):
                    if record.is_valid:
                        f.write(record.as_py())
                        n += 1
        system.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    system, at = _system(path)
    system.create_dir(at)
    records.select(record_col).mapInArrow(run, "file string, n long").write.format("noop").mode("overwrite").save()
