"""Execution reports as packed little-endian records of 151 bytes, coded in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The record's layout.
ID = 32
RECORD = np.dtype([
    ("exec_type", "u1"), ("ord_status", "u1"), ("seq_num", "<u8"), ("session_id", "<u2"), ("price_micro", "<i8"), ("qty", "<i8"), ("cum_qty", "<i8"),
    ("sending_time", "<u8"), ("transact_time", "<u8"), ("exec_id", f"V{ID}"), ("exec_id_len", "u1"), ("order_id", f"V{ID}"), ("order_id_len", "u1"), ("clord_id", f"V{ID}"), ("clord_id_len", "u1"),
])
NUMBERS = ("exec_type", "ord_status", "seq_num", "session_id", "price_micro", "qty", "cum_qty", "sending_time", "transact_time")
IDS = ("exec_id", "order_id", "clord_id")
#: Numbers that are given as ints, the others as longs.
INTS = ("exec_type", "ord_status", "session_id")


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, ID) bytes of each text's first ID bytes (null: none), and their lengths."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.minimum(np.diff(offsets), ID)
    inside = np.arange(ID) < lengths[:, None]
    out = np.zeros((len(texts), ID), np.uint8)
    out[inside] = data[(offsets[:-1, None] + np.arange(ID))[inside]]
    return out, lengths


def _texts(padded: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The texts again. Bytes that are no UTF-8, as where a text was cut, are replaced."""
    data = padded[np.arange(ID) < lengths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    if (data < 128).all():
        return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def _encode(b: pa.RecordBatch) -> np.ndarray:
    """The records of a batch with `_packed` fields."""
    out = np.zeros(b.num_rows, RECORD)
    numbers = b.column("_numbers").flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, len(NUMBERS))
    padded, lengths = _padded(b.column("_ids").flatten())
    padded, lengths = padded.reshape(-1, len(IDS), ID), lengths.reshape(-1, len(IDS))
    for i, n in enumerate(NUMBERS):
        out[n] = numbers[:, i]
    for i, n in enumerate(IDS):
        out[n], out[n + "_len"] = np.ascontiguousarray(padded[:, i]).view(f"V{ID}").ravel(), lengths[:, i]
    return out


def _binary(records: np.ndarray, lengths: np.ndarray | None = None) -> pa.Array:
    """Records as bytes, of each only the first `lengths`."""
    size = RECORD.itemsize
    if lengths is None or (lengths >= size).all():
        offsets, data = np.arange(len(records) + 1, dtype=np.int32) * size, records.tobytes()
    else:
        lengths = np.clip(lengths, 0, size)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        data = records.view(np.uint8).reshape(-1, size)[np.arange(size) < lengths[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _decode(records: pa.Array) -> list[pa.Array]:
    """The fields of whole records."""
    n_rows, records = len(records), records.cast(pa.large_binary())  # all of one length, so they follow one another
    first = int(np.frombuffer(records.buffers()[1], np.int64, 1, records.offset * 8)[0]) if n_rows else 0
    rows = np.frombuffer(records.buffers()[2] or b"", RECORD, n_rows, first) if n_rows else np.zeros(0, RECORD)
    arrays = [pa.array(rows[n].astype(np.int32 if n in INTS else np.int64)) for n in NUMBERS]
    for n in IDS:
        arrays.append(_texts(np.ascontiguousarray(rows[n]).view(np.uint8).reshape(-1, ID), np.minimum(rows[n + "_len"], ID).astype(np.int64)))
    return arrays


def _packed(events: DataFrame, *rest: str | Column) -> DataFrame:
    """rest, and an event's fields as two arrays, not twelve columns: after each row, Spark adds up the sizes of all columns of
    the batch that it fills for Python."""
    numbers = F.array(*[F.col(n).cast("long") if n in events.columns else F.lit(0).cast("long") for n in NUMBERS])
    return events.select(*rest, numbers.alias("_numbers"), F.array(*[F.col(n).cast("string") for n in IDS]).alias("_ids"))


def _rest(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in (*NUMBERS, *IDS)]


def _fields(schema: StructType) -> StructType:
    for n in NUMBERS:
        schema = schema.add(n, "integer" if n in INTS else "long")
    for n in IDS:
        schema = schema.add(n, "string")
    return schema


def encoded(events: DataFrame) -> DataFrame:
    """Every column of events but the fields, and `record`. Null numbers are 0, null ids empty; ids are cut to 32 bytes."""
    rest = _rest(events)
    schema = events.select(*rest).schema.add("record", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), _binary(_encode(b))], [*rest, "record"])

    return _packed(events, *rest).mapInArrow(run, schema)


def decoded(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with the fields of each; those of any other length are left out (see `rejects`)."""
    rest = [c for c in records.columns if c != record_col]
    schema = _fields(records.select(*rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *_decode(b.column(record_col))], [*rest, *NUMBERS, *IDS])

    return records.filter(F.octet_length(record_col) == RECORD.itemsize).select(*rest, record_col).mapInArrow(run, schema)


def carried(events: DataFrame, arriving: Column) -> DataFrame:
    """What `decoded` gives of `encoded` events of whose records only the first `arriving` bytes come through: every record is
    written, cut and read again, but in one worker, so that rows cross between Spark and Python once each way, not twice."""
    rest = _rest(events)
    schema = _fields(events.select(*rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = _binary(_encode(b), b.column("_arriving").to_numpy(zero_copy_only=False))
            got = pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), records], [*rest, "_record"])
            got = got.filter(pc.equal(pc.binary_length(records), RECORD.itemsize))
            yield pa.RecordBatch.from_arrays([*(got.column(c) for c in rest), *_decode(got.column("_record"))], [*rest, *NUMBERS, *IDS])

    return _packed(events, *rest, F.coalesce(arriving.cast("int"), F.lit(0)).alias("_arriving")).mapInArrow(run, schema)


def rejects(records: DataFrame, record_col: str = "record") -> DataFrame:
    return records.filter(F.coalesce(F.octet_length(record_col) != RECORD.itemsize, F.lit(True)))


def subscribed(spark: SparkSession, path: str, record_col: str = "record", schema: str = "source int, ingest_ns long, record binary", **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a stream of records, one to a row, from Parquet files as they arrive in a folder: with each
    record's source and time of arrival, as its transport gives them. For Kafka, give `decoded` its value column instead."""
    stream = spark.readStream.schema(schema).options(**options).parquet(path)
    return decoded(stream, record_col), rejects(stream, record_col)
