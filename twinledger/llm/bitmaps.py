"""Bitmaps of bounded size over sets of 64-bit numbers (Bloom filters of two bits a number): what they don't hold is surely
not in the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix

#: A bitmap has 2^b bits: RICH for each number, so that one in 16,000 that is not in the set is let through, as long as b
#: is no more than the second of these; then POOR for each (one in 60), up to the third (128 MB).
BITS, RICH, POOR = (22, 28, 30), 256, 16
#: Ids beyond which rows are joined to them instead.
MOST = (1 << BITS[2]) // POOR


def bits_for(n: int) -> int:
    rich, poor = (int(k * n).bit_length() for k in (RICH, POOR))
    return int(np.clip(rich, BITS[0], BITS[1])) if poor <= BITS[1] else min(poor, BITS[2])


def _places(numbers: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = mix(numbers), np.uint64((1 << b) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def words_of(numbers: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a bitmap that numbers (uint64) set bits in, by place, and these bits."""
    at = np.unique(np.concatenate(_places(numbers, b)))
    words = at >> np.uint64(6)
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))[: len(at)]
    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
    return words[first].astype(np.int64), bits


def gathered(numbers: DataFrame, n: int) -> np.ndarray:
    """The packed bitmap of the one column of numbers, longs or arrays of them without nulls, n in all or about. No task
    holds more of it than a batch sets."""
    b = bits_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
            at, bits = words_of(flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), b)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64))], ["at", "bits"])

    out = np.zeros((1 << b) // 64, np.int64)
    for at, bits in numbers.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits")).toLocalIterator():
        out[at] = bits
    return out.view(np.uint8)


def may_have(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """False for numbers (uint64) that are not in the set."""
    first, second = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) for at in _places(numbers, len(bits).bit_length() + 2))
    return first & second & np.uint8(1) > 0


def among(rows: DataFrame, ids: DataFrame, most: int = MOST) -> tuple[DataFrame, Broadcast | None]:
    """(rows, bitmap): rows whose first column, a long, is one of the ids of the one column. The bitmap, for `sifted`, is
    what is still to be done in a task that reads the rows; beyond `most` ids it is None, and the rows are joined to them."""
    ids = ids.filter(F.col(ids.columns[0]).isNotNull()).distinct()
    n = ids.count()
    if n > most:
        return rows.join(ids.withColumnRenamed(ids.columns[0], rows.columns[0]), rows.columns[0], "left_semi"), None
    return rows, ids.sparkSession.sparkContext.broadcast(gathered(ids, n))


def sifted(batch: pa.RecordBatch, bits: Broadcast | None) -> pa.RecordBatch:
    """Those rows of a batch whose first column, a long, may be one of the ids of a bitmap (None: all rows)."""
    if bits is None:
        return batch
    x = batch.column(0)
    known = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return batch.filter(pa.array(may_have(bits.value, known) & x.is_valid().to_numpy(zero_copy_only=False)))
