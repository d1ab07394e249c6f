"""Token counts without materialised ids.

Texts fall into pre-tokens. Blocks of documents keep each document's pre-token frequencies and ask for the counts of
their distinct pre-tokens, dealt into buckets by ranges of their hashes; in its bucket each distinct pre-token of the
corpus is counted once; the answers are joined to the blocks, and frequencies times counts are summed. All of this
travels compressed. How many distinct pre-tokens the corpus has is estimated from sketches of the blocks, so that there
are as many buckets as keep each at PER_BUCKET of them, and a task's table is bounded whatever the input.

Defined cases: a null text is an empty one with no tokens; repeated rows and rows without an id each get a result; an
empty table gives none; a very long text is a block of its own, whose table holds its distinct pre-tokens; further
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokens
from .storage import written

BLOCK_BYTES = 24 << 20
#: A task holds the counts of about so many distinct pre-tokens, those of one bucket, at a time.
PER_BUCKET = 50_000
#: A longer pre-token is held as a digest.
LONG = 64
#: Registers of the sketch from which the number of distinct pre-tokens is estimated (to about 3 %).
REGISTERS = 1024
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCKS = "block long, ids binary, no_id binary, n_bytes binary, lengths binary, steps binary, times binary, pieces binary, sketch binary"


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32, byte by byte of their significance, compressed."""
    return zstandard.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def _numbers(squeezed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(squeezed), "u1").reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in names), np.uint64, len(names))


def _registers(hashes: np.ndarray) -> np.ndarray:
    """Of the hashes in each of REGISTERS ranges, the most leading zeros (plus one) of the rest: a HyperLogLog sketch."""
    rest = hashes & np.uint64((1 << 64) // REGISTERS - 1)
    zeros = 65 - REGISTERS.bit_length() - np.frexp(rest.astype(float))[1] + 1
    out = np.zeros(REGISTERS, np.uint8)
    np.maximum.at(out, (hashes // np.uint64((1 << 64) // REGISTERS)).astype(np.int64), np.clip(zeros, 1, 64).astype(np.uint8))
    return out


def _estimated(registers: np.ndarray) -> float:
    m = len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(0.5 ** registers.astype(float))
    empty = int((registers == 0).sum())
    return m * float(np.log(m / empty)) if raw <= 2.5 * m and empty else float(raw)


def distinct_pieces(blocks: DataFrame) -> float:
    """About how many distinct pre-tokens all blocks have. The driver gets REGISTERS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(REGISTERS, np.uint8)
        for b in batches:
            for sketch in b.column(0):
                most = np.maximum(most, np.frombuffer(sketch.as_py(), np.uint8))
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at].astype(np.int32))], ["at", "zeros"])

    out = np.zeros(REGISTERS, np.uint8)
    for at, zeros in blocks.select("sketch").mapInArrow(run, "at int, zeros int").groupBy("at").agg(F.max("zeros")).collect():
        out[at] = zeros
    return _estimated(out)


def _row(docs: list, asked: dict[str, int]) -> pa.RecordBatch:
    """One block. Its pre-tokens are numbered by hash; a document's are sorted and kept as steps from each to the next."""
    ids, sizes, pieces, times = zip(*docs, strict=True)
    names = list(asked)
    hashes = _hashes(names)
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    lengths = np.array([len(p) for p in pieces])
    doc = np.repeat(np.arange(len(docs)), lengths)
    pieces = number[np.concatenate(pieces)]
    within = np.lexsort((pieces, doc))
    steps = np.diff(pieces[within], prepend=0)
    first = np.diff(doc, prepend=-1) > 0
    steps[first] = pieces[within][first]
    packed = [
        np.array([i or 0 for i in ids], "<i8").tobytes(),
        np.array([i is None for i in ids], "?").tobytes(),
        np.array(sizes, "<i8").tobytes(),
        *map(_squeezed, (lengths, steps, np.concatenate(times)[within])),
    ]
    packed += [_listed([names[i] for i in order]), _registers(hashes).tobytes()]
    arrays = [pa.array([uuid.uuid4().int >> 65], pa.int64())] + [pa.array([x]) for x in packed]
    return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "no_id", "n_bytes", "lengths", "steps", "times", "pieces", "sketch"])


def _listed(pieces: list[str]) -> bytes:
    return zstandard.compress(json.dumps(pieces, ensure_ascii=False, separators=(",", ":")).encode())


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents of about BLOCK_BYTES: frequencies of its distinct pre-tokens, by document."""
    splitter = PreTokens.shared(vocabulary)
    docs, asked, held = [], {}, 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py() or ""
            found = Counter(splitter.split(text))
            pieces = np.fromiter((asked.setdefault(p, len(asked)) for p in found), "<i4", len(found))
            n = len(text.encode())
            docs.append((i, n, pieces, np.fromiter(found.values(), "<i4", len(found))))
            held += n + 100
            if held > BLOCK_BYTES:
                yield _row(docs, asked)
                docs, asked, held = [], {}, 0
    if docs:
        yield _row(docs, asked)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInArrow(lambda batches: _blocks(batches, vocabulary), BLOCKS), "blocks")
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(distinct_pieces(blocks) / PER_BUCKET) + 1)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pieces = json.loads(zstandard.decompress(packed.as_py()))
                of = ((_hashes(pieces) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                kinds, starts = np.unique(of, return_index=True)
                ends = [*starts[1:].tolist(), len(pieces)]
                parts = [_listed(pieces[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)] if pieces else []
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array(kinds, pa.int32()), pa.array(parts, pa.binary())], ["block", "bucket", "pieces"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, bucket, known = PreTokens.shared(vocabulary), None, {}
        for b in batches:
            told = []
            for k, packed in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                pieces = json.loads(zstandard.decompress(packed.as_py()))
                n = np.empty(len(pieces), np.int64)
                for i, p in enumerate(pieces):
                    key = p if len(p) <= LONG else xxhash.xxh3_128_digest(p.encode())
                    if key not in known:
                        known[key] = splitter.count(p)
                    n[i] = known[key]
                told.append(_squeezed(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.binary())], ["block", "bucket", "told"])

    # the questions of a bucket meet, so each pre-token is counted once; each block is told in the order in which it asked
    together = blocks.select("block", "pieces").mapInArrow(asked, "block long, bucket int, pieces binary").repartition("bucket").sortWithinPartitions("bucket")
    told = together.mapInArrow(counted, "block long, bucket int, told binary")
    answers = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "told")))["told"].alias("answers"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, no_id, sizes = (np.frombuffer(b.column(i)[r].as_py(), t) for i, t in enumerate(("<i8", "?", "<i8")))
                lengths, steps, times = (_numbers(b.column(i)[r].as_py()) for i in (3, 4, 5))
                per = np.concatenate([np.zeros(0, np.int64), *map(_numbers, b.column(6)[r].as_py() or [])])
                ends = np.cumsum(lengths)
                run = np.concatenate([[0], np.cumsum(steps)])
                pieces = run[1:] - np.repeat(run[ends - lengths], lengths)
                total = np.concatenate([[0], np.cumsum(per[pieces] * times)])
                n = total[ends] - total[ends - lengths]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=no_id), pa.array(sizes), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    whole = blocks.drop("pieces", "sketch").join(answers, "block", "left").drop("block")
    return whole.mapInArrow(summed, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
