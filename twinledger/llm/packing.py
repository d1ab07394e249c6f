"""Packing documents into sequences by non-negative least squares over length combinations.

Each document's ids, an end mark added, are cut into whole windows and one rest. The histogram of piece lengths has one
bin for each length up to the window, whatever the corpus holds. Shallow combinations of lengths that fill a window
(one, two or three pieces) are enumerated; repeat counts that best explain the histogram are solved for by non-negative
least squares and rounded down; what remains is packed greedily, largest first, again by length and not by piece.
Pieces then take their slots by their rank among pieces of equal length. No text is shuffled.

Defined cases: a null or empty text is a piece of the end mark alone; repeated rows and rows without an id are packed
each; an empty table gives no pieces; a very long text is encoded whole and cut; of equal lengths pieces come in any order;
further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import PreTokens
from .storage import tidy, written
from .tokencounts import VOCABULARY

WINDOW, END = 2048, 1
PIECES = "id long, start long, length int, ids_crc32 long, doc_tokens long, part string, place long"


def combinations(histogram: np.ndarray, window: int, wide: int = 160) -> list[tuple[int, ...]]:
    """Combinations of at most three of the lengths present that fill the window; for triples, two of the three are
    among the `wide` most frequent lengths below the window."""
    present = set(np.flatnonzero(histogram).tolist())
    out = [(window,)] if window in present else []
    out += [(a, window - a) for a in present if a >= window - a and window - a in present]
    common = [int(x) for x in np.argsort(-histogram, kind="stable")[:wide] if histogram[x] and x < window]
    triples = {tuple(sorted((a, b, window - a - b), reverse=True)) for i, a in enumerate(common) for b in common[i:] if window - a - b in present}
    return out + sorted(triples, reverse=True)


def least_squares(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - histogram|, by accelerated projected gradients.

    A has a row for each length and, in each column, how often a pattern uses it.
    """
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([length for p in patterns for length in p])
    h = histogram.astype(float)
    uses = np.bincount(row, minlength=len(h))
    step = 1 / max(1.0, float(3 * uses.max()))  # |A|^2 is at most the largest column sum times the largest row sum
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = np.bincount(row, y[column], len(h)) - h
        new = np.maximum(0, y - step * np.bincount(column, gap[row], len(patterns)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths side by side, repeats)] that uses every piece of the histogram (index: length) exactly once."""
    left = histogram.astype(np.int64).copy()
    out = []
    patterns = combinations(left, window)
    solved = least_squares(patterns, left)
    for i in np.argsort(-solved, kind="stable"):
        p = patterns[i]
        need = np.unique(p, return_counts=True)
        n = min(int(solved[i]), int((left[need[0]] // need[1]).min()))
        if n > 0:
            left[need[0]] -= n * need[1]
            out.append((p, n))
    lengths = np.flatnonzero(left)
    while len(lengths):
        fill, room, taken = [], window, {}
        while room > 0:
            fit = lengths[: np.searchsorted(lengths, room, "right")][::-1]
            best = next((int(x) for x in fit if left[x] > taken.get(int(x), 0)), None)
            if best is None:
                break
            fill.append(best)
            taken[best] = taken.get(best, 0) + 1
            room -= best
        n = min(int(left[x]) // k for x, k in taken.items())
        for x, k in taken.items():
            left[x] -= n * k
        out.append((tuple(fill), n))
        lengths = lengths[left[lengths] > 0]
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, window: int, end: int) -> DataFrame:
    """PIECES, written: place is a piece's rank among those of its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last = PreTokens.shared(vocabulary), end.to_bytes(4, "little")
        part, seen = uuid.uuid4().hex, [0] * (window + 1)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = splitter.encoded(text.as_py() or "") + last
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    k = len(piece) // 4
                    rows.append((i, at, k, zlib.crc32(piece), n, part, seen[k]))
                    seen[k] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(tidy(run), PIECES), "pieces")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    cut = pieces(docs, id_col, text_col, vocabulary, window, end)
    by_part = written(cut.groupBy("part", "length").count(), "by_part")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("count")).collect():  # at most a row for each length
        histogram[length] = n
    # slots by length: the first rank that each takes, its first sequence and its offset there
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = dict.fromkeys(range(window + 1), 0), 0
    for fill, n in plan(histogram, window):
        offset = 0
        for length in fill:
            slots.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    tables = {length: np.array(s, np.int64).T for length, s in slots.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                mine, (first, base, at) = length == k, tables[int(k)]
                slot = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[slot] + rank[mine] - first[slot], at[slot]
            arrays = [b.column(0), b.column(1), pa.array(length.astype(np.int64)), b.column(3), b.column(4), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(starts.hint("merge"), ["part", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(placed, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
