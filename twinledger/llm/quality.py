"""A quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, word shapes, and how words repeat) are scaled by the log ratio of their smoothed
counts in the two classes; a linear hinge-loss model over them is fitted by dual coordinate descent, and its margin
becomes a probability by a logistic fit on examples kept apart. Fitted on a bounded sample (SAMPLE per class, those of
smallest hash of the id) of the labelled rows; applied to all rows. The driver holds the sample's indicators, no texts.

Defined cases: a null text is an empty one, scored by the model's bias; rows without id are scored and count as not
held out; labels without id or label are left out, and of several for one document the lowest counts; without examples
of both classes the score is the share of label 1, or 0.5 without labels; repeated rows get a result each; a very long
text takes memory for its own words only; `scored` keeps further columns, but for those named as its results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SPACED, WordHasher, Words, mix
from .storage import in_small_batches, tidy

BITS = 18
SAMPLE = 4000
ACCEPT = 0.7
LETTER, UPPER, DIGIT, SIGN = 1, 2, 4, 8


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] |= LETTER
    kinds[65:91] |= UPPER
    kinds[48:58] |= DIGIT
    kinds[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:!?'\"()-"]] |= SIGN
    return kinds


BYTE_KINDS = _byte_kinds()


def features(words: Words) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each document of a block."""
    h, starts, ends, bounds = words.hashes, words.starts, words.ends, words.bounds
    size = ends - starts
    kinds = BYTE_KINDS[words.data]
    counts = [np.concatenate([[0], np.cumsum(kinds & k > 0)]) for k in (UPPER, DIGIT, SIGN)]
    upper, digit, sign = (c[ends] - c[starts] if len(c) > 1 else size for c in counts)
    last = words.data[ends - 1] if len(h) else np.zeros(0, np.uint8)
    ending = np.where((last < 128) & ((last < 48) | (last > 57) & (last < 65) | (last > 90) & (last < 97) | (last > 122)), last, 0).astype(np.uint64)
    first_upper = (kinds[starts] & UPPER) > 0 if len(h) else np.zeros(0, bool)
    shape = np.minimum(upper, 3).astype(np.uint64) * 2 + first_upper + np.uint64(8) * np.minimum(digit, 3).astype(np.uint64) + np.uint64(32) * np.minimum(sign, 4).astype(np.uint64)
    shape = (shape * np.uint64(8) + np.minimum(np.log2(size + 1), 7).astype(np.uint64)) * np.uint64(128) + ending
    same = np.zeros(len(h), np.uint64)  # whether a word is that before it, or the one before that
    for d in (1, 2):
        same[d:] |= (h[d:] == h[:-d]).astype(np.uint64) << np.uint64(d - 1)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))  # of a word in its own text
    same[place == 0] = 0
    same[place == 1] &= np.uint64(1)
    streams = [h, mix(shape + np.uint64(1 << 40)), mix(same + np.uint64(1 << 41))]
    own = (h >> np.uint64(64 - BITS)).astype(np.int32)
    table = [own]
    for stream, orders in zip(streams, ((2,), (1, 2, 3), (1, 3, 6)), strict=True):
        for n in orders:
            g = stream.copy()
            for j in range(1, n):
                g[j:] = g[j:] * np.uint64(0x9E3779B97F4A7C15) + stream[:-j]
            g = ((mix(g + np.uint64(n)) if n > 1 else g) >> np.uint64(64 - BITS)).astype(np.int32)
            table.append(np.where(place < n - 1, own, g))  # no n-gram reaches into the text before
    table = np.stack(table)
    tallies = [np.concatenate([[0], np.cumsum(x)]) for x in (same > 0, upper >= np.maximum(2, size // 2), sign > 0, first_upper, ending > 0, size > 14)]
    mark = np.zeros(1 << BITS, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mark[:] = False
        mark[table[:, a:b].ravel()] = True
        for i, t in enumerate(tallies):  # shares over the text, in steps
            step = int(np.ceil(8 * (t[b] - t[a]) / (b - a))) if b > a else 9
            mark[zlib.crc32(b"share%d:%d" % (i, step)) >> (32 - BITS)] = True
        mark[zlib.crc32(b"words%d" % int(np.log2(b - a + 1))) >> (32 - BITS)] = True
        yield np.flatnonzero(mark).astype(np.int32)


class Model(NamedTuple):
    weights: np.ndarray  # of an indicator in a text of norm 1: ratio times the hinge model's weight
    squares: np.ndarray  # of an indicator's ratio, for the norm
    bias: float
    slope: float
    shift: float

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum(dtype=float) / np.sqrt(self.squares[x].sum(dtype=float) + 1e-9) + self.bias for x in rows])

    def scores(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, n: int, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum of cost * hinge loss, by dual coordinate descent; the bias is a last feature of value 1."""
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(y))
    norms = np.array([v @ v for v in values]) + 1
    random = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in random.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[x] += d * v
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def fitted(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """labels 0 and 1. weights: how many documents each example stands for, used for the probabilities alone."""
    n = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(rows)) % 5 == 0
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = False
    own = np.flatnonzero(~apart)
    p, q = (np.bincount(np.concatenate([rows[i] for i in own if labels[i] == c]), minlength=n) + 1.0 for c in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [(v := ratio[rows[i]]) / np.sqrt(v @ v + 1e-9) for i in own]
    y = np.where(labels[own] == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias = hinge([rows[i] for i in own], values, y, cost, n)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    kept = np.flatnonzero(apart) if apart.any() else own
    x, t, c = model.margins(rows[i] for i in kept), labels[kept].astype(float), weights[kept]
    # targets short of 0 and 1, as few examples cannot prove more
    t = np.where(t == 1, 1 - 1 / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        g = np.array([(c * (t - z) * x).sum(), (c * (t - z)).sum()]) - 1e-3 * theta
        s = c * z * (1 - z)
        hessian = np.array([[(s * x * x).sum(), (s * x).sum()], [(s * x).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, g)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return model._replace(slope=float(theta[0]), shift=float(theta[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fitted on the labelled documents whose crc32(id as text) mod 4 is not 2, at most `sample` of each class."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1) and crc32(cast(id as string)) % 4 != 2")
    own = own.groupBy("id").agg(F.min("y").alias("y"))
    totals = dict(own.groupBy("y").count().collect())
    chosen = [own.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in sorted(totals)]
    if not chosen:
        return fitted([], np.zeros(0), np.zeros(0))
    ids = chosen[0] if len(chosen) == 1 else chosen[0].unionAll(chosen[1])
    picked = {r["id"]: r["y"] for r in ids.collect()}  # 2 * sample rows at most
    wanted = np.array(sorted(picked), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for b in batches:
            ids = b.column(0)
            mine = np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), wanted) & ids.is_valid().to_numpy(zero_copy_only=False)
            if mine.any():
                b = b.filter(pa.array(mine))
                for words in hasher.blocks(b.column(1)):
                    rows = [x.tobytes() for x in features(words)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(words.first, len(rows)), pa.array(rows, pa.binary())], ["id", "features"])

    in_small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(ids.select("id")), "id", "left_semi").mapInArrow(tidy(run), "id long, features binary")
    once = found.groupBy("id").agg(F.min("features").alias("features"))  # of documents with the same id, one
    rows = {r["id"]: np.frombuffer(bytes(r["features"]), np.int32) for r in once.toLocalIterator()}
    order = sorted(rows, key=lambda i: zlib.crc32(b"order%d" % i))
    y = np.array([picked[i] for i in order])
    share = {c: totals[c] / max(1, int((y == c).sum())) for c in totals}
    return fitted([rows[i] for i in order], y, np.array([share[c] for c in y.tolist()], float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score and whether it reaches accept (1 or 0), in columns of the names `into`, in place of such ones."""
    kept = [c for c in docs.columns if c not in into]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(into[0], "double").add(into[1], "integer")
    shared = in_small_batches(docs.sparkSession).sparkContext.broadcast((model.weights, model.squares, model.bias, model.slope, model.shift))  # 2 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHasher(SPACED), Model(*shared.value)
        for b in batches:
            for words in hasher.blocks(b.column(text_col)):
                s = own.scores(features(words))
                part = b.slice(words.first, len(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= accept).astype(np.int32))], [*kept, *into])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(tidy(run), schema)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per document."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    out = scored(rows, train(docs, labels, id_col, text_col))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", "predicted")
