"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Items fall into classes of like length, by powers of two, so that a long
item doesn't widen the search for short ones. For each class, a document is split into passages: as many words as the
class's longest item has, before and after the n-grams that may occur in the class (a bitmap, which can only err by
letting more through). The n-grams found are joined to the items'; every n-gram of an item is a seed, however rare or
frequent. Frequency only deals the work: a seed of more than HOT passages is joined under several keys. Passage and item
that share a seed are aligned (match +2, mismatch -1, gap -1), unless the passage has too few of the item's words for any
alignment to do; the score over that of the item with itself is at least THRESHOLD for a leak. Copies without SEED
unchanged words in a row are not found.

Defined cases: null and empty texts, and items of fewer than SEED words, match nothing; rows that share an id count as
one document, whose best alignment with an item is reported, of equal ones the first and then the longest; rows without
an id count as one document whose id is null, and are kept by `decontaminated` even if they leak; items without an id are
left out; equal items are each reported; an empty table gives no rows; a very long text is cut into passages like any
other; further columns are ignored (by `leaks`) or kept (by `decontaminated`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .hashing import ALPHANUMERIC, WordHasher, ngrams
from .storage import tidy, written

SEED, THRESHOLD = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of up to so many words are one class; each further one goes up to twice as many.
SHORT = 64
#: Passages of a seed for each key that it is joined under.
HOT = 100_000
#: Hot seeds up to which their table is broadcast (about 20 bytes each).
HOT_ROWS = 200_000
ITEMS = "item long, n int, kind int, words binary, seeds array<long>"
PASSAGES = "passage string, doc long, kind int, start int, words binary, seeds array<long>"


def items_of(benchmark: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """ITEMS: hashes of each item's words and of its distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALPHANUMERIC)
        for b in batches:
            for words in hasher.blocks(b.column(1)):
                own = [words.hashes[i:j] for i, j in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                seeds = [np.unique(ngrams(w, seed)).view(np.int64) for w in own]
                kinds = [max(0, (len(w) - 1) // SHORT).bit_length() for w in own]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(words.first, len(own)), pa.array([len(w) for w in own], pa.int32()), pa.array(kinds, pa.int32()), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                    ["item", "n", "kind", "words", "seeds"],
                )

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("item is not null")
    return written(rows.mapInArrow(tidy(run), ITEMS).filter("size(seeds) > 0"), "items")


def kinds_of(items: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """The classes, no more than doublings of a length: each with its longest item's words, and a bitmap of bounded size of
    its n-grams."""
    rows = items.groupBy("kind").agg(F.max("n"), F.sum(F.size("seeds"))).collect()
    return {k: (longest, bitmaps.gathered(items.filter(F.col("kind") == k).select("seeds"), n)) for k, longest, n in rows}


def passages_of(docs: DataFrame, id_col: str, text_col: str, kinds: dict[int, tuple[int, np.ndarray]], seed: int) -> DataFrame:
    """PASSAGES: for each class, as many words as its longest item has, before and after n-grams that it may have;
    passages that meet are one."""
    shared = docs.sparkSession.sparkContext.broadcast(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALPHANUMERIC)
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        for b in batches:
            ids = b.column(0).to_pylist()
            for words in hasher.blocks(b.column(1)):
                grams = ngrams(words.hashes, seed)
                for k, (longest, bits) in shared.value.items():
                    at = np.flatnonzero(bitmaps.may_have(bits, grams))
                    doc = np.searchsorted(words.bounds, at, "right") - 1
                    whole = at + seed <= words.bounds[doc + 1]
                    at, doc = at[whole], doc[whole]
                    if not len(at):
                        continue
                    low = np.maximum(words.bounds[doc], at - longest)
                    high = np.minimum(words.bounds[doc + 1], at + seed + longest)
                    new = np.flatnonzero(np.concatenate([[True], (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])]))
                    ends = np.append(new[1:], len(at))
                    rows = [(uuid.uuid4().hex, ids[words.first + doc[i]], k, int(low[i] - words.bounds[doc[i]]), words.hashes[low[i] : high[j - 1]].tobytes(), np.unique(grams[at[i:j]]).view(np.int64)) for i, j in zip(new.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["passage", "doc", "kind", "start", "words", "seeds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(tidy(run), PASSAGES), "passages")


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair: the best local alignment's score, and the passage's words [from, to) that it covers."""
    n, m = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), n), np.uint64), np.ones((len(items), m), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    inside = np.arange(n)[None, :] < np.array([len(x) for x in items])[:, None]
    real = np.arange(m)[None, :] < np.array([len(y) for y in passages])[:, None]
    rows = np.arange(len(items))
    prior, begin = np.zeros((len(items), m + 1), np.int32), np.tile(np.arange(m + 1, dtype=np.int32), (len(items), 1))
    slide = (np.arange(m + 1) * -GAP).astype(np.int32)
    best, start, stop = np.zeros(len(items), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int32)
    for i in range(n):
        diagonal = prior[:, :-1] + np.where((b == a[:, i : i + 1]) & real & inside[:, i : i + 1], MATCH, MISMATCH)
        up = prior[:, 1:] + GAP
        own, came = np.zeros_like(prior), np.tile(np.arange(m + 1, dtype=np.int32), (len(items), 1))
        own[:, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        came[:, 1:] = np.where(own[:, 1:] == 0, came[:, 1:], np.where(diagonal >= up, begin[:, :-1], begin[:, 1:]))
        # gaps along the passage: the best score to the left less its distance; the place it came from rides along
        reach = (own + slide).astype(np.int64) * (m + 2) + np.arange(m + 1)
        top = np.maximum.accumulate(reach, axis=1)
        from_ = top % (m + 2)
        value = (top // (m + 2) - slide).astype(np.int32)
        better = value > own
        came = np.where(better, np.take_along_axis(came, from_, 1), came)
        own = np.maximum(own, value)
        here = own.argmax(1)
        gain = own[rows, here] > best
        best = np.where(gain, own[rows, here], best)
        start, stop = np.where(gain, came[rows, here], start), np.where(gain, here, stop)
        prior, begin = own, came
    return best, start, stop


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(id, item, score, start_word, end_word): each document's best alignment with each item it leaks."""
    items = items_of(benchmark, item_col, item_text, seed)
    passages = passages_of(docs, id_col, text_col, kinds_of(items), seed)
    found = passages.select("passage", "kind", F.explode("seeds").alias("seed"))
    grams = items.select("item", "kind", F.explode("seeds").alias("seed"))
    often = found.groupBy("kind", "seed").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = written(often.join(grams.select("kind", "seed").distinct(), ["kind", "seed"], "left_semi").select("kind", "seed", F.ceil(F.col("n") / HOT).alias("keys")), "hot")
    if hot.count() <= HOT_ROWS:
        hot = F.broadcast(hot)
    keys = F.coalesce("keys", F.lit(1))
    asked = found.join(hot, ["kind", "seed"], "left").select("passage", "kind", "seed", F.pmod(F.xxhash64("passage"), keys).alias("key"))
    seeds = grams.join(hot, ["kind", "seed"], "left").select("item", "kind", "seed", F.explode(F.sequence(F.lit(0).cast("long"), keys - 1)).alias("key"))
    pairs = written(asked.join(seeds, ["kind", "seed", "key"]).select("passage", "item").distinct(), "pairs")
    sides = pairs.join(passages.select("passage", "doc", "start", F.col("words").alias("q")), "passage").join(items.select("item", F.col("words").alias("p")), "item")
    schema = f"`{id_col}` long, `{item_col}` long, score double, start_word long, end_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in (4, 3))
            most = [MATCH * np.isin(x, y).sum() / (MATCH * len(x)) for x, y in zip(p, q, strict=True)]
            order = sorted((i for i in range(b.num_rows) if most[i] >= threshold), key=lambda i: len(q[i]))
            at = 0
            while at < len(order):  # groups of like length, of bounded cells
                end = at + 1
                while end < len(order) and (end - at + 1) * len(q[order[end]]) < 120_000:
                    end += 1
                group = order[at:end]
                best, start, stop = align([p[i] for i in group], [q[i] for i in group])
                score = best / np.array([MATCH * len(p[i]) for i in group])
                good = np.flatnonzero(score >= threshold)
                rows = pa.array([group[g] for g in good], pa.int64())
                before = b.column(2).take(rows).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(1).take(rows), b.column(0).take(rows), pa.array(score[good]), pa.array(before + start[good]), pa.array(before + stop[good])], [id_col, item_col, "score", "start_word", "end_word"])
                at = end

    aligned = sides.select("item", "doc", "start", "q", "p").mapInArrow(tidy(run), schema)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), F.col("end_word"))).alias("x")
    return aligned.groupBy(F.col(f"`{id_col}`"), F.col(f"`{item_col}`")).agg(best).select(f"`{id_col}`", f"`{item_col}`", "x.score", "x.start_word", "x.end_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that leak an item. Rows without an id stay; those that share one stay or go together."""
    found = written(leaks(docs, benchmark, id_col, **options).select(F.col(id_col).alias("_leaking")).distinct(), "leaking")
    return docs.join(found, docs[id_col] == found["_leaking"], "left_anti")
