"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped around their usual forms.

Each word gives a key for itself, and two for each place: the word without that code point, as a word (what another word may
be that lacks it), and as a pattern of that place (what another word is too that has another code point there). Keys come
from polynomial hashes of the prefix and the suffix around a place, sums of a batch's code points in numpy. Keys and numbers
of words are parted by the keys' high bits and sorted, so equal keys meet; words travel only where two of them meet, and
are compared there as strings, since keys may collide.

No pairs are made within a bucket. Words of one pattern are all near each other, no more of them than there are code
points: each gets their count less one, and the best of the others. A word and those that have one code point more are a
star: a row for each end of its rays. So rows stay within twice the number of near pairs, whatever is frequent. A key's
rows are one task's: as many as words of the vocabulary that are one code point away from one string.

Defined cases: null and empty texts have no words; a row without an id counts its words like any other (an edit sees the id
None); repeated rows count again; an empty table gives none. A very long text is counted as it is read; words of any length
are taken whole. Of near words with the same count the smallest in code-point order is the form. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, powers
from .storage import forget, tidy, written

#: Words are runs of these, of which only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, FEWEST = 6, 5
#: A near word is a word's form if it occurs so many times as often.
TIMES = 5
#: Distinct words that a task holds while it counts.
HELD = 200_000
#: Characters of a text from which on its words are not listed before they are counted.
LONG = 1 << 20
BASE = 0x9E3779B97F4A7C15
RADIX_BITS = 16


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, shortest: int = SHORTEST, fewest: int = FEWEST, edit: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): the words of all texts that have the length and occur often enough. Counted in each task first.

    edit: what a text's word (its id, the word) is counted as; called once for each distinct word of a text.
    """
    lower = letters.replace("A-Z", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, counts = re.compile(lower + "+"), Counter()

        def flushed() -> pa.RecordBatch:
            rows = [(w, n) for w, n in counts.items() if len(w) >= shortest]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = (text.as_py() or "").encode().lower().decode()  # of bytes, only A-Z become others
                own = Counter(word.findall(text) if len(text) < LONG else (m[0] for m in word.finditer(text)))
                if edit is None:
                    counts.update(own)
                else:
                    for w, n in own.items():
                        counts[edit(i, w)] += n
                if len(counts) > HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


#: What a key stands for, besides the places of patterns (from 0 on): the word itself, and below it the word without one place.
ITSELF = -1


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the word, what it stands for) of all keys of words. Equal strings have equal keys."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    of, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    up = powers(BASE, int(lengths.max(initial=0)) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(1)) * up[at])])
    start, end = total[ends - lengths], total[ends]
    # the prefix before each place, and the suffix after it moved to where the prefix ends
    prefix = total[:-1] - start[of]
    suffix = (end[of] - total[1:]) * np.uint64(pow(BASE, -1, 1 << 64))
    salt = mix(lengths.astype(np.uint64) * np.uint64(2))
    without = prefix + suffix
    itself = mix(end - start + salt)
    shorter = mix(without + mix((lengths - 1).astype(np.uint64) * np.uint64(2))[of])
    pattern = mix(without + mix(at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + salt[of])
    # a code point like that before it leaves the same word
    first = np.concatenate([[True], points[1:] != points[:-1]])[: len(points)] | (at == 0)
    key = np.concatenate([itself, shorter[first], pattern])
    return key, np.concatenate([np.arange(len(words)), of[first], of]), np.concatenate([np.full(len(words), ITSELF), ITSELF - 1 - at[first], at])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        sizes = np.cumsum([len(w) + 64 for w in words])
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 19), "right")))
            key, of, stands = keys_of(words[at:to])
            for i in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (key.view(np.int64), ids[at:to][of], stands.astype(np.int32))], ["key", "id", "stands"])
            at = to


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys that two words have, one of them the word itself, or both as a pattern."""
    held = None
    for b in batches:
        now = [b.column(i).to_numpy() for i in range(3)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        key = held[0]
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
        out, held = [x[:last] for x in held], [x[last:] for x in held]
        if last:
            yield _several(*out)
    if held is not None and len(held[0]):
        yield _several(*held)


def _several(key: np.ndarray, ids: np.ndarray, stands: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    good = (sizes > 1) & ((np.add.reduceat(stands >= 0, starts) > 1) | np.logical_or.reduceat(stands == ITSELF, starts))
    rows = np.repeat(good, sizes)
    return pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, ids, stands)], ["key", "id", "stands"])


NEAR = "id long, near long, best_n long, best_word string, best_id long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, stands, id, word, n) sorted by key, then from the words themselves to what stands for less: for each word how many
    near ones it meets under a key, and the best of them. Words are compared, not keys."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in NEAR.split(", ")]
    here, wholes, patterns, out = None, {}, {}, []

    def finish() -> None:
        for same in patterns.values():
            if len(same) > 1:
                first, second = sorted(same)[:2]
                out.extend((i, len(same) - 1, -m, w, j) for _, _, i in same for m, w, j in [second if i == first[2] else first])

    def batch() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) if out else [()] * len(types)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    for b in batches:
        for key, stands, i, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != here:
                finish()
                here, wholes, patterns = key, {}, {}
            if stands == ITSELF:
                wholes[word] = i, n
            elif stands < ITSELF:
                at = ITSELF - 1 - stands
                rest = word[:at] + word[at + 1 :]
                if rest in wholes:
                    j, m = wholes[rest]
                    out += [(i, 1, m, rest, j), (j, 1, n, word, i)]
            else:
                patterns.setdefault((stands, word[:stands], word[stands + 1 :]), []).append((-n, word, i))
            if len(out) > 1 << 16:
                yield batch()
    finish()
    yield batch()


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of words (id, word, n), distinct, those that have near words, with how many and the best one
    as a struct of n, word and id."""
    keys = words.select("id", "word").mapInArrow(tidy(_keys), "key long, id long, stands int")
    parted = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    met = parted.mapInArrow(_meeting, "key long, id long, stands int")
    named = met.join(words, "id").select("key", "stands", "id", "word", "n", F.when(F.col("stands") == ITSELF, 0).otherwise(1).alias("_order"))
    beside = named.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "_order").drop("_order")
    found = beside.mapInArrow(tidy(_near), NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best_word", "best_id")).alias("best")
    found = found.groupBy("id").agg(F.sum("near").alias("n_near"), best)
    return found.select("id", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.best_word").alias("word"), F.col("best.best_id").alias("id")).alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, root) that make no circle: where following them ends. Each round doubles how far."""
    links = written(links, "links")
    while True:
        onward = links.select(F.col("id").alias("at"), F.col("root").alias("then"))
        further = written(links.join(onward, F.col("root") == F.col("at"), "left").select("id", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "further")
        forget(links)
        moved = not further.filter("moved").isEmpty()
        links = further.drop("moved")
        if not moved:
            return links


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each once. form: the near word that occurs most often, if
    that is `times` as often or more; root: the last of the forms of forms."""
    words = written(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    near = written(near_words(words), "near")
    formed = near.join(words.select("id", "n"), "id").filter(F.col("best.n") >= times * F.col("n"))
    forms = written(formed.select("id", F.col("best.word").alias("form"), F.col("best.n").alias("form_n"), F.col("best.id").alias("form_id")), "forms")
    roots = roots_of(forms.select("id", F.col("form_id").alias("root")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(near.select("id", "n_near"), "id", "left").join(forms.drop("form_id"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
