"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov, and texts without the repetition.

A run is a stretch with smallest period q, of at least max(MIN_WORDS, MIN_POWER * q) words, that no neighbouring word
extends with that period. A zone of words is cut into Lempel-Ziv factors (each the longest stretch that also begins
earlier, or a new word) by walking its suffix automaton, whose states know where they first end. A run that touches a border
of factors is found there, at the last such border, as Main's algorithm finds it: for each period, how far the words before
and after the border agree with those a period away, from prefix tables of both sides. How far back a run can begin is
bounded by the factors before, so the tables are as long as these. A run that lies strictly inside a factor is a copy of
one where the factor occurs first.

Zones are where runs can lie: but for its first q words, each word of a run of period q occurred no more than q words
before, and these are at least (MIN_POWER - 1) * q words in a row. So for each power of two, stretches of words that
occurred no more than so many words before are long enough, or hold no run of a period up to it. That needs hashes of words
alone, as equal ones can only widen a zone; runs are found on the words themselves.

Defined cases: null and empty texts have no words, no runs and an empty rest. Repeated rows, and rows without an id, each
have a result; an empty table has none. A very long text is one task's, in memory for its words and, of a zone, about 300
bytes a word. Of runs with the same power the first counts as the greatest, then the one of the smallest period. Further
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WordHasher, seeded
from .storage import tidy

MIN_WORDS, MIN_POWER = 6, 4
RUNS = "runs array<struct<start: long, length: long, period: long>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class CasedHasher(WordHasher):
    """Hashes of words as they are."""

    def __init__(self):
        super().__init__()
        self.values = seeded(1, 256)


def zones(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches [from, to) of a block's words, each within a text, in which runs can lie. bounds: where texts begin and end."""
    n = len(hashes)
    if n < MIN_WORDS:
        return
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, doc))  # stable: equal words of a text by place
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    back = np.full(n, n + 1, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found = []
    longest = int(np.diff(bounds).max())
    for k in range(max(1, longest // MIN_POWER).bit_length() + 1):
        reach = 1 << k
        least = MIN_WORDS - 1 if not k else max((MIN_POWER - 1) * (reach // 2 + 1), MIN_WORDS - reach)
        near = np.concatenate([[False], back <= reach, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        if long.any():
            found.append(np.stack([np.maximum(starts[long] - reach, bounds[doc[starts[long]]]), ends[long]]))
    if not found:
        return
    starts, ends = np.concatenate(found, axis=1)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], (starts[1:] >= ends[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])])
    at = np.flatnonzero(new)
    yield from zip(starts[at].tolist(), ends[np.append(at[1:], len(starts)) - 1].tolist(), strict=True)


def factors(text: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors (from, to, where the same words began before; -1: a new word) of a text, by its suffix automaton."""
    follow: list[dict[int, int]] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(text):
        new, p = len(follow), last
        follow.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, at, n = [], 0, len(text)
    while at < n:
        state, to = 0, at
        while to < n:
            then = follow[state][text[to]]
            if first[then] >= to:  # these words end here for the first time
                break
            state, to = then, to + 1
        out.append((at, to, first[state] - (to - at) + 1) if to > at else (at, at + 1, -1))
        at = max(to, at + 1)
    return out


def prefix_table(of: list[int], most: int) -> list[int]:
    """How many words from each of the places 1 to most on agree with the first ones (the entry of place 0 is not meant)."""
    n = len(of)
    z, left, right = [0] * (most + 1), 0, 0
    for i in range(1, min(most, n - 1) + 1):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and of[i + k] == of[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreeing(prefix: list[int], z: list[int], text: list[int], most: int) -> list[int]:
    """How many words from each of the places 0 to most - 1 of text on agree with the first ones of prefix, whose table is z."""
    n, m, out = len(text), len(prefix), []
    left = right = 0
    for i in range(min(most, n)):
        k = min(z[i - left], right - i) if i < right and i > left else 0
        while i + k < n and k < m and text[i + k] == prefix[k]:
            k += 1
        out.append(k)
        if i + k > right:
            left, right = i, i + k
    return out


def runs_of(text: list[int]) -> list[tuple[int, int, int]]:
    """All runs (from, to, smallest period), by start, then period."""
    n, cuts = len(text), factors(text)
    found: dict[tuple[int, int], int] = {}
    from_: dict[int, list[tuple[int, int]]] = {}
    begins: list[int] = []

    def add(b: int, e: int, p: int) -> None:
        if (b, e) not in found:
            found[b, e] = p
            if b not in from_:
                from_[b] = []
                begins.insert(bisect_left(begins, b), b)
            from_[b].append((e, p))

    borders = [s for s, _, _ in cuts] + [n]
    for i in range(1, len(borders)):
        s, before, before2 = borders[i], borders[i - 1], borders[max(0, i - 2)]
        t = borders[i + 1] if i + 1 < len(borders) else n
        # 1. runs that touch the border s and end before t: see the bounds in `touching`
        for b, e, p in touching(text, before2, before, s, t):
            add(b, e, p)
        # 2. runs strictly inside the factor [s, t): copies
        if s < n and cuts[i][2] >= 0 and begins:
            d, at = s - cuts[i][2], bisect_left(begins, cuts[i][2] + 1)
            while at < len(begins) and begins[at] + d < t:
                b = begins[at]
                for e, p in from_[b]:
                    if e + d < t:
                        add(b + d, e + d, p)
                at += 1
    return sorted(((b, e, p) for (b, e), p in found.items()), key=lambda x: (x[0], x[2]))


def touching(text: list[int], before2: int, before: int, s: int, t: int) -> Iterator[tuple[int, int, int]]:
    """Runs [b, e) with b <= s <= e that end before t, the next border (or at the end of the text, if s is).

    before and before2 are the borders before s. As [before, s) and its next word occur for the first time, a run that goes
    beyond s begins after before - p; as 4p <= e - b, p < (t - before) / 3. A run that ends at s begins in the same way
    after before2 - p, and p < (s - before2) / 3. (With another MIN_POWER, that less one takes the place of 3.)
    """
    most = max(t - before - 1, s - before2 - 1) // (MIN_POWER - 1)
    if most < 1:
        return
    low = max(0, before2 - most)
    left, right = text[low:s][::-1], text[s:t]
    z_left, z_right = prefix_table(left, most), prefix_table(right, most)
    # words before the border against those p after: read backwards from p words behind it
    ahead = right[:most][::-1]
    behind = agreeing(left, z_left, ahead + left, len(ahead))
    # words from the border on against those p before
    back = min(most, len(left))
    onward = agreeing(right, z_right, left[:back][::-1] + right, back)
    least = MIN_POWER - 1
    seen = set()
    for p in range(1, most + 1):
        for b, e in (
            (s - behind[len(ahead) - p], s + (z_right[p] if p < len(right) else 0) + p) if p <= len(ahead) else (0, 0),
            (s - p - z_left[p], s + onward[back - p]) if p <= back else (0, 0),
        ):
            if e - b >= least * p + p and e - b >= MIN_WORDS and (e < t or s == t) and (b, e) not in seen:
                seen.add((b, e))  # a multiple of a period gives the same run
                yield b, e, p


def _found(hashes: np.ndarray, bounds: np.ndarray, words_of: Callable[[int], list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of a block."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for a, b in zones(hashes, bounds):
        doc = int(np.searchsorted(bounds, a, "right")) - 1
        first, numbers = int(bounds[doc]), {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words_of(doc)[a - first : b - first]]
        out[doc] += [(a - first + s, e - s, p) for s, e, p in runs_of(ids)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, but for those that some run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        kept += words[at : max(at, a)]
        at = max(at, b)
    return b" ".join(kept + words[at:])


def without_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arranged: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed): each text's runs by start, then period, and what is left of it.

    arranged: for an id and a number of words, the words in another order (as their numbers), or None: as they are.
    """
    schema = f"`{id_col}` long, n_words long, {RUNS}, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = CasedHasher()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for block in hasher.blocks(texts):
                n, hashes, words = len(block.bounds) - 1, block.hashes, {}
                moved = [arranged(ids[block.first + i], int(block.bounds[i + 1] - block.bounds[i])) if arranged else None for i in range(n)]
                if any(m is not None for m in moved):
                    hashes = np.concatenate([hashes[x:y] if m is None else hashes[x:y][m] for x, y, m in zip(block.bounds[:-1], block.bounds[1:], moved, strict=True)])

                def words_of(doc: int) -> list[bytes]:
                    if doc not in words:
                        own = (texts[block.first + doc].as_py() or "").encode().split()
                        words[doc] = own if moved[doc] is None else [own[i] for i in moved[doc].tolist()]
                    return words[doc]

                found = [sorted(x, key=lambda r: (r[0], r[2])) for x in _found(hashes, block.bounds, words_of)]
                rest = []
                for i, x in enumerate(found):
                    rest.append(collapsed(words_of(i), x).decode())
                    words.pop(i)
                counts = np.diff(block.bounds).astype(np.int64)
                runs = pa.array([[{"start": s, "length": k, "period": p} for s, k, p in x] for x in found], pa.list_(RUN))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, n), pa.array(counts), runs, pa.array(rest, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def greatest(runs: str = "runs") -> Column:
    """The run of the greatest power, compared exactly; of equal ones the first. Null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda top, x: top.isNull() | (x["length"] * top["period"] > top["length"] * x["period"])
    return F.aggregate(runs, none, lambda top, x: F.when(more(top, x), x).otherwise(top))


def digested(rows: DataFrame) -> DataFrame:
    """Rows of without_runs with the runs as a number, the greatest one's fields and a hash, and a hash of the rest."""
    line = lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))))
    top = F.col("top")
    others = [c for c in rows.columns if c not in ("n_words", "runs", "collapsed")]
    return rows.withColumn("top", greatest()).select(
        *others, F.size("runs").cast("long").alias("n_runs"), *[top[c].alias(c) for c in ("start", "length", "period")], F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
