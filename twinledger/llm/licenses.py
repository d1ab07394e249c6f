"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A template's blocks are all runs of neighbouring words of a text, line ends ignored, as wide as twice the template's
words or WIDE, whichever is more: one starts at each word. A template's label applies where a block holds at least
THRESHOLD of its distinct tokens. Tokens are ordered by their document frequency over the whole corpus, rarest first. Of
a template with n tokens, of which a must be met, a block that matches holds one of the n - a + 1 first (prefix filter;
as a block whose rarest token stands at place p of the template's order holds n - p + 1 of them at most, this is the
positional filter too, templates being contained in blocks and not the other way round). Only words as near to one of
these as a block is wide are looked at, and of them only those in blocks with a of the template's tokens, counted with
repeats (length filter). Their distinct tokens are counted exactly, for all blocks in one pass over the words' comings
and goings. Texts are joined where they are read; templates come in parts of at most PART tokens, or of one template that
has more, each a pass. The templates are whole short licenses, the notices of longer ones, and single sentences that stand
for a license by themselves.

Defined cases: a null or wordless text has no words, places or labels, and score 0; repeated rows and rows without an id
get a result each; an empty table gives none; without templates only phrases count; a very long text takes memory for its
own words; of several blocks that match a template the best counts; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .hashing import ALPHANUMERIC, WordHasher, Words

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    *license_texts.WHOLE,
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under a creative commons attribution share alike license", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved no part of this publication may be reproduced without permission", "all-rights-reserved"),
)
THRESHOLD, WIDE, PART = 0.8, 64, 4096


def hashed(phrases: list[str]) -> list[np.ndarray]:
    out = []
    for words in WordHasher(ALPHANUMERIC).blocks(pa.array(phrases, pa.string())):
        out += [words.hashes[a:b].copy() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return out


def frequencies(docs: DataFrame, text_col: str, tokens: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted tokens occurs. The driver gets at most a row for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(ALPHANUMERIC), np.zeros(len(tokens), np.int64)
        for b in batches:
            for words in hasher.blocks(b.column(0)):
                at, token = members(words.hashes, tokens)
                doc = np.searchsorted(words.bounds, at, "right")
                total += np.bincount(np.unique(doc * len(tokens) + token) % len(tokens), minlength=len(tokens))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["token", "n"])

    out = np.zeros(len(tokens), np.int64)
    for token, n in docs.select(text_col).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


def members(hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in hashes, places in tokens) of the hashes that are among the sorted tokens."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
    at = np.flatnonzero(tokens[found] == hashes)
    return at, found[at]


class Templates:
    """Templates as token sets over one sorted vocabulary, with prefixes by the corpus order."""

    def __init__(self, tokens: np.ndarray, sets: list[np.ndarray], lengths: list[int], labels: list[str], frequency: np.ndarray, threshold: float):
        self.tokens, self.labels = tokens, labels
        self.rank = np.empty(len(tokens), np.int64)
        self.rank[np.lexsort((tokens, frequency))] = np.arange(len(tokens))
        self.sizes = np.array([len(s) for s in sets])
        self.least = np.array([max(1, math.ceil(threshold * n - 1e-9)) for n in self.sizes])
        self.width = np.maximum(WIDE, 2 * np.array(lengths))
        self.has = np.zeros((len(sets), len(tokens)), bool)
        self.prefix = np.zeros((len(sets), len(tokens)), bool)
        for i, s in enumerate(sets):
            order = s[np.argsort(self.rank[s])]
            self.has[i, order] = True
            self.prefix[i, order[: len(order) - self.least[i] + 1]] = True
        self.any_prefix = self.prefix.any(0)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, template, largest share of its tokens in a block) of each document and template that match."""
        at, token = members(words.hashes, self.tokens)
        none, out = np.zeros(0, np.int64), []
        keep = near(at, at[self.any_prefix[token]], self.width.max())
        at, token = at[keep], token[keep]
        for i in range(len(self.labels) if len(at) else 0):
            own, width = self.has[i, token], self.width[i]
            place, kind = at[own], token[own]
            keep = near(place, at[self.prefix[i, token]], width)
            place, kind = place[keep], kind[keep]
            starts = place[np.searchsorted(place, place + width) - np.arange(len(place)) >= self.least[i]]
            if not len(starts):
                continue
            keep = place - starts[np.maximum(np.searchsorted(starts, place, "right") - 1, 0)] < width
            keep &= place >= starts[0]
            place, kind = place[keep], kind[keep]
            # a token counts in the blocks that end from its place on, until it comes again, leaves them or the text ends
            until = np.minimum(place + width, words.bounds[np.searchsorted(words.bounds, place, "right")])
            order = np.lexsort((place, kind))
            again = order[:-1][kind[order[1:]] == kind[order[:-1]]]
            until[again] = np.minimum(until[again], place[order[1:]][kind[order[1:]] == kind[order[:-1]]])
            met = np.arange(1, len(place) + 1) - np.searchsorted(np.sort(until), place, "right")
            good = np.flatnonzero(met >= self.least[i])
            document = np.searchsorted(words.bounds, place[good], "right") - 1
            first = np.flatnonzero(np.diff(document, prepend=-1))
            if len(first):
                out.append((document[first], np.full(len(first), i), np.maximum.reduceat(met[good], first) / self.sizes[i]))
        if not out:
            return none, none, none.astype(float)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near(places: np.ndarray, marks: np.ndarray, width: int) -> np.ndarray:
    """Which of the places are less than width away from one of the sorted marks."""
    if not len(marks):
        return np.zeros(len(places), bool)
    after = np.searchsorted(marks, places)
    return (marks[np.minimum(after, len(marks) - 1)] - places < width) & (after < len(marks)) | (places - marks[np.maximum(after - 1, 0)] < width) & (after > 0)


def places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """Word indexes at which the phrase's words stand consecutively in one document."""
    k = len(phrase)
    at = np.flatnonzero(words.hashes[: max(0, len(words.hashes) - k + 1)] == phrase[0])
    for j in range(1, k):
        at = at[words.hashes[at + j] == phrase[j]]
    return at[np.searchsorted(words.bounds, at, "right") == np.searchsorted(words.bounds, at + k - 1, "right")]


def templates(docs: DataFrame, text_col: str, given: tuple[tuple[str, str], ...], threshold: float) -> list[Templates]:
    given = [(h, label) for h, (_, label) in zip(hashed([t for t, _ in given]), given, strict=True) if len(h)]
    tokens = np.unique(np.concatenate([h for h, _ in given])) if given else np.zeros(0, np.uint64)
    frequency = frequencies(docs, text_col, tokens) if given else tokens
    parts, held = [[]], 0
    for h, label in given:
        if parts[-1] and held + len(h) > PART:
            parts.append([])
            held = 0
        parts[-1].append((h, label))
        held += len(h)
    out = []
    for part in parts:
        if part:
            own = np.unique(np.concatenate([h for h, _ in part]))
            out.append(Templates(own, [np.searchsorted(own, np.unique(h)) for h, _ in part], [len(h) for h, _ in part], [label for _, label in part], frequency[np.searchsorted(tokens, own)], threshold))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, known: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    parts = templates(docs, text_col, known, threshold)
    wanted = [(h, label) for h, (_, label) in zip(hashed([p for p, _ in phrases]), phrases, strict=True) if len(h)]
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALPHANUMERIC)
        for b in batches:
            for words in hasher.blocks(b.column(1)):
                n = len(words.bounds) - 1
                n_base, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
                base: dict[int, set[str]] = {}
                more: dict[int, set[str]] = {}
                score = np.zeros(n)
                for phrase, label in wanted:
                    at = places(words, phrase)
                    doc = np.searchsorted(words.bounds, at, "right") - 1
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(first, doc, at - words.bounds[doc])
                    np.maximum.at(last, doc, at - words.bounds[doc])
                    for d in np.unique(doc).tolist():
                        base.setdefault(d, set()).add(label)
                for part in parts:
                    doc, which, share = part.matches(words)
                    np.maximum.at(score, doc, share)
                    for d, i in zip(doc.tolist(), which.tolist(), strict=True):
                        more.setdefault(d, set()).add(part.labels[i])
                score[list(base)] = 1.0
                none = n_base == 0
                of = lambda d, *sets: ",".join(sorted(set().union(*(s.get(d, ()) for s in sets))))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(words.first, n),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(n_base),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([of(d, base) for d in range(n)], pa.string()),
                        pa.array([of(d, base, more) for d in range(n)], pa.string()),
                        pa.array(score),
                    ],
                    names,
                )

    schema = f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
