"""Near-duplicate documents by b-bit MinHash.

A document is the set of its 5-word shingles. Of K minima, bands of R make bucket keys; the low two bits of each go into
a packed signature whose bit counts, corrected for chance agreement, estimate the similarity of two documents that
share a bucket. Pairs within five standard errors of the threshold are confirmed on their full shingle sets, and the
links' connected components are the groups.

Whole at every group size without a row for each pair of a group: equal sets collapse first; in each bucket all members
meet its smallest one; only members whose components still differ after that are compared with the rest of their bucket.
There, blocks of strays meet blocks of members: a task holds the signatures of two blocks, and of the pairs that come
within five standard errors by the first signature and by a second one of many more minima of one bit, it gives a row for
each document with the numbers of its partners, not one for each pair. Then each block's shingle sets come together, each
once, and of the links that they confirm only those are given that join something. With 32 bands of 4, a pair at the
threshold shares no bucket with probability 5e-6, more similar pairs less.

Defined cases: null and wordless texts have no shingles and are alone. Repeated rows and equal texts are one group;
rows that share an id are one node, linked as any of their texts is, and each gets a result row. A row without an id is
alone, with a null component, and is kept. An empty table gives no rows. A very long text takes memory for its own set.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .components import components
from .hashing import SHINGLE, WordHasher, mix, seeded, shingle_sets
from .storage import forget, tidy, written

BANDS, ROWS, BITS = 32, 4, 2
THRESHOLD, MARGIN = (75, 100), 0.25
#: Minima of the second signature, of one bit each.
LONG = 2048
#: Documents, and bytes of their shingle sets, that a block has at most, or about.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
SIGNATURE = "n_shingles long, set_key binary, packed array<long>, bands array<long>"


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(len(sets), k) minima of k hash functions over non-empty sets."""
    a, b = seeded(11, k), seeded(12, k)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    joined, out = np.concatenate(sets), np.empty((k, len(sets)), np.uint64)
    scratch = np.empty_like(joined)
    for i in range(k):
        np.multiply(joined, a[i], out=scratch)
        scratch += b[i]
        out[i] = np.minimum.reduceat(scratch, at)
    return out.T


def pack(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of minima side by side in 64-bit words."""
    per = 64 // bits
    low = (low & np.uint64((1 << bits) - 1)).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_key, packed, bands) per document; all but the first two null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weights = WordHasher(), seeded(13, rows)
        for b in batches:
            for words in hasher.blocks(b.column(1)):
                sets = list(shingle_sets(words, shingle))
                full = [i for i, s in enumerate(sets) if len(s)]
                packed, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    m = minima([sets[i] for i in full], bands * rows)
                    band = (m.reshape(len(full), bands, rows) * weights).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                    for i, p, k in zip(full, pack(mix(m)).view(np.int64), mix(band).view(np.int64), strict=True):
                        packed[i], keys[i] = p, k
                digests = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(words.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "set_key", "packed", "bands"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), f"id long, {SIGNATURE}")


def long_signatures(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, k: int = LONG) -> DataFrame:
    """(id, long): one bit of each of k minima, for the documents among ids that have shingles."""

    texts, sieve = bitmaps.among(_texts(docs, id_col, text_col), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, several = WordHasher(), 256
        for b in batches:
            b = bitmaps.sifted(b, sieve)
            for words in hasher.blocks(b.column(1)):
                sets = list(shingle_sets(words, shingle))
                full = [i for i, s in enumerate(sets) if len(s)]
                of = b.column(0).slice(words.first, len(sets))
                for at in range(0, len(full), several):
                    some = full[at : at + several]
                    bits = pack(mix(minima([sets[i] for i in some], k)), 1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([of.take(pa.array(some)), pa.array(list(bits), pa.list_(pa.int64()))], ["id", "long"])

    return texts.mapInArrow(tidy(run), "id long, long array<long>").join(ids, "id", "left_semi")


def estimate(a: str, b: str, k: int = BANDS * ROWS) -> Column:
    """Similarity from two packed signatures of two bits a minimum: agreement less what chance gives."""
    odd = 0x5555555555555555

    def unequal(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))

    agree = 1 - sum((unequal(i) for i in range(k * BITS // 64)), F.lit(0)) / k
    return (agree - 0.5**BITS) / (1 - 0.5**BITS)


def blocks_of(n: Column, shingles: Column) -> Column:
    """How many blocks so many documents with so many shingles make."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(8 * shingles / BLOCK_BYTES)).cast("long")


def _of_block(i: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(i), blocks)


def _by_unit(rows: Iterator[tuple], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow one another with the same first `size` fields, together."""
    here, held = None, []
    for row in rows:
        if row[:size] != here:
            if held:
                yield here, held
            here, held = row[:size], []
        held.append(row[size:])
    if held:
        yield here, held


UNIT = "unit long, block long"
ASKED = f"{UNIT}, id long, c long, others array<long>"


def linked(asked: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b), written: of the pairs (id, one of others) of ASKED, those whose full shingle sets meet the threshold, but for
    pairs whose components c links of the same unit and block have joined. All documents of a pair are asked for in its
    unit and block. A task holds the sets of one block of a unit, each once."""
    texts, sieve = bitmaps.among(_texts(docs, id_col, text_col), asked.select("id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            b = bitmaps.sifted(b, sieve)
            for words in hasher.blocks(b.column(1)):
                own = [s.tobytes() for s in shingle_sets(words, shingle)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(words.first, len(own)), pa.array(own, pa.binary())], ["id", "shingles"])

    part, whole = threshold

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common > 0 and whole * common >= part * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, unit in _by_unit(rows, 2):
            own, of, partners, joined, found = {}, {}, {}, {}, []

            def root(c: int) -> int:
                while joined.get(c, c) != c:
                    joined[c] = joined.get(joined[c], joined[c])
                    c = joined[c]
                return c

            for i, c, others, shingles in unit:
                own.setdefault(i, {})[shingles] = np.frombuffer(shingles, np.uint64)
                of[i] = c
                partners.setdefault(i, set()).update(others)
            for i in sorted(partners):
                for j in sorted(partners[i]):
                    c, d = root(of[i]), root(of[j])
                    if c != d and any(near(x, y) for x in own[i].values() for y in own[j].values()):
                        joined[max(c, d)] = min(c, d)
                        found.append((i, j))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = asked.join(texts.mapInArrow(tidy(sets), "id long, shingles binary"), "id").select("unit", "block", "id", "c", "others", "shingles")
    found = together.repartition("unit", "block").sortWithinPartitions("unit", "block").mapInArrow(tidy(run), "a long, b long")
    return written(found.distinct(), "links")


def with_leaders(stars: DataFrame) -> DataFrame:
    """ASKED of pairs (a, b, n) of a leader and a member of n shingles: blocks of members, each with the leader."""
    sizes = stars.groupBy("a").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    members = stars.join(sizes, "a").select(F.col("a").alias("unit"), _of_block(F.col("b"), F.col("blocks")).alias("block"), F.col("b").alias("id"), F.col("b").alias("c"), F.array("a").alias("others"))
    leaders = members.select("unit", "block").distinct().select("unit", "block", F.col("unit").alias("id"), F.col("unit").alias("c"), F.array().cast("array<long>").alias("others"))
    return members.unionAll(leaders)


def crossing(rest: DataFrame, least: float, long_least: float) -> DataFrame:
    """ASKED of the pairs that are still to be confirmed in buckets that are not one component.

    rest: (band, id, c, main, n, packed, bands, long), all members of such buckets but the leaders; those whose component c is not
    the leader's, main, are strays. Each block of a bucket's strays meets each block of its members. A pair is asked for in
    the first bucket that both have: where that is none of these, it has met as leader and member, or its components are one.
    """
    stray = F.col("c") != F.col("main")
    of_strays = lambda x: F.sum(F.when(stray, x).otherwise(0))
    sizes = rest.groupBy("band").agg(blocks_of(of_strays(F.lit(1)), of_strays(F.col("n"))).alias("left"), blocks_of(F.count("*"), F.sum("n")).alias("right"))
    rows = rest.join(sizes, "band").select(F.col("band").alias("unit"), "id", "c", "main", "left", "right", "packed", "bands", "long")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda i, j: i * F.col("right") + j
    at = [F.when(stray, F.transform(every("right"), lambda j: F.struct(place(_of_block(F.col("id"), F.col("left")), j).alias("block"), F.lit(True).alias("asks"))))]
    at += [F.transform(every("left"), lambda i: F.struct(place(i, _of_block(F.col("id"), F.col("right"))).alias("block"), F.lit(False).alias("asks")))]
    places = F.concat(F.coalesce(at[0], F.array().cast("array<struct<block:bigint,asks:boolean>>")), at[1])
    dealt = rows.withColumn("p", F.explode(places)).select("unit", "p.block", "p.asks", "id", "c", "main", "packed", "bands", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (unit, block), held in _by_unit(rows, 2):
            strays, members = [x for x in held if x[0]], [x for x in held if not x[0]]
            if not strays or not members:
                continue
            partners = {}
            for i, j in _likely(unit, strays, members, least, long_least):
                partners.setdefault(strays[i][1:3], []).append(members[j][1])
                partners.setdefault(members[j][1:3], [])
            out = [(unit, block, *i, others) for i, others in partners.items()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.list_(pa.int64())], strict=True)], ["unit", "block", "id", "c", "others"])

    return dealt.repartition("unit", "block").sortWithinPartitions("unit", "block").mapInArrow(tidy(run), ASKED)


def _likely(band: int, strays: list[tuple], members: list[tuple], least: float, long_least: float) -> Iterator[tuple[int, int]]:
    """Places of pairs of rows (asks, id, c, main, packed, bands, long) that are to be confirmed in this bucket."""
    ids, c, main, packed, bands, long = zip(*[x[1:] for x in members], strict=True)
    ids, c, main = (np.array(x, np.int64) for x in (ids, c, main))
    packed, bands, long = (np.array(x, np.int64).view(np.uint64) for x in (packed, bands, long))
    odd, k = np.uint64(0x5555555555555555), packed.shape[1] * 64 // BITS
    step = max(1, (1 << 20) // len(members))
    for at in range(0, len(strays), step):
        some = strays[at : at + step]
        own = [np.array(x, np.int64) for x in zip(*[x[1:3] for x in some], strict=True)]
        words, keys, longer = (np.array(x, np.int64).view(np.uint64) for x in zip(*[x[4:] for x in some], strict=True))
        unequal = np.zeros((len(some), len(members)), np.int32)
        for w in range(packed.shape[1]):
            x = words[:, w, None] ^ packed[None, :, w]
            unequal += np.bitwise_count((x | (x >> np.uint64(1))) & odd)
        alike = (1 - unequal / k - 0.5**BITS) / (1 - 0.5**BITS)
        i, j = np.nonzero((alike >= least) & (own[1][:, None] != c[None, :]) & ((c == main)[None, :] | (own[0][:, None] < ids[None, :])))
        for p in range(0, len(i), 1 << 16):
            x, y = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            good = 1 - 2 * np.bitwise_count(longer[x] ^ long[y]).sum(1, dtype=np.int64) / (long.shape[1] * 64) >= long_least
            x, y = x[good], y[good]
            same = keys[x] == bands[y]
            once = keys[x, same.argmax(1)].view(np.int64) == band
            yield from zip((at + x[once]).tolist(), y[once].tolist(), strict=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept), written: groups of documents linked by similarity >= threshold[0] / threshold[1]."""
    signed = written(signatures(docs, id_col, text_col, shingle), "signatures")
    named = signed.filter("id is not null and set_key is not null")
    # one representative for equal sets; a hot set is reduced before the shuffle
    first = F.first(F.struct("packed", "bands", F.col("n_shingles").alias("n"))).alias("s")
    reps = written(named.groupBy("set_key").agg(F.min("id").alias("rep"), first).select("set_key", "rep", "s.packed", "s.bands", "s.n"), "representatives")
    least = threshold[0] / threshold[1] - MARGIN
    exploded = reps.select("rep", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last")
    buckets = written(shared.select("band", "leader"), "buckets")
    members = written(exploded.join(buckets, "band"), "members")
    forget(buckets)
    packed = reps.select("rep", "packed", "bands", "n")

    def with_estimates(pairs: DataFrame) -> DataFrame:
        p = packed.select(F.col("rep").alias("a"), F.col("packed").alias("p"))
        q = packed.select(F.col("rep").alias("b"), F.col("packed").alias("q"), "n")
        return pairs.join(p, "a").join(q, "b").select("a", "b", "n", estimate("p", "q").alias("likely")).filter(F.col("likely") >= least)

    stars = written(with_estimates(members.filter("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()), "stars")
    asked = written(with_leaders(stars), "asked")
    links = linked(asked, docs, id_col, text_col, shingle, threshold)
    forget(stars, asked)
    groups = written(components(links), "components")
    # what is not yet one component in some bucket: all strays against all others of that bucket
    labelled = members.join(groups, F.col("rep") == F.col("node"), "left").select("band", "rep", "leader", F.coalesce("component", "rep").alias("c"))
    labelled = written(labelled, "labelled")
    mixed = written(labelled.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).filter("c1 < c2 and n > 2").select("band"), "mixed")
    rest = labelled.filter("rep > leader").join(mixed, "band").join(packed, "rep")
    rest = written(rest.join(groups, F.col("leader") == F.col("node"), "left").select("band", F.col("rep").alias("id"), "c", F.coalesce("component", "leader").alias("main"), "n", "packed", "bands"), "rest")
    forget(members, labelled, mixed)
    longer = written(long_signatures(docs, rest.select("id").distinct(), id_col, text_col, shingle), "longer")
    t = threshold[0] / threshold[1]
    asked = written(crossing(rest.join(longer, "id"), least, t - 5 * ((1 - t * t) / LONG) ** 0.5), "asked")
    forget(rest, longer)
    if not asked.isEmpty():
        found = linked(asked, docs, id_col, text_col, shingle, threshold)
        if not found.isEmpty():
            first_groups, groups = groups, written(components(links.unionAll(found)), "components")
            forget(first_groups)
        forget(found)
    forget(asked, links)
    several = named.join(reps.select("set_key", "rep"), "set_key").filter("id != rep").select(F.col("id").alias("node"), F.col("rep"))
    return _result(signed, reps, groups, several)


def _result(signed: DataFrame, reps: DataFrame, groups: DataFrame, copies: DataFrame) -> DataFrame:
    """A row for each of signed, written. copies: (node, rep) of equal sets."""
    moved = copies.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    of = written(groups.unionAll(moved), "of")
    # an id that stands for several sets joins what these belong to
    double = of.groupBy("node").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    if not double.filter("c1 < c2").isEmpty():
        double = components(of.select(F.col("node").alias("a"), F.col("component").alias("b"))).select("node", F.col("component").alias("c1"))
    own = written(double.select("node", F.col("c1").alias("component")), "own")
    out = signed.select("id", "n_shingles").join(own, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    out = written(out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")), "groups")
    forget(signed, reps, groups, of, own)
    return out
