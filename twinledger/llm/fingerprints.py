"""Document fingerprints: threshold-scaled sketches.

A text's fingerprint keeps every hash of its word shingles below one fixed fraction of the hash range. As the bound is
the same for all texts, fingerprints can be merged by union, and containment is estimated without bias between a page
and a book. Sets of at most WHOLE shingles are kept whole (marked `=`), so that two of these are compared exactly; beside
a larger one only their hashes below the bound count. With n shingles of which a share c is contained, the estimate's
standard error is about sqrt(c (1 - c) / (FRACTION n)), and with none below the bound, as happens to (1 - FRACTION)^n of
small sets (51 % of those with 5 shingles, 20 % with 12, 0.02 % with 64), nothing is known: `likeness` is None then.

Defined cases: a null text is an empty one; a text without words has the empty set, which is like itself (1.0) and
unlike all others (0.0); a text of fewer than five words has its whole sequence as its one shingle. Repeated rows each
get their own result, rows without an id too (they come last, ordered by text), as do rows of one id (ordered by text);
an empty table gives none; a very long text takes memory in proportion to its own length. Further columns are ignored by
`compare_with_next` and kept by `fingerprints`, but for one of the name of its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SHINGLE, WordHasher, shingle_sets

FRACTION, WHOLE = 1 / 8, 64
NO_ID = -(1 << 63)


class Sketch(NamedTuple):
    """Sorted distinct hashes: all of a set if `whole`, else those below the bound."""

    hashes: np.ndarray
    whole: bool


def below(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    return hashes[: np.searchsorted(hashes, np.uint64(int(fraction * (1 << 64)) - 1), "right")]


def retained(hashes: np.ndarray, fraction: float = FRACTION) -> Sketch:
    """The sketch of a sorted set of hashes."""
    return Sketch(hashes.copy(), True) if len(hashes) <= WHOLE else Sketch(below(hashes, fraction).copy(), False)


def text_form(sketch: Sketch) -> str:
    return "=" * sketch.whole + sketch.hashes.astype(">u8").tobytes().hex()


def from_text(form: str) -> Sketch:
    return Sketch(np.frombuffer(bytes.fromhex(form.removeprefix("=")), ">u8").astype(np.uint64), form.startswith("="))


def merged(a: Sketch, b: Sketch, fraction: float = FRACTION) -> Sketch:
    """The sketch of both sets together: the same as if it were made from their union."""
    both = np.union1d(a.hashes, b.hashes)
    return retained(both, fraction) if a.whole and b.whole else Sketch(below(both, fraction), False)


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float | None:
    """Estimated share of the smaller set that the other contains, exact for two whole ones. None: nothing is known."""
    if any(s.whole and not len(s.hashes) for s in (a, b)):
        return float(a.whole and b.whole and len(a.hashes) == len(b.hashes))
    x, y = (s.hashes if a.whole and b.whole else below(s.hashes, fraction) for s in (a, b))
    # a whole set is the smaller one, however many of its hashes lie below the bound
    n = min(len(x), len(y)) if a.whole == b.whole else len(x) if a.whole else len(y)
    return len(np.intersect1d(x, y, assume_unique=True)) / n if n else None


def sketches(hasher: WordHasher, texts: pa.Array, fraction: float, shingle: int) -> list[Sketch]:
    return [retained(s, fraction) for block in hasher.blocks(texts) for s in shingle_sets(block, shingle)]


def fingerprints(docs: DataFrame, text_col: str = "text", fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """docs with a column `fingerprint`, in one pass without a shuffle."""
    schema = docs.drop("fingerprint").schema.add("fingerprint", "string")
    names = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            forms = [text_form(s) for s in sketches(hasher, b.column(text_col), fraction, shingle)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(forms, pa.string())], [*names, "fingerprint"])

    return docs.select(*[docs[n] for n in names]).mapInArrow(run, schema)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, copy, id, text), dealt so that each bucket holds a range of ids in descending order and then, with
    copy = 1, the document that follows its last one; the very last is followed by the very first. Null ids come last.

    One shuffle of the texts. The driver holds four cuts and largest ids per shuffle partition, no more.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = docs.select("k")
    m = 4 * n  # so that buckets spread evenly over the partitions
    cuts = np.unique(np.array(ids.approxQuantile("k", [i / m for i in range(1, m)], min(0.01, 0.2 / m)), float).astype("int64"))

    @F.pandas_udf("int")
    def bucket(k):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "left"), dtype="int32")

    largest = sorted((r[0], r[1]) for r in ids.groupBy(bucket("k").alias("b")).agg(F.max("k")).collect())
    follows = np.array(sorted((k, largest[(i + 1) % len(largest)][0]) for i, (_, k) in enumerate(largest)), "int64").reshape(-1, 2)

    @F.pandas_udf("int")
    def also(k):
        import pandas as pd

        at = np.minimum(np.searchsorted(follows[:, 0], k.to_numpy()), len(follows) - 1)
        return pd.Series(np.where(follows[at, 0] == k.to_numpy(), follows[at, 1], -1), dtype="int32")

    if not largest:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("copy"), "id", "k", "text")
    places = F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("copy")), F.struct(F.col("c").alias("bucket"), F.lit(1).alias("copy")))
    both = docs.withColumns({"b": bucket("k"), "c": also("k")}).withColumn("p", F.explode(F.filter(places, lambda x: x["bucket"] >= 0)))
    dealt = both.select("p.bucket", "p.copy", "id", "k", "text").repartition(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "copy", F.desc("k"), F.desc("text"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document by descending id.

    In the edited text the last third of the code points gives way to the first as many of the next document. Where
    nothing is known of a likeness (a small text beside a large one, none of its hashes below the bound), it is 0.
    """
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held = None  # the last row so far: its bucket, copy, id, text and sketch
        for b in batches:
            buckets, copies, ids = (b.column(i).to_pylist() for i in range(3))
            texts, own = b.column(4), sketches(hasher, b.column(4), fraction, shingle)
            # pieces of the batch, so that edited texts are held for a few MB at a time
            step = max(1, int(len(ids) * (4 << 20) / max(1, texts.nbytes)))
            for i in range(0, len(ids), step):
                part = texts.slice(i, step).to_pylist()
                rows = list(zip(buckets[i : i + step], copies[i : i + step], ids[i : i + step], [t or "" for t in part], own[i : i + step], strict=True))
                pairs = list(zip(([held] if held else []) + rows[:-1], rows if held else rows[1:], strict=True))
                pairs = [(x, y) for x, y in pairs if not x[1] and x[0] == y[0]]
                held = rows[-1]
                edited = [x[3][: len(x[3]) - len(x[3]) // 3] + y[3][: len(x[3]) // 3] for x, y in pairs]
                theirs = sketches(hasher, pa.array(edited, pa.large_string()), fraction, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([text_form(x[4]) for x, _ in pairs], pa.string()),
                        pa.array([text_form(s) for s in theirs], pa.string()),
                        pa.array([likeness(x[4], s, fraction) or 0.0 for (x, _), s in zip(pairs, theirs, strict=True)], pa.float64()),
                        pa.array([likeness(x[4], y[4], fraction) or 0.0 for x, y in pairs], pa.float64()),
                    ],
                    [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return beside_next(docs, id_col, text_col).mapInArrow(run, schema)
