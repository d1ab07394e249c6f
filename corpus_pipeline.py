"""A pipeline from raw documents to packed training sequences. Counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever these are, with further ones kept.

Defined cases, for every stage: an empty table gives an empty one; null and empty texts are kept by all filters but the
classifier, which scores them as empty texts and rejects them where it scores these so; rows without an id and repeated rows
are rows of their own, but of equal rows near-duplicates keeps one; very long texts are taken whole. Columns named like an
operator's results stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm import decontamination, neardup, packing, pii, quality
from twinledger.llm.queries import table
from twinledger.llm.storage import written

KEY = "_row_key"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Learnt from the labels whose crc32 of the id as text mod 4 is not 2."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = "_quality_score", "_quality_predicted"
    return quality.scored(docs, model, into=(score, predicted)).filter(F.col(predicted) == 1).drop(score, predicted)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, KEY, that stays as it is: ids may be null or repeated."""
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "rows")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest id, without an id only if all are. Of several rows
    with that id, that of the smallest hash of its text stays, and of equal ones any. Texts without words all stay."""
    docs = keyed(docs)
    groups = neardup.near_duplicates(docs, KEY).select(F.col("id").alias(KEY), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), KEY)
    stay = docs.select(KEY, order.alias("place")).join(groups, KEY).groupBy("component_id").agg(F.min("place").alias("least"))
    # keys alone are compared here: few rows go, so that few keys meet the texts
    gone = docs.select(KEY).join(written(stay.select(f"least.{KEY}"), "stay"), KEY, "left_anti")
    return docs.join(written(gone, "gone"), KEY, "left_anti").drop(KEY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go, each judged by its own text, whatever its id."""
    return decontamination.decontaminated(keyed(docs), table(spark, sf_dir, "benchmark"), KEY).drop(KEY)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars is set anew where a text changes."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences. A null or empty text is a piece of its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Training, minima, alignment and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
