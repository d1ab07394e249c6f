"""Late events applied afterwards, beside a stream of the two-stage mode that dropped them.

A query records all events, each batch in a folder of its number, and marks those that come when the watermark has passed
them. A job, run as often as is wanted, goes through the orders that have such events again and writes amendments: rows to
add, and rows to take back, that the stream gave for want of the late ones. What a stream gives for an order after that lacks
them too; the next run amends it. So rows and amendments together are, up to the watermark, those of the batch form.

The record must have the same batches as the stream, or smaller ones (the same source, trigger and limits): within one batch
no event is late for another. A record of a shorter delay than the stream's marks more events, which is safe.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MS, ReconConfig
from ..operators.amendments import amendments
from .processors import DIVERGENCES

CHANGES = DIVERGENCES + ", change long, upto long"


def _passed(top: int | None, delay_ns: int) -> int | None:
    """The last time that the watermark has passed, of the largest time seen; Spark counts milliseconds, events microseconds."""
    return None if top is None else max(0, top // MS - delay_ns // MS) * MS + 999


def _top(spark: SparkSession, path: str, batch: int) -> int | None:
    """The largest time of all batches up to one."""
    return spark.read.schema("top long").parquet(f"{path}/tops/batch={batch}").first()[0] if batch >= 0 else None


def recorded(events: DataFrame, path: str, checkpoint: str, delay_ns: int = 1000 * MS, **trigger: Any) -> StreamingQuery:
    """Starts the query that records a stream of events below `path`, with a column late. A batch that is run again takes the
    place of its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _top(spark, path, number - 1)
        passed = _passed(before, delay_ns)
        late = F.lit(False) if passed is None else F.col("ingest_ns") <= passed
        at = f"{path}/events/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").parquet(at)
        tops = spark.read.schema(batch.schema).parquet(at).agg(F.greatest(F.max("ingest_ns"), F.lit(before).cast("long")).alias("top"))
        tops.coalesce(1).write.mode("overwrite").parquet(f"{path}/tops/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def amend(spark: SparkSession, path: str, given: DataFrame, out: str, delay_ns: int = 1000 * MS, config: ReconConfig = ReconConfig()) -> DataFrame:
    """Writes, below `out`, the amendments that events recorded so far ask for beyond earlier ones, and gives all of them
    (CHANGES). given: what the stream has written. A run after the same last batch takes the place of its own amendments, so that frames
    of the run before are then out of date."""
    batches = spark.read.schema("top long, batch long").parquet(f"{path}/tops")
    last = batches.agg(F.max("batch")).first()[0]
    top = _top(spark, path, last)
    spark.createDataFrame([], CHANGES).drop("upto").write.mode("ignore").parquet(f"{out}/upto=-1")
    earlier = spark.read.schema(CHANGES).parquet(out).filter(F.col("upto") < last).drop("upto")
    history = spark.read.parquet(f"{path}/events").drop("batch")
    names = [x.split()[0] for x in DIVERGENCES.split(", ")]
    so_far = given.select(*names, F.lit(1).cast("long").alias("change")).unionAll(earlier.select(*names, "change"))
    passed = _passed(top, delay_ns)
    found = amendments(history, so_far, 0 if passed is None else passed, config)
    found.select(*names, "change").write.mode("overwrite").parquet(f"{out}/upto={last}")
    return spark.read.schema(CHANGES).parquet(out)
