"""Running aggregates and folds by key in which many tasks can share a key.

A key's rows fall into parts that follow one another in its order. What came before a part is found from one row for each
part, so a task sorts and holds one part of a key at a time, not the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

KINDS = ("last", "max", "sum")


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], part: Column | None = None, inclusive: bool = True) -> DataFrame:
    """rows with a column for each of values: the last value that is not null, the largest, or the sum, over the key's rows
    up to each one (not inclusive: before it; then null, or 0 for a sum, for the first).

    part: a number of which the key's order never makes less; without it, a key is one task's.
    """
    names, key = list(values), [F.col(k) for k in keys]
    given = {f"_{n}": v for n, (_, v) in values.items()}
    over = {"last": lambda c, w: F.last(c, ignorenulls=True).over(w), "max": lambda c, w: F.max(c).over(w), "sum": lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))}
    upto = (Window.unboundedPreceding, 0 if inclusive else -1)
    if part is None:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(*upto)
        return rows.withColumns(given).withColumns({n: over[kind](F.col(f"_{n}"), w) for n, (kind, _) in values.items()}).drop(*[f"_{n}" for n in names])
    rows = rows.withColumn("_part", part)
    total = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order))), "max": F.max, "sum": F.sum}
    parts = rows.withColumns(given).groupBy(*key, "_part").agg(*[total[kind](F.col(f"_{n}")).alias(f"_{n}") for n, (kind, _) in values.items()])
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "_part", *[over[kind](F.col(f"_{n}"), before).alias(f"_before_{n}") for n, (kind, _) in values.items()])
    # of what a window sorts by, the first column is compared fastest, and parts are more than keys
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(*upto)
    both = {
        "last": lambda n: F.coalesce(over["last"](F.col(f"_{n}"), inside), F.col(f"_before_{n}")),
        "max": lambda n: F.greatest(over["max"](F.col(f"_{n}"), inside), F.col(f"_before_{n}")),
        "sum": lambda n: over["sum"](F.col(f"_{n}"), inside) + F.col(f"_before_{n}"),
    }
    # values are worked out again behind the shuffle, which need not carry them then
    joined = rows.repartition(*key, "_part").join(parts, [*keys, "_part"]).withColumns(given)
    return joined.withColumns({n: both[kind](n) for n, (kind, _) in values.items()}).select(*[c for c in rows.columns if c != "_part"], *names)


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, together: bool = False) -> DataFrame:
    """fold over batches of rows sorted by key, then order; all rows of a key are one task's. together: they are already, as
    after a window or a join over some of the keys, so that rows need not be shuffled again."""
    return (rows if together else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with their number, from 0, in one order of all. Rows that are equal in it are numbered in any order.

    Ranges of the order are sorted each by itself, and written; how many rows are before a range is found from one row for
    each. So no task holds more than a range, unless a third of all rows are equal in the order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = place.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id() % (1 << 33)})
    place = written(place, "ranges")
    ranges = place.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # as many rows as there are ranges
    return place.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each block (those with the same first `size` fields), in order."""
    here, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:size] != here:
                if held:
                    yield here, held
                here, held = row[:size], []
            held.append(row[size:])
    if held:
        yield here, held
