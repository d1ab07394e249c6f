"""What late events change: orders that have any are gone through again, and rows that were given in error are amended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from . import orders

#: What a divergence says.
DIVERGENCE = ("order_key", "detect_ns", "mask", "type", "p_status", "p_cum_qty", "p_avg_px", "d_status", "d_cum_qty", "d_avg_px")


def changes(found: DataFrame, given: DataFrame) -> DataFrame:
    """(DIVERGENCE, change): how many more of each row there are in found than in given, negative if fewer; equal ones are
    left out. given may have a column change itself: how often each of its rows counts.

    One aggregation over both, so that each side is reduced before the shuffle and no key's rows meet in one task.
    """
    times = F.col("change") if "change" in given.columns else F.lit(1)
    both = found.select(*DIVERGENCE, F.lit(1).cast("long").alias("change")).unionAll(given.select(*DIVERGENCE, (-times).cast("long")))
    return both.groupBy(*DIVERGENCE).agg(F.sum("change").alias("change")).filter("change != 0")


def amendments(history: DataFrame, given: DataFrame, through_ns: int | None = None, config: ReconConfig = ReconConfig(), sizes: DataFrame | None = None) -> DataFrame:
    """(DIVERGENCE, change) by which given, rows of the two-stage mode, differs from what all events of history make up to
    `through_ns` (None: all), for orders with a late event (column late).

    Orders without one are neither read again nor compared. sizes: as for orders.parted, which a hot order needs.
    """
    late = history.filter("late").select("order_key").distinct()
    events = history.drop("late").join(late, "order_key", "left_semi")
    found = orders.two_stage(orders.views(orders.lifecycle(orders.parted(events, sizes=sizes), True)), config).filter("emitted")
    given = given.join(late, "order_key", "left_semi")
    if through_ns is not None:
        found, given = (x.filter(F.col("detect_ns") <= through_ns) for x in (found, given))
    return changes(found, given)


def net(given: DataFrame, amended: DataFrame) -> DataFrame:
    """given with the amendments applied: each row as often as it now holds."""
    both = given.select(*DIVERGENCE, F.lit(1).cast("long").alias("change")).unionAll(amended.select(*DIVERGENCE, "change"))
    sums = both.groupBy(*DIVERGENCE).agg(F.sum("change").alias("change")).filter("change > 0")
    return sums.select(*DIVERGENCE, F.explode(F.array_repeat(F.lit(0), F.col("change").cast("int"))).alias("_")).drop("_")
