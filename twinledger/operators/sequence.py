"""Sequence tracking: every arrival against the largest number seen before, gaps opened and closed.

A tracker may hold most rows, so whatever runs along one is taken by parts of its arrivals (see `running`).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..schema import DROPCOPY, DUPLICATE, GAP, GAP_DROPCOPY, GAP_FILL, GAP_PRIMARY, OUT_OF_ORDER, PRIMARY
from ..storage import written
from .running import folded, in_blocks, running

TRACKER = ("source", "session_id")
#: Arrivals (or units of arrival) of a part.
BLOCK = 65_536
#: A gap closed by hand, among the kinds of rows that the fold sees.
BY_HAND = 4
#: How a gap closed; null while it is open.
FILLED, EXTENSION_TIMEOUT, OPEN_TIMEOUT, CLOSED_BY_HAND = range(4)
FOREVER = 1 << 62


def classify(feed: DataFrame, block: int = BLOCK) -> DataFrame:
    """feed with last_seen, expected_seq and kind (null: first or in order; a gap fill is out of order here)."""
    rows = running(feed, list(TRACKER), ["arrival", "seq"], {"last_seen": ("max", F.col("seq"))}, F.expr(f"arrival div {block}"), inclusive=False)
    seq, last = F.col("seq"), F.col("last_seen")
    kind = F.when(seq > last + 1, GAP).when(seq == last, DUPLICATE).when(seq < last, OUT_OF_ORDER)
    return rows.select(*feed.columns, "last_seen", (last + 1).alias("expected_seq"), kind.alias("kind"))


INTERVALS = "source int, session_id int, epoch long, start_seq long, end_seq long, opened long, detected long, closed long, filled_by long, reason int, opened_ns long, closed_ns long"


#: An open gap: its first number, and when it opened, as arrival and as time.
STATE = ("low", "opened", "opened_ns")
ANOMALIES = (*TRACKER, "block", "arrival", "kind", "seq", "expected_seq", "ns", "g_seq", "g_arrival", "g_ns")


def _anomalies(classified: DataFrame, at: Column, config: ReconConfig | None, closings: DataFrame | None, block: int) -> DataFrame:
    """ANOMALIES: the rows that can open, extend or close a gap, by blocks of arrivals, each with the number, arrival and time
    of the last row before it that opened or extended one: whatever gap is open ends there."""
    odd = classified.filter(F.col("kind").isin(GAP, OUT_OF_ORDER)).select(*TRACKER, "seq", "arrival", "expected_seq", "kind", at.cast("long").alias("ns"))
    if closings is not None:
        none = F.lit(None).cast("long")
        odd = odd.unionByName(closings.select(*TRACKER, none.alias("seq"), "arrival", none.alias("expected_seq"), F.lit(BY_HAND).alias("kind"), at.cast("long").alias("ns")))
    odd = written(odd, "anomalies")  # few beside the arrivals, and read several times
    gap = F.when(F.col("kind") == GAP, F.struct("seq", "arrival", "ns"))
    odd = running(odd, list(TRACKER), ["arrival", "kind", "seq"], {"g": ("last", gap)}, F.expr(f"arrival div {block}"), inclusive=False)
    ends = [F.col(f"g.{c}").alias(f"g_{c}") for c in ("seq", "arrival", "ns")]
    return odd.withColumn("block", F.expr(f"arrival div {block}")).select(*ANOMALIES[:-3], *ends)


def _quiet(ns: int, g_ns: int | None, config: ReconConfig | None) -> bool:
    return config is not None and g_ns is not None and ns > g_ns + config.gap_close_ns


def _summary(rows: list[tuple], config: ReconConfig | None) -> list:
    """What a block makes of the gap that is open before it, or of none.

    Whichever gap is open, it ends at the row after a quiet time or at a closing by hand; before the first of these, `sure`,
    it depends on the gap's first number, of which a late number must be no less, and on when it opened. So a block is: the
    late numbers larger than all before them (`seqs`, at `places`), the times of its rows (`times`), its first sure end,
    and for each row behind which nothing may be open (`froms`) what follows: the gap that is open in the end and how many open.
    A place is twice a row's number if nothing is open before the row, one more if after it.
    """
    n = len(rows)
    ns, state, count = [r[4] for r in rows], [None] * (n + 1), [0] * (n + 1)
    sure, negative, at = None, [], []  # late numbers behind, each larger than all between
    for k in range(n - 1, -1, -1):
        _, kind, seq, expected, now, g_seq, _, g_ns = (None, *rows[k][1:])
        state[k], count[k] = state[k + 1], count[k + 1]
        if kind == GAP:
            ends = [] if sure is None else [sure]
            i = bisect_right(negative, -expected) - 1
            if i >= 0:
                ends.append(2 * at[i] + 1)
            if config is not None and (j := bisect_right(ns, now + config.gap_timeout_ns, k + 1)) < n:
                ends.append(2 * j)
            if ends:
                then = (min(ends) + 1) // 2
                state[k], count[k] = state[then], count[then] + 1
            else:
                state[k], count[k] = k, 1
        elif kind == BY_HAND:
            sure = 2 * k + 1
        elif g_seq is not None and seq < g_seq:
            while negative and negative[-1] >= -seq:
                negative.pop()
                at.pop()
            negative.append(-seq)
            at.append(k)
        if _quiet(now, g_ns, config):
            sure = 2 * k
    last = n if sure is None else (sure + 1) // 2
    seqs, places = [], []
    for k in range(min(last, n)):
        _, kind, seq, *_, g_seq, _, _ = rows[k]
        if kind == OUT_OF_ORDER and g_seq is not None and seq < g_seq and (not seqs or seq > seqs[-1]):
            seqs.append(seq)
            places.append(2 * k + 1)
    froms = sorted({0, last, *((p + 1) // 2 for p in places), *(range(last + 1) if config is not None else ())})
    found = [None if state[k] is None else rows[state[k]] for k in froms]
    return [seqs, places, ns[: last + 1] if config is not None else [], sure, froms, *([None if r is None else r[i] for r in found] for i in (3, 0, 4)), [count[k] for k in froms]]


SUMMARY = "source int, session_id int, block long, seqs array<long>, places array<long>, times array<long>, sure long, froms array<long>, low array<long>, opened array<long>, opened_ns array<long>, counts array<long>"
STARTS = "source int, session_id int, block long, low long, opened long, opened_ns long, epoch long, final boolean"


def _carried(gap: tuple | None, summary: list, config: ReconConfig | None) -> tuple[tuple | None, int]:
    """(the gap that is open after a block, how many open in it), of the gap open before it."""
    seqs, places, times, sure, froms, low, opened, opened_ns, counts = summary
    then = 0
    if gap is not None:
        ends = [] if sure is None else [sure]
        if (i := bisect_left(seqs, gap[0])) < len(seqs):
            ends.append(places[i])
        if config is not None and (j := bisect_right(times, gap[2] + config.gap_timeout_ns)) < len(times):
            ends.append(2 * j)
        if not ends:
            return gap, 0
        then = (min(ends) + 1) // 2
    i = bisect_left(froms, then)
    return (None if low[i] is None else (low[i], opened[i], opened_ns[i])), counts[i]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _gaps(classified: DataFrame, at: Column, config: ReconConfig | None, closings: DataFrame | None, block: int) -> DataFrame:
    """INTERVALS, in three steps: each block is reduced to what it makes of any gap open before it; these, one row a block,
    follow one another along a tracker into what is open before each; and each block is gone through from there."""
    odd = _anomalies(classified, at, config, closings, block)
    keys, order = [*TRACKER, "block"], ["arrival", "kind", "seq"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_blocks(batches, 3):
            yield _batch([(*key, *_summary(rows, config))], SUMMARY)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_blocks(batches, 2):
            gap, epoch, out = None, 0, []
            for i, (number, *summary) in enumerate(rows):
                out.append((*key, number, *(gap or (None,) * 3), epoch, i == len(rows) - 1))
                gap, opened = _carried(gap, summary, config)
                epoch += opened
            yield _batch(out, STARTS)

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_blocks(batches, 3):
            yield _batch([(*key[:2], *x) for x in _folded(rows, config)], INTERVALS)

    before = folded(folded(odd, keys, order, summaries, SUMMARY), list(TRACKER), ["block"], starts, STARTS)
    return folded(odd.join(before, keys).select(*ANOMALIES, *STATE, "epoch", "final"), keys, order, intervals, INTERVALS)


def _folded(rows: list[tuple], config: ReconConfig | None) -> Iterator[tuple]:
    """A block's gaps (INTERVALS without the tracker) as they close, and the one open at the end of a tracker's last block."""
    low, opened, opened_ns, epoch, final = rows[0][8:]

    def limit(g_ns: int) -> tuple:
        return min((g_ns + config.gap_close_ns, EXTENSION_TIMEOUT), (opened_ns + config.gap_timeout_ns, OPEN_TIMEOUT)) if config else (None, None)

    for arrival, kind, seq, expected, ns, g_seq, g_arrival, g_ns, *_ in rows:
        if low is not None and config and ns > limit(g_ns)[0]:
            end, reason = limit(g_ns)
            yield epoch, low, g_seq, opened, g_arrival, None, None, reason, opened_ns, end
            low = None
        if kind == GAP:
            if low is None:
                low, opened, opened_ns, epoch = expected, arrival, ns, epoch + 1
        elif low is not None and (kind == BY_HAND or low <= seq < g_seq):
            yield epoch, low, g_seq, opened, g_arrival, arrival, seq, CLOSED_BY_HAND if kind == BY_HAND else FILLED, opened_ns, ns
            low = None
    if final and low is not None:
        if kind == GAP:
            g_seq, g_arrival, g_ns = seq, arrival, ns
        end, reason = limit(g_ns)
        yield epoch, low, g_seq, opened, g_arrival, None, None, reason, opened_ns, end


def gap_intervals(classified: DataFrame, closings: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Each gap's numbers [start_seq, end_seq), when it opened, was last extended, and was closed by which number, or by
    hand (filled_by null) after that arrival; closed is null while it is open. reason: how it closed.

    closings: (source, session_id, arrival): any gap open after that arrival is closed.
    """
    return _gaps(classified, F.lit(None), None, closings, block).drop("opened_ns", "closed_ns")


def timed_gap_intervals(classified: DataFrame, at: Column, config: ReconConfig = ReconConfig(), closings: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """INTERVALS: gaps that also close, unfilled (closed and filled_by null), gap_close_ns after they were last extended or
    gap_timeout_ns after they opened, whichever comes first. An arrival at that very time is taken before.

    at: the time of an arrival in nanoseconds, which never falls within a tracker.
    """
    return _gaps(classified, at, config, closings, block)


def with_fills(classified: DataFrame, intervals: DataFrame) -> DataFrame:
    """classified with kind GAP_FILL where an arrival closed a gap."""
    fills = intervals.filter(F.col("reason") == FILLED).select(*TRACKER, F.col("closed").alias("arrival"), F.col("filled_by").alias("seq"), F.lit(GAP_FILL).alias("fill"))
    rows = classified.join(fills, [*TRACKER, "arrival", "seq"], "left")
    return rows.select(*classified.columns[:-1], F.coalesce("fill", "kind").alias("kind"))


def counters(classified: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per source: arrivals, gaps, duplicates, numbers out of order (fills included), fills. Fills are counted as intervals."""
    names = {"events": None, "gaps": GAP, "duplicates": DUPLICATE, "out_of_order": OUT_OF_ORDER}
    counted = classified.groupBy("source").agg(*[(F.count("*") if k is None else F.count_if(F.col("kind") == k)).alias(n) for n, k in names.items()], F.lit(0).cast("long").alias("fills"))
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    fills = intervals.filter(F.col("reason") == FILLED).groupBy("source").agg(F.count("*").alias("fills")).select("source", *zero, "fills")
    return counted.unionAll(fills).groupBy("source").agg(*[F.sum(n).alias(n) for n in (*names, "fills")])


def closing_counters(intervals: DataFrame) -> DataFrame:
    """Per source: gaps closed by a fill, by the timeout after an extension, by that after opening, and by that or by hand."""
    n = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    return intervals.groupBy("source").agg(
        n(FILLED).alias("gaps_closed_by_fill"), n(EXTENSION_TIMEOUT).alias("gaps_closed_by_timeout"), n(OPEN_TIMEOUT).alias("gap_timeouts"), n(OPEN_TIMEOUT, CLOSED_BY_HAND).alias("gaps_closed"),
    )


def uncertain(events: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """events (session_id, arrival, ...) with what the open gaps of their session's two trackers make uncertain: gap_flags,
    each side's p_epoch and d_epoch, and until_ns, the last time at which one of these gaps is open (all null if none is).

    intervals: timed ones, whose arrivals are times. An as-of join by running aggregates: the latest gap of either source
    that opened at or before an event decides, and the event that opens a gap is itself in it, the one that fills it not.
    """
    until = F.when(F.col("reason") == FILLED, F.col("closed_ns") - 1).otherwise(F.coalesce("closed_ns", F.lit(FOREVER)))
    opened = intervals.select("session_id", F.col("opened").alias("arrival"), F.struct("source", "epoch", until.alias("until")).alias("gap"))
    rows = events.withColumns({"gap": F.lit(None).cast("struct<source:int,epoch:bigint,until:bigint>")}).unionByName(opened, allowMissingColumns=True)
    rows = rows.withColumn("event", F.col("gap").isNull())
    latest = lambda source: ("last", F.when(F.col("gap.source") == source, F.col("gap")))
    rows = running(rows, ["session_id"], ["arrival", "event"], {"p": latest(PRIMARY), "d": latest(DROPCOPY)}, F.expr(f"arrival div {block}")).filter("event")
    rows = rows.withColumns({s: F.when(F.col(f"{s}.until") >= F.col("arrival"), F.col(s)) for s in "pd"})
    flags = F.when(F.col("p").isNotNull(), GAP_PRIMARY).otherwise(0) + F.when(F.col("d").isNotNull(), GAP_DROPCOPY).otherwise(0)
    return rows.select(*events.columns, F.nullif(flags, F.lit(0)).alias("gap_flags"), F.col("p.epoch").alias("p_epoch"), F.col("d.epoch").alias("d_epoch"), F.greatest("p.until", "d.until").alias("until_ns"))


def suppressed(events: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of (source, session_id, arrival, ...) that arrive while a gap of their own tracker is open, with its epoch."""
    opened = intervals.select(*TRACKER, F.col("opened").alias("arrival"), F.struct("epoch", "closed").alias("gap"))
    rows = events.withColumn("gap", F.lit(None).cast("struct<epoch:bigint,closed:bigint>")).unionByName(opened, allowMissingColumns=True)
    rows = rows.withColumn("event", F.col("gap").isNull())
    rows = running(rows, list(TRACKER), ["arrival", "event"], {"latest": ("last", F.col("gap"))}, F.expr(f"arrival div {block}")).filter("event")
    open_ = F.col("latest").isNotNull() & (F.col("latest.closed").isNull() | (F.col("arrival") < F.col("latest.closed")))
    return rows.filter(open_).select(*events.columns, F.col("latest.epoch").alias("gap_epoch"))
