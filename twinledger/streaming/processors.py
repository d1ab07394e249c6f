"""Stateful stream processors: both modes of reconciliation by order, and numbering and gaps by tracker.

All give the rows of their batch forms. The state of a key is a small JSON text. Use the RocksDB state store where keys
are many. Events wait until the watermark passes them and are then taken in order, so results don't depend on how a stream
falls into batches. Events later than the delay, and those at or before 1970, where watermarks begin, are dropped by Spark;
`late_rows` counts them, so that a delay can be chosen that drops none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import MS, ReconConfig
from ..operators.orders import Machine
from ..operators.sequence import EXTENSION_TIMEOUT, FILLED as BY_FILL, OPEN_TIMEOUT, TRACKER
from ..schema import (
    DUPLICATE, FILLED, GAP, GAP_FILL, M_AVG_PX, M_CUM_QTY, M_EXEC_ID, M_EXISTENCE, M_STATUS, MISSING_DROPCOPY, MISSING_FILL, NEW, OUT_OF_ORDER, PARTIALLY_FILLED, PENDING_NEW, PHANTOM_ORDER,
    QUANTITY_MISMATCH, R_UNKNOWN, STATE_MISMATCH, TIMING_ANOMALY, UNKNOWN, WORKING, may_follow,
)

DIVERGENCES = "order_key long, detect_ns long, mask int, type int, p_status int, p_cum_qty long, p_avg_px long, d_status int, d_cum_qty long, d_avg_px long"
ANOMALIES = "source int, session_id int, seq long, arrival long, expected_seq long, kind int"
CLOSED = "source int, session_id int, epoch long, start_seq long, end_seq long, opened_ns long, closed_ns long, filled_by long, reason int"
EVENT = ["ingest_ns", "source", "r", "ord_status", "cum_qty", "price_micro", "exec_id", "transact_time"]


def _frame(rows: list, schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names})


def _plain(rows: pd.DataFrame) -> Iterator[list]:
    """Rows as lists that JSON can hold."""
    for row in rows.itertuples(index=False):
        yield [None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in row]


def _apart(a: int | None, b: int | None, tolerance: int) -> bool:
    return a is not None and b is not None and abs(a - b) > tolerance


def mismatch_of(p: list | None, d: list | None, config: ReconConfig) -> int:
    """The bits in which two sides (status, cum_qty, avg_px, exec_id, ts) differ; nulls differ from nothing."""
    if p is None or d is None:
        return 0 if p is d else M_EXISTENCE
    bits = 0
    for i, bit, tolerance in ((0, M_STATUS, 0), (1, M_CUM_QTY, config.qty_tolerance), (2, M_AVG_PX, config.px_tolerance)):
        bits |= bit * _apart(p[i], d[i], tolerance)
    if config.compare_exec_id and None not in (p[3], d[3]) and p[3] != d[3]:
        bits |= M_EXEC_ID
    return bits


def shown_at_once(p: list | None, d: list | None, config: ReconConfig) -> int | None:
    """The kind of divergence that two sides show in immediate mode."""
    if d is None:
        return None
    if p is None:
        return PHANTOM_ORDER
    if d[0] in (FILLED, PARTIALLY_FILLED) and p[0] in (NEW, PENDING_NEW, WORKING):
        return MISSING_FILL
    if p[0] != d[0]:
        return STATE_MISMATCH
    if _apart(p[1], d[1], config.qty_tolerance) or _apart(p[2], d[2], config.px_tolerance):
        return QUANTITY_MISMATCH
    return TIMING_ANOMALY if None not in (p[4], d[4]) and d[4] + config.timing_slack_ns < p[4] else None


class Order:
    """One order: both sides, its reconciliation, what was emitted last, and events held back."""

    def __init__(self, config: ReconConfig, kept: dict[str, Any] | None = None, at_once: bool = False):
        self.config, self.at_once = config, at_once
        self.kept = kept or {"now": [UNKNOWN, UNKNOWN], "sides": [None, None], "machine": [R_UNKNOWN, 0, None], "at": None, "mask": None, "last": None, "held": []}
        self.machine = Machine(config)
        self.machine.state, self.machine.mask, self.machine.deadline = self.kept["machine"]

    def _row(self, at: int, mask: int, kind: int) -> list:
        p, d = self.kept["sides"]
        return [at, mask, kind, *(p or [None] * 3)[:3], *(d or [None] * 3)[:3]]

    def _emit(self, at: int, mask: int) -> Iterator[list]:
        k = self.kept
        if k["at"] is not None and k["mask"] == mask and 0 <= at - k["at"] < self.config.dedup_ns:
            return
        k["at"], k["mask"] = at, mask
        kind = STATE_MISMATCH
        if mask & M_EXISTENCE:
            kind = MISSING_DROPCOPY if k["sides"][0] else PHANTOM_ORDER
        elif mask & M_CUM_QTY and not mask & M_STATUS:
            kind = QUANTITY_MISMATCH
        yield self._row(at, mask, kind)

    def expire(self, through: int) -> Iterator[list]:
        """Confirms the mismatch whose deadline lies at or before `through`."""
        if found := self.machine.timer(through):
            yield from self._emit(*found)

    def take(self, event: list, until: int | None = None) -> Iterator[list]:
        """Applies an event (EVENT). until: as for Machine.event."""
        at, source, _, status, cum, price, exec_id, ts = event
        k = self.kept
        yield from self.expire(at - 1)
        accepted = may_follow(k["now"][source], status)
        if accepted:
            k["now"][source], k["sides"][source] = status, [status, cum, price, exec_id, ts]
        k["last"] = at
        if not self.at_once:
            found = self.machine.event(at, accepted, mismatch_of(*k["sides"], self.config), until)
            if found is not None:
                yield from self._emit(at, found)
        elif not accepted:
            yield from self._emit(at, M_STATUS)
        elif (kind := shown_at_once(*k["sides"], self.config)) is not None:
            yield self._row(at, 0, kind)

    def keep(self) -> None:
        self.kept["machine"] = [self.machine.state, self.machine.mask, self.machine.deadline]

    def advance(self, new: list[list], through: int) -> list[list]:
        """Takes in events; gives what is to be emitted now that all events up to `through` have come."""
        held = sorted(self.kept["held"] + new, key=lambda e: e[:3])
        ready = sum(e[0] <= through for e in held)
        self.kept["held"] = held[ready:]
        out = [row for e in held[:ready] for row in self.take(e)]
        out += self.expire(through)
        self.keep()
        return out

    def next_ns(self) -> int | None:
        """When there is something to do even if no event comes."""
        return min((t for t in (self.machine.deadline, *(e[0] for e in self.kept["held"][:1])) if t is not None), default=None)


def _by_order(events: DataFrame, config: ReconConfig, delay: str, keep_ns: int | None, at_once: bool) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order = Order(config, json.loads(state.get[0]) if state.exists else None, at_once)
        new = [e for frame in frames for e in _plain(frame[EVENT])]
        mark = max(0, state.getCurrentWatermarkMs())
        through = mark * MS + 999  # the watermark counts microseconds, cut
        out = order.advance(new, through)
        wake, idle = order.next_ns(), order.kept["last"]
        if wake is None and keep_ns is not None and idle is not None:
            wake = idle + keep_ns
            if wake <= through:
                state.remove()
        if wake is None or wake > through:
            state.update((json.dumps(order.kept),))
        if wake is not None and wake > through:
            state.setTimeoutTimestamp(max(wake // MS, mark + 1))
        if out:
            yield _frame([[key[0], *x] for x in out], DIVERGENCES)

    ts = F.col("transact_time") if "transact_time" in events.columns else F.col("ingest_ns").alias("transact_time")
    timed = events.select("order_key", *EVENT[:-1], ts, F.timestamp_micros(F.expr("ingest_ns div 1000")).alias("event_ts"))
    return timed.withWatermark("event_ts", delay).groupBy("order_key").applyInPandasWithState(run, DIVERGENCES, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def two_stage(events: DataFrame, config: ReconConfig = ReconConfig(), delay: str = "1 second", keep_ns: int | None = None) -> DataFrame:
    """DIVERGENCES that batch two-stage reconciliation emits, each as soon as the watermark has passed it.

    events: (order_key, source, r, ord_status, cum_qty, price_micro, ingest_ns, exec_id). An order idle for keep_ns with
    nothing waiting is forgotten (None: never); an event after that begins it anew.
    """
    return _by_order(events, config, delay, keep_ns, False)


def immediate(events: DataFrame, config: ReconConfig = ReconConfig(), delay: str = "1 second", keep_ns: int | None = None) -> DataFrame:
    """DIVERGENCES that batch immediate mode emits, each as soon as the watermark has passed it. As two_stage; events may
    have a transact_time (else ingest_ns is taken for it)."""
    return _by_order(events, config, delay, keep_ns, True)


def late_rows(query: StreamingQuery) -> int:
    """How many events came too late so far, of the batches whose progress Spark still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _anomaly(kept: dict[str, Any], seq: int) -> tuple[int | None, int | None]:
    """(expected number, kind or None) of one arrival; kept: the largest number seen and the open gap."""
    last, kind = kept["last"], None
    if last is None or seq == last + 1:
        kept["last"] = seq
        return None if last is None else last + 1, None
    if seq > last:
        kind, kept["last"] = GAP, seq
        kept["gap"] = [kept["gap"][0] if kept["gap"] else last + 1, seq]
    elif seq == last:
        kind = DUPLICATE
    else:
        kind = OUT_OF_ORDER
        if kept["gap"] and kept["gap"][0] <= seq < kept["gap"][1]:
            kind, kept["gap"] = GAP_FILL, None
    return last + 1, kind


def sequence_anomalies(feed: DataFrame) -> DataFrame:
    """ANOMALIES of a stream of (source, session_id, seq, arrival): gaps, duplicates, late numbers and fills.

    Batches must come in order of arrival; within one, rows are sorted. Rows that come again count as arrivals again.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"last": None, "gap": None}
        rows = sorted(((a, s) for frame in frames for a, s in _plain(frame[["arrival", "seq"]])))
        found = [(s, a, *_anomaly(kept, s)) for a, s in rows]
        state.update((json.dumps(kept),))
        if odd := [[*key, *x] for x in found if x[-1] is not None]:
            yield _frame(odd, ANOMALIES)

    return feed.select(*TRACKER, "seq", "arrival").groupBy(*TRACKER).applyInPandasWithState(run, ANOMALIES, "kept string", "append", GroupStateTimeout.NoTimeout)


class Tracker:
    """One tracker whose gaps also close by time: the largest number seen, the open gap with its times, and held arrivals."""

    def __init__(self, config: ReconConfig, kept: dict[str, Any] | None = None):
        self.config, self.kept = config, kept or {"last": None, "gap": None, "epoch": 0, "opened": None, "limit": None, "held": []}

    def _closed(self, at: int, by: int | None, reason: int) -> list:
        k = self.kept
        row = [k["epoch"], *k["gap"], k["opened"], at, by, reason]
        k["gap"] = k["limit"] = None
        return row

    def _expire(self, through: int) -> Iterator[list]:
        if self.kept["limit"] is not None and self.kept["limit"][0] <= through:
            at, reason = self.kept["limit"]
            yield self._closed(at, None, reason)

    def advance(self, new: list[list], through: int) -> list[list]:
        """Takes in (time, number)s; gives the gaps that have closed now that all arrivals up to `through` have come."""
        k, out = self.kept, []
        held = sorted(k["held"] + new)
        ready = sum(at <= through for at, _ in held)
        k["held"] = held[ready:]
        for at, seq in held[:ready]:
            out += self._expire(at - 1)
            gap = k["gap"]
            _, kind = _anomaly(k, seq)
            if kind == GAP:
                if not gap:
                    k["epoch"], k["opened"] = k["epoch"] + 1, at
                k["limit"] = min([at + self.config.gap_close_ns, EXTENSION_TIMEOUT], [k["opened"] + self.config.gap_timeout_ns, OPEN_TIMEOUT])
            elif kind == GAP_FILL:
                k["gap"] = gap
                out.append(self._closed(at, seq, BY_FILL))
        return out + list(self._expire(through))

    def next_ns(self) -> int | None:
        return min((t for t in (*(self.kept["limit"] or [])[:1], *(at for at, _ in self.kept["held"][:1]))), default=None)


def closed_gaps(feed: DataFrame, config: ReconConfig = ReconConfig(), delay: str = "1 second") -> DataFrame:
    """CLOSED: the gaps of a stream of (source, session_id, seq, ingest_ns) as they close, by a fill or by time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(config, json.loads(state.get[0]) if state.exists else None)
        new = [e for frame in frames for e in _plain(frame[["ingest_ns", "seq"]])]
        mark = max(0, state.getCurrentWatermarkMs())
        out = tracker.advance(new, mark * MS + 999)
        state.update((json.dumps(tracker.kept),))
        if (wake := tracker.next_ns()) is not None:
            state.setTimeoutTimestamp(max(wake // MS, mark + 1))
        if out:
            yield _frame([[*key, *x] for x in out], CLOSED)

    timed = feed.select(*TRACKER, "seq", "ingest_ns", F.timestamp_micros(F.expr("ingest_ns div 1000")).alias("event_ts"))
    return timed.withWatermark("event_ts", delay).groupBy(*TRACKER).applyInPandasWithState(run, CLOSED, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts the query that appends a stream's rows to a Parquet folder; trigger as for DataStreamWriter.trigger."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
