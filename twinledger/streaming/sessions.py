"""The two-stage mode with suppression by gaps as a stream: a stateful processor of each session.

A session's two trackers and its orders see its events in the order of their times, whatever the batches: events wait until
the watermark has passed them. At one time arrivals come first (so the event that opens a gap is in it, the one that fills it
not), then the orders' events, then their deadlines, then gaps that close by time, then control rows. While a gap is open
its end isn't known; an order whose mismatch is due then waits with it, and is taken up again where the gap ends, at the
first of its checks after that. So the rows are those of the batch form, where the ends are known.

State: a value of the session (trackers, held events, deadlines of the next grace period), and a map from order to its state,
of which a batch reads and writes only the orders that it touches. Both are JSON texts. One timer wakes a session for what is
due next. The state store must be RocksDB's. A session is one task's.

One pass gives both of a session's outputs, divergences and gaps as they end, as rows of two kinds; `to_parquet` parts them.

Control rows: CLOSE ends the open gap of its source's tracker, if any, after all at its time; RESET ends the day: after it
the session begins anew, without orders, trackers and deadlines.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import MS, ReconConfig
from ..operators.sequence import CLOSED_BY_HAND, EXTENSION_TIMEOUT, FILLED as BY_FILL, FOREVER, OPEN_TIMEOUT
from ..schema import GAP, OUT_OF_ORDER
from .processors import CLOSED, DIVERGENCES, EVENT, Order, _anomaly, _frame, _plain

CLOSE, RESET = 0, 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A session's event, as it is held: an order's event, then the order, its number, and what it controls (null: nothing).
HELD = [*EVENT, "order_key", "seq", "control"]
ORDER_KEY, SEQ, CONTROL = 8, 9, 10
#: Rows of both outputs: those of the kind DIVERGENCE have the columns of DIVERGENCES, those of the kind GAP_END the rest.
DIVERGENCE, GAP_END = 0, 1
BOTH = "session_id int, what int, " + DIVERGENCES + ", source int, epoch long, start_seq long, end_seq long, opened_ns long, closed_ns long, filled_by long, reason int"


class Session:
    """A session's trackers, held events and deadlines; orders are looked up in and written to a store by key."""

    def __init__(self, config: ReconConfig, orders: Any, kept: dict[str, Any] | None = None, keep_ns: int | None = None):
        self.config, self.store, self.keep_ns, self.open = config, orders, keep_ns, {}
        self.gaps: list[list] = []  # source, epoch and the rest of CLOSED of the gaps that have ended
        self.kept = kept or {"trackers": [self._tracker(), self._tracker()], "held": [], "due": []}

    @staticmethod
    def _tracker() -> dict[str, Any]:
        """last, gap: as for `_anomaly`; ended: the number and the last time of the last gap that has ended; waiting: orders."""
        return {"last": None, "gap": None, "epoch": 0, "opened": None, "limit": None, "ended": [0, None], "waiting": []}

    def _order(self, key: int) -> Order:
        if key not in self.open:
            text = self.store.get(key)
            self.open[key] = Order(self.config, json.loads(text) if text else None)
            self.open[key].kept.setdefault("gaps", [0, 0])
        return self.open[key]

    def _set_until(self, order: Order) -> None:
        """The last time, as known now, at which a gap that made the order uncertain is open."""
        ends = [FOREVER if t["gap"] and t["epoch"] == e else t["ended"][1] for t, e in zip(self.kept["trackers"], order.kept["gaps"], strict=True) if e and (t["gap"] and t["epoch"] == e or t["ended"][0] == e)]
        order.machine.until = max(ends, default=None)

    def _plan(self, key: int, order: Order) -> None:
        """Sets down when the order is due; one that a gap keeps waiting is due when the gap ends."""
        at = order.machine.deadline
        if at is not None and not order.kept.get("waiting"):
            heapq.heappush(self.kept["due"], [at, key])
        elif at is None and self.keep_ns is not None:
            heapq.heappush(self.kept["due"], [order.kept["last"] + self.keep_ns, key])

    def _wait(self, key: int, order: Order) -> None:
        """Lets an order wait for a gap that is open, if one keeps it."""
        holds = [t for t, e in zip(self.kept["trackers"], order.kept["gaps"], strict=True) if t["gap"] and t["epoch"] == e]
        order.kept["waiting"] = bool(holds) and order.machine.deadline is not None
        if order.kept["waiting"]:
            holds[0]["waiting"].append(key)

    def _end(self, source: int, at: int, until: int, by: int | None, reason: int) -> None:
        """The source's gap has ended, and was open up to `until`."""
        tracker = self.kept["trackers"][source]
        self.gaps.append([source, tracker["epoch"], *tracker["gap"], tracker["opened"], at, by, reason])
        tracker["ended"], tracker["gap"], tracker["limit"] = [tracker["epoch"], until], None, None
        waiting, tracker["waiting"] = tracker["waiting"], []
        for key in waiting:
            order = self._order(key)
            if order.kept.get("waiting"):
                self._set_until(order)
                order.machine.timer(until)  # its checks up to then find the gap open
                self._wait(key, order)
                self._plan(key, order)

    def _arrive(self, at: int, source: int, numbers: list[int]) -> None:
        tracker, found = self.kept["trackers"][source], []
        state = {"last": tracker["last"], "gap": None}
        for seq in sorted(numbers):
            expected, kind = _anomaly(state, seq)
            if kind in (GAP, OUT_OF_ORDER):
                found.append((kind, seq, expected))
        tracker["last"] = state["last"]
        for kind, seq, expected in sorted(found):
            if kind == GAP:
                if tracker["gap"]:
                    tracker["gap"][1] = seq
                else:
                    tracker["gap"], tracker["epoch"], tracker["opened"] = [expected, seq], tracker["epoch"] + 1, at
                tracker["limit"] = min([at + self.config.gap_close_ns, EXTENSION_TIMEOUT], [tracker["opened"] + self.config.gap_timeout_ns, OPEN_TIMEOUT])
            elif tracker["gap"] and tracker["gap"][0] <= seq < tracker["gap"][1]:
                self._end(source, at, at - 1, seq, BY_FILL)

    def _event(self, event: list) -> Iterator[list]:
        key, at = event[ORDER_KEY], event[0]
        order = self._order(key)
        self._set_until(order)
        before = order.machine.deadline
        flagged = [bool(t["gap"]) for t in self.kept["trackers"]]
        yield from ([key, *x] for x in order.take(event[: len(EVENT)], FOREVER if any(flagged) else None))
        order.kept["gaps"] = [t["epoch"] if f else e for t, f, e in zip(self.kept["trackers"], flagged, order.kept["gaps"], strict=True)]
        if order.kept.get("waiting") and order.machine.deadline is None:
            order.kept["waiting"] = False
        if order.machine.deadline != before or self.keep_ns is not None:
            self._plan(key, order)

    def _deadline(self, key: int, at: int) -> Iterator[list]:
        order = self._order(key)
        if order.machine.deadline == at and not order.kept.get("waiting"):
            self._set_until(order)
            yield from ([key, *x] for x in order.expire(at))
            self._wait(key, order)
            self._plan(key, order)
        elif order.machine.deadline is None and self.keep_ns is not None and order.kept["last"] is not None and order.kept["last"] + self.keep_ns <= at:
            self.open[key] = None
            self.store.remove(key)
            del self.open[key]

    def advance(self, new: list[list], through: int) -> list[list]:
        """Takes in events (HELD); gives the DIVERGENCES to emit now that all events up to `through` have come."""
        events = sorted(self.kept["held"] + new, key=lambda e: (e[0], e[CONTROL] is not None, e[1], e[2]))
        out, i = [], 0
        while True:
            trackers, due = self.kept["trackers"], self.kept["due"]
            times = [events[i][0]] if i < len(events) else []
            times += [due[0][0]] if due else []
            times += [t["limit"][0] for t in trackers if t["limit"]]
            at = min(times, default=None)
            if at is None or at > through:
                break
            j = i
            while j < len(events) and events[j][0] == at:
                j += 1
            now, i = events[i:j], j
            own = [e for e in now if e[CONTROL] is None]
            for source in (0, 1):
                if numbers := [e[SEQ] for e in own if e[1] == source]:
                    self._arrive(at, source, numbers)
            for e in own:
                out += self._event(e)
            while due and due[0][0] <= at:
                out += self._deadline(heapq.heappop(due)[1], at)
            for source, t in enumerate(trackers):
                if t["limit"] and t["limit"][0] <= at:
                    self._end(source, at, at, None, t["limit"][1])
            for e in now[len(own) :]:
                if e[CONTROL] == RESET:
                    self.store.clear()
                    self.open = {}
                    self.kept = {"trackers": [self._tracker(), self._tracker()], "held": [], "due": []}
                elif trackers[e[1]]["gap"]:
                    self._end(e[1], at, at, None, CLOSED_BY_HAND)
        self.kept["held"] = events[i:]
        for key, order in self.open.items():
            order.keep()
            self.store.put(key, json.dumps(order.kept))
        self.open = {}
        return out

    def empty(self) -> bool:
        return not self.kept["held"] and not self.kept["due"] and all(t["last"] is None for t in self.kept["trackers"])

    def next_ns(self) -> int | None:
        times = [e[0] for e in self.kept["held"][:1]] + [d[0] for d in self.kept["due"][:1]] + [t["limit"][0] for t in self.kept["trackers"] if t["limit"]]
        return min(times, default=None)


class _Orders:
    """The map state of orders, as Session reads and writes it."""

    def __init__(self, state):
        self.state = state

    def get(self, key: int) -> str | None:
        found = self.state.getValue((key,))
        return None if found is None else found[0]

    def put(self, key: int, text: str) -> None:
        self.state.updateValue((key,), (text,))

    def remove(self, key: int) -> None:
        self.state.removeKey((key,))

    def clear(self) -> None:
        self.state.clear()


class _Processor(StatefulProcessor):
    def __init__(self, config: ReconConfig, keep_ns: int | None):
        self.config, self.keep_ns = config, keep_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "kept string")
        self.orders = handle.getMapState("orders", "order_key long", "kept string")

    def _advance(self, key: int, new: list[list], mark: int) -> Iterator[pd.DataFrame]:
        mark = max(0, mark)
        kept = json.loads(self.session.get()[0]) if self.session.exists() else None
        session = Session(self.config, _Orders(self.orders), kept, self.keep_ns)
        out = session.advance(new, mark * MS + 999)  # the watermark counts microseconds, cut
        if session.empty():
            self.session.clear()
        else:
            self.session.update((json.dumps(session.kept),))
        if (wake := session.next_ns()) is not None:
            self.handle.registerTimer(max(wake // MS, mark + 1))
        rows = [[DIVERGENCE, *x, *[None] * 8] for x in out] + [[GAP_END, *[None] * 10, *x] for x in session.gaps]
        if rows:
            yield _frame([[key, *x] for x in rows], BOTH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], [e for frame in rows for e in _plain(frame[HELD])], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def both(events: DataFrame, config: ReconConfig = ReconConfig(), delay: str = "1 second", keep_ns: int | None = None) -> DataFrame:
    """BOTH: what `two_stage_suppressed` gives, and the gaps that have ended, each as soon as the watermark has passed it.

    events: as for `processors.two_stage`, with session_id and seq, and with control rows if they have a column `control`. An
    order idle for keep_ns with nothing waiting is forgotten (None: never).
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    ts = F.col("transact_time") if "transact_time" in events.columns else F.col("ingest_ns").alias("transact_time")
    control = F.col("control").cast("int") if "control" in events.columns else F.lit(None).cast("int").alias("control")
    timed = events.select("session_id", *EVENT[:-1], ts, "order_key", "seq", control, F.timestamp_micros(F.expr("ingest_ns div 1000")).alias("event_ts"))
    grouped = timed.withWatermark("event_ts", delay).groupBy("session_id")
    return grouped.transformWithStateInPandas(_Processor(config, keep_ns), BOTH, "Append", "EventTime")


def _of(rows: DataFrame, what: int) -> DataFrame:
    names = [x.split()[0] for x in (DIVERGENCES if what == DIVERGENCE else CLOSED).split(", ")]
    return rows.filter(F.col("what") == what).select(*names)


def two_stage_suppressed(events: DataFrame, config: ReconConfig = ReconConfig(), delay: str = "1 second", keep_ns: int | None = None) -> DataFrame:
    """DIVERGENCES that batch two-stage reconciliation emits where gaps make orders uncertain. See `both`."""
    return _of(both(events, config, delay, keep_ns), DIVERGENCE)


def to_parquet(rows: DataFrame, divergences: str, gaps: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts the query that writes a stream of BOTH to two Parquet folders, in one pass. A batch that is run again, as after a
    failure, takes the place of its own rows: each has a folder of its number (column batch)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for what, path in ((DIVERGENCE, divergences), (GAP_END, gaps)):
            _of(batch, what).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
