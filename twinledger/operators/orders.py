"""Order lifecycles, both views of an order after each event, and how these views differ."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..config import MS, ReconConfig
from ..schema import (
    DIVERGED_CONFIRMED, DROPCOPY, FILLED, FOLLOW_BITS, M_AVG_PX, M_CUM_QTY, M_EXEC_ID, M_EXISTENCE, M_STATUS, MATCHED, MISSING_DROPCOPY, MISSING_FILL, NEW, PARTIALLY_FILLED,
    PENDING_NEW, PHANTOM_ORDER, PRIMARY, QUANTITY_MISMATCH, R_UNKNOWN, RECON_NAMES, STATE_MISMATCH, TERMINAL_STATES, TERMINAL_STATUSES, TIMING_ANOMALY, UNKNOWN, WORKING,
)
from ..schema import may_follow as may_follow_code
from ..storage import written
from .machine import COUNTERS, Machine, Ways, after_block
from .running import folded, in_blocks, running
from .sequence import FOREVER

SIDE = ("status", "cum_qty", "avg_px", "ts", "exec_id")
#: An event's place in its order's life.
ORDER = ("ingest_ns", "source", "r")
#: Events of an order that one task takes; orders with more are taken by blocks of time.
HOT, BLOCK_NS, ORDINARY = 10_000_000, 3_600_000 * MS, -(1 << 62)


def may_follow(current: Column, new: Column) -> Column:
    bits = F.element_at(F.array(*map(F.lit, FOLLOW_BITS)), current.cast("int") + 1)
    return F.when(new.between(0, 9), F.getbit(bits, new.cast("int")) == 1).otherwise((current == UNKNOWN) | (current == new))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)


def parted(events: DataFrame, hot: int = HOT, block_ns: int = BLOCK_NS, sizes: DataFrame | None = None) -> DataFrame:
    """events with a column `part` where some order has more than `hot` of them: the number of the block of time for such
    orders, ORDINARY for others. All that runs along an order then takes it part by part, so that many tasks share a hot one.

    sizes: (order_key, n), no less than each order's events, where that is known without going through the events. The
    driver gets the hot keys: no more than one for each `hot` events.
    """
    keys = _hot_keys(events, hot, sizes)
    if keys is None:
        return events
    block = F.expr(f"ingest_ns div {block_ns}")
    return events.join(keys.withColumn("hot", F.lit(True)).hint("broadcast"), "order_key", "left").withColumn("part", F.when(F.col("hot"), block).otherwise(F.lit(ORDINARY))).drop("hot")


def _hot_keys(events: DataFrame, hot: int, sizes: DataFrame | None) -> DataFrame | None:
    sizes = events.groupBy("order_key").agg(F.count("*").alias("n")) if sizes is None else sizes
    keys = [(r[0],) for r in sizes.filter(F.col("n") > hot).select("order_key").collect()]
    return events.sparkSession.createDataFrame(keys, "order_key long") if keys else None


def hot_apart(events: DataFrame, hot: int | None = None, block_ns: int = BLOCK_NS, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(events of ordinary orders, those of hot ones with `part`; None if there are none): see `parted`. What goes by parts is
    shuffled and written several times, which ordinary orders, nearly all events, are spared if they are taken by themselves."""
    keys = _hot_keys(events, HOT if hot is None else hot, sizes)
    if keys is None:
        return events, None
    keys = F.broadcast(keys)
    return events.join(keys, "order_key", "left_anti"), events.join(keys, "order_key", "left_semi").withColumn("part", F.expr(f"ingest_ns div {block_ns}"))


def _part(rows: DataFrame) -> Column | None:
    return F.col("part") if "part" in rows.columns else None


#: An order's status after some events, as a character for each status that it may have had before them.
SAME = "".join(map(chr, range(10)))


def _after(steps: str, status: int) -> str:
    """steps, then an event. A status of a code beyond the known ones allows none but itself to follow."""
    return "".join(chr(status) if may_follow_code(ord(c), status) else c for c in steps)


def _part_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of (order_key, part, source, ord_status, ...) in order, one for each part and source: what its events make of
    each status before them."""
    at, now, memo = None, {}, {}
    for b in batches:
        out = []
        for key, part, source, status in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (key, part) != at:
                out += [(*at, s, x) for s, x in now.items()] if at else []
                at, now = (key, part), {}
            before = now.get(source, SAME)
            if (before, status) not in memo:
                memo[before, status] = _after(before, status)
            now[source] = memo[before, status]
        if out:
            yield _steps(out)
    if at and now:
        yield _steps([(*at, s, x) for s, x in now.items()])


def accepted_in_order(keys: np.ndarray, source: np.ndarray, status: np.ndarray, start: np.ndarray, before: dict[int, int]) -> tuple[np.ndarray, dict[int, int]]:
    """(which events are accepted, the statuses of the last order by source) of events in order, those of a key one after
    another. keys: (n, k); before: the statuses of the first order by source; start: those of others at their first event.

    All orders go in step: first events of every order and source at once, then all second ones, and so on.
    """
    n = len(status)
    if not n:
        return np.zeros(0, bool), before
    segment = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
    sources, of = np.unique(source, return_inverse=True)
    line = segment * len(sources) + of
    order = np.argsort(line, kind="stable")
    first = np.concatenate([[True], line[order][1:] != line[order][:-1]])
    begins = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    now = np.full((segment[-1] + 1) * len(sources), UNKNOWN, np.int64)
    now[line[order[begins]]] = start[order[begins]]
    for i, s in enumerate(sources.tolist()):
        if s in before:
            now[i] = before[s]
    steps = np.argsort(rank, kind="stable")
    good, ends = np.zeros(n, bool), np.cumsum(np.bincount(rank))
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        rows = steps[a:b]
        at, new = now[line[rows]], status[rows]
        known = (at >= 0) & (at <= 9) & (new >= 0) & (new <= 9)
        good[rows] = (at == UNKNOWN) | (at == new) | (known & FOLLOWS[np.where(known, at, 0), np.where(known, new, 0)])
        now[line[rows]] = np.where(good[rows], new, at)
    last = segment[-1] * len(sources)
    after = dict(before) if segment[-1] == 0 else {}
    seen = set(of[segment == segment[-1]].tolist())
    return good, after | {s: int(now[last + i]) for i, s in enumerate(sources.tolist()) if i in seen}


#: FOLLOWS[current, new]: whether the status may follow.
FOLLOWS = np.array([[may_follow_code(c, n) for n in range(10)] for c in range(10)])
#: Where a status is null, or a start that isn't known.
NONE = -1


#: A feed's side of a view, and what acceptance and both sides are together.
SIDE_TYPE = StructType([StructField(c, StringType() if c == "exec_id" else IntegerType() if c == "status" else LongType()) for c in SIDE])
SEEN = StructType([StructField("accepted", BooleanType()), StructField("p", SIDE_TYPE), StructField("d", SIDE_TYPE)])


class _Sides:
    """The last accepted state of either feed after each event, of batches in order."""

    def __init__(self):
        self.at, self.last = None, {}

    def take(self, keys: np.ndarray, source: np.ndarray, good: np.ndarray, fields: list[pa.Array]) -> list[pa.Array]:
        n = len(keys)
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        goes_on = bool(n) and self.at == int(keys[0])
        begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        types, out = [pa.int32(), *[pa.int64()] * 3, pa.string()], []
        for s in (PRIMARY, DROPCOPY):
            held = self.last.get(s) if goes_on else None
            last = np.maximum.accumulate(np.where(good & (source == s), np.arange(n), -1))
            last = np.where(last >= begins, last + 1, 0)  # 0: the row held from the batches before
            none = (last == 0) & ~((begins == 0) & (held is not None))
            joined = [pa.concat_arrays([pa.array([held[i] if held else None], t), f.cast(t)]) for i, (f, t) in enumerate(zip(fields, types, strict=True))]
            out.append(pa.StructArray.from_arrays([f.take(pa.array(last)) for f in joined], list(SIDE), mask=pa.array(none)))
            if n:
                self.last[s] = None if none[-1] else tuple(f[int(last[-1])].as_py() for f in joined)
        self.at = int(keys[-1]) if n else self.at
        return out


def _accepting(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    at, before, sides = None, {}, _Sides()
    for order_key, part, source, status, start, *fields in columns:
        whole = lambda x, none: x.fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.stack([whole(order_key, 0), whole(part, 0)], axis=1)
        if len(keys) and at != tuple(keys[0].tolist()):
            before = {}
        good, before = accepted_in_order(keys, whole(source, 0), whole(status, NONE), whole(start, UNKNOWN), before)
        at = tuple(keys[-1].tolist()) if len(keys) else at
        if fields:
            yield pa.StructArray.from_arrays([pa.array(good), *sides.take(keys[:, 0], whole(source, NONE), good, [status, *fields])], SEEN.names)
        else:
            yield pa.array(good)


def _steps(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["order_key", "part", "source", "steps"])


def _starts(parts: DataFrame) -> DataFrame:
    """(order_key, part, source, start): the status before each part but an order's first, of the parts' steps."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, UNKNOWN
        for b in batches:
            out = []
            for key, part, source, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, source) != at:
                    at, now = (key, source), UNKNOWN
                else:
                    out.append((key, part, source, now))
                now = ord(steps[now]) if now < 10 else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["order_key", "part", "source", "start"])

    return folded(parts.select("order_key", "part", "source", "steps"), ["order_key", "source"], ["part"], fold, "order_key long, part long, source int, start int")


def lifecycle(events: DataFrame, sides: bool = False, tasks: int | None = None) -> DataFrame:
    """events with `accepted`: whether the status may follow that of the feed's last accepted event of the order; sides: and,
    unless orders have parts, with both sides of the view after each, so that `views` need not shuffle and sort all again.
    tasks: how many share the orders; by as many they may have been dealt out before.

    A fold over each order's events of one feed, in order; only keys and statuses leave the JVM. Of orders that have parts
    (see `parted`), each part is first reduced to what it makes of any status before it; these follow one another into the
    status with which each part starts.
    """
    parts = "part" in events.columns
    keys, order = ["order_key", "part"] if parts else ["order_key"], list(ORDER)
    none = F.lit(None).cast("int")
    if parts:
        hot = events.filter(F.col("part") != ORDINARY).select("order_key", "part", "source", "ord_status", *[c for c in order if c != "source"])
        steps = folded(hot, keys, order, _part_steps, "order_key long, part long, source int, steps string")
        events = events.join(_starts(steps), [*keys, "source"], "left")
    rows = events.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order)
    part, start = (F.col("part"), F.col("start")) if parts else (F.lit(0), none)

    # what comes out depends on the rows' order, so that no filter may pass below
    @F.arrow_udf(SEEN if sides and not parts else BooleanType())
    def accepting(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return _accepting(columns)

    along = ["order_key", part.cast("long"), "source", "ord_status", start]
    if sides and not parts:
        rows = rows.withColumn("_seen", accepting.asNondeterministic()(*along, "cum_qty", "price_micro", "transact_time", "exec_id"))
        return rows.select(*events.columns, "_seen.accepted", F.col("_seen.p").alias("_p"), F.col("_seen.d").alias("_d"))
    rows = rows.withColumn("accepted", accepting.asNondeterministic()(*along))
    return rows.drop("start") if parts else rows


def views(accepted: DataFrame) -> DataFrame:
    """After each event, the last accepted state of either feed: columns p_* and d_*, null while a feed was not seen.
    Further columns that reconciliation reads (part, until_ns) are kept; open_ns, the largest until_ns so far, is read of orders
    that have parts only."""
    side = F.struct(F.col("ord_status").alias("status"), "cum_qty", F.col("price_micro").alias("avg_px"), F.col("transact_time").alias("ts"), "exec_id")
    last = lambda s: ("last", F.when((F.col("source") == s) & F.col("accepted"), side))
    kept = ["order_key", *ORDER, "accepted", *[c for c in ("part", "until_ns") if c in accepted.columns]]
    if "_p" in accepted.columns:
        return accepted.select(*kept, *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "pd" for c in SIDE])
    values = {"p": last(PRIMARY), "d": last(DROPCOPY)}
    if "until_ns" in kept:
        values["open_ns"] = ("max", F.col("until_ns"))
    both = running(accepted, ["order_key"], list(ORDER), values, _part(accepted))
    return both.select(*kept, *list(values)[2:], *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pd" for c in SIDE])


def last_states(accepted: DataFrame) -> DataFrame:
    """The state of each order and feed after all events."""
    at = F.struct(*ORDER)
    pick = lambda c: F.max_by(F.when(F.col("accepted"), F.col(c)), F.when(F.col("accepted"), at))
    names = {"ord_status": "status", "cum_qty": "cum_qty", "price_micro": "avg_px", "transact_time": "ts", "exec_id": "exec_id"}
    return accepted.groupBy("order_key", "source").agg(*[pick(c).alias(n) for c, n in names.items()], F.count_if(~F.col("accepted")).alias("n_rejected"))


def end_of_day(accepted: DataFrame) -> DataFrame:
    """One row per order with both sides' last states, a full outer meeting of the feeds, in one aggregation."""
    at, side = F.struct(*ORDER), F.struct(F.col("ord_status").alias("status"), "cum_qty", F.col("price_micro").alias("avg_px"), F.col("transact_time").alias("ts"), "exec_id")
    pick = lambda s: F.max_by(F.when((F.col("source") == s) & F.col("accepted"), side), F.when((F.col("source") == s) & F.col("accepted"), at))
    both = accepted.groupBy("order_key").agg(pick(PRIMARY).alias("p"), pick(DROPCOPY).alias("d"))
    return both.select("order_key", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pd" for c in SIDE])


def apart(a: str, b: str, tolerance: int) -> Column:
    """|a - b| > tolerance, exact over the whole range."""
    wide = "decimal(20,0)"
    return F.abs(F.col(a).cast(wide) - F.col(b).cast(wide)) > tolerance


def mismatch(qty_tolerance: int = 0, px_tolerance: int = 0, compare_exec_id: bool = True) -> Column:
    """The bits in which the sides of a view differ; existence excludes all others."""
    p, d = F.col("p_status").isNotNull(), F.col("d_status").isNotNull()
    bit = lambda when, b: F.when(when, b).otherwise(0)
    bits = [bit(F.col("p_status") != F.col("d_status"), M_STATUS), bit(apart("p_cum_qty", "d_cum_qty", qty_tolerance), M_CUM_QTY), bit(apart("p_avg_px", "d_avg_px", px_tolerance), M_AVG_PX)]
    if compare_exec_id:
        bits.append(bit(F.col("p_exec_id") != F.col("d_exec_id"), M_EXEC_ID))
    return F.when(~p & ~d, 0).when(p != d, M_EXISTENCE).otherwise(reduce(Column.__add__, bits))


def mask_type(mask: str, primary_only: Column) -> Column:
    """The kind of divergence that a confirmed mask stands for."""
    has = lambda b: F.col(mask).bitwiseAND(F.lit(b)) != 0
    return (
        F.when(has(M_EXISTENCE), F.when(primary_only, MISSING_DROPCOPY).otherwise(PHANTOM_ORDER))
        .when(has(M_STATUS), STATE_MISMATCH)
        .when(has(M_CUM_QTY), QUANTITY_MISMATCH)
        .otherwise(STATE_MISMATCH)
    )


def immediate_type(config: ReconConfig = ReconConfig()) -> Column:
    """The kind of divergence that a view shows at once, or null."""
    wide = "decimal(20,0)"
    return (
        F.when(F.col("d_status").isNull(), None)
        .when(F.col("p_status").isNull(), PHANTOM_ORDER)
        .when(F.col("d_status").isin(FILLED, PARTIALLY_FILLED) & F.col("p_status").isin(NEW, PENDING_NEW, WORKING), MISSING_FILL)
        .when(F.col("p_status") != F.col("d_status"), STATE_MISMATCH)
        .when(apart("p_cum_qty", "d_cum_qty", config.qty_tolerance) | apart("p_avg_px", "d_avg_px", config.px_tolerance), QUANTITY_MISMATCH)
        .when(F.col("d_ts").cast(wide) + config.timing_slack_ns < F.col("p_ts").cast(wide), TIMING_ANOMALY)
    )


def last_emitted(ns: list[int], window_ns: int) -> list[int]:
    """For each of the times of a run's candidates, the last that is emitted if it is, each emitted one being the first that
    comes at least the window after the one before."""
    out = list(ns)
    for k in range(len(ns) - 1, -1, -1):
        then = bisect_left(ns, ns[k] + window_ns, k + 1)
        if then < len(ns):
            out[k] = out[then]
    return out


#: Candidates of a hot order that a task goes through at once.
CANDIDATES = 65_536
CHAINS = "order_key long, run long, block long, ns array<long>, last array<long>"


def _emitted_before(rows: DataFrame, window_ns: int) -> DataFrame:
    """(order_key, run, block, before): when the run's last candidate before each block is emitted (null: none is), of rows
    (order_key, run, block, detect_ns). Each block is reduced to where each beginning in it leads."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in in_blocks(batches, 3):
            ns = [x for (x,) in held]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, ns, last_emitted(ns, window_ns)), types, strict=True)], ["order_key", "run", "block", "ns", "last"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in in_blocks(batches, 2):
            before, out = None, []
            for block, ns, last in held:
                out.append((*key, block, before))
                then = 0 if before is None else bisect_left(ns, before + window_ns)
                before = last[then] if then < len(ns) else before
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["order_key", "run", "block", "before"])

    each = folded(rows, ["order_key", "run", "block"], ["detect_ns"], chains, CHAINS)
    return folded(each, ["order_key", "run"], ["block"], starts, "order_key long, run long, block long, before long")


def deduplicated(candidates: DataFrame, window_ns: int, block: int = CANDIDATES) -> DataFrame:
    """candidates (order_key, detect_ns, mask, ...) with `emitted`: false where the same mask was emitted for the order
    less than the window before.

    A mask unlike that before it is always emitted, and so is one that comes at least the window after the one before;
    these begin runs that don't depend on one another, so that the tasks share an order's candidates. Where orders have
    parts, runs fall into blocks of so many candidates, and what was emitted before each is found from what the blocks before
    make of any time. Candidates without a mask are no divergences and pass (emitted null).
    """
    real, order = F.col("mask").isNotNull(), ["detect_ns", "mask"]
    parts = "part" in candidates.columns
    if not parts:  # an order is one task's, whole
        return _deduplicated_whole(candidates, window_ns)
    part = F.coalesce(F.expr(f"detect_ns div {BLOCK_NS}"), F.lit(0))
    last = {"_last": ("last", F.when(real, F.struct(F.col("detect_ns").alias("at"), F.col("mask").alias("mask"))))}
    rows = running(candidates, ["order_key"], order, last, part, inclusive=False)
    begins = real & F.coalesce((F.col("_last.mask") != F.col("mask")) | (F.col("detect_ns") - F.col("_last.at") >= window_ns), F.lit(True))
    sums = {"run": ("sum", F.col("begins")), "place": ("sum", F.lit(1))}
    rows = running(rows.withColumn("begins", begins.cast("int")).drop("_last"), ["order_key"], order, sums, part).drop("begins")
    rest = [c for c in candidates.columns if c not in ("order_key", "detect_ns", "mask")]
    rows = written(rows.select("order_key", F.col("run").cast("long").alias("run"), F.expr(f"place div {block}").alias("block"), "detect_ns", "mask", *rest), "candidates")
    rows = rows.join(_emitted_before(rows.filter(real).select("order_key", "run", "block", "detect_ns"), window_ns), ["order_key", "run", "block"], "left")
    rows = rows.select("order_key", "run", "block", "detect_ns", "mask", "before", *rest)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            out = []
            for key, run, block, ns, mask, before in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if mask is None:
                    out.append(None)
                    continue
                if (key, run, block) != at:
                    at, last = (key, run, block), before
                emit = last is None or ns - last >= window_ns
                if emit:
                    last = ns
                out.append(emit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "emitted"])

    return folded(rows, ["order_key", "run", "block"], order, fold, rows.schema.add("emitted", "boolean")).select(*candidates.columns, "emitted")


def _deduplicated_whole(candidates: DataFrame, window_ns: int) -> DataFrame:
    """As `deduplicated`, of orders that are one task's each, in one pass."""
    rows = candidates.select("order_key", "detect_ns", "mask", *[c for c in candidates.columns if c not in ("order_key", "detect_ns", "mask")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, same, last = None, None, 0
        for b in batches:
            out = []
            for key, ns, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if mask is None:
                    out.append(None)
                    continue
                emit = key != at or mask != same or ns - last >= window_ns
                if emit:
                    at, same, last = key, mask, ns
                out.append(emit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "emitted"])

    return folded(rows, ["order_key"], ["detect_ns", "mask"], fold, rows.schema.add("emitted", "boolean")).select(*candidates.columns, "emitted")


def immediate(viewed: DataFrame, config: ReconConfig = ReconConfig()) -> DataFrame:
    """(order_key, detect_ns, type, mask, ...): what each event shows at once; invalid transitions, deduplicated, too."""
    sides = [f"{s}_{c}" for s in "pd" for c in SIDE[:3]]
    at_once = viewed.filter("accepted").withColumns({"type": immediate_type(config), "mask": F.lit(0)}).filter("type is not null")
    at_once = at_once.select("order_key", F.col("ingest_ns").alias("detect_ns"), "source", "r", "type", "mask", *sides)
    part = ["part"] if "part" in viewed.columns else []
    invalid = viewed.filter("not accepted").select("order_key", F.col("ingest_ns").alias("detect_ns"), F.lit(M_STATUS).alias("mask"), "source", "r", F.lit(STATE_MISMATCH).alias("type"), *sides, *part)
    return at_once.unionByName(deduplicated(invalid, config.dedup_ns).filter("emitted").drop("emitted", *part))


SIX = [f"{s}_{c}" for s in "pd" for c in SIDE[:3]]
STEPS = "order_key long, segment long, detect_ns long, mask int, p_status int, p_cum_qty long, p_avg_px long, d_status int, d_cum_qty long, d_avg_px long, state int, " + ", ".join(f"{c} long" for c in COUNTERS)


#: Events of a hot order that a task takes through the machine at once.
EVENTS = 4_096
WAYS = "order_key long, segment long, block long, first long, last long, mask int, until long, was boolean, ends array<long>"
BEGINNINGS = "order_key long, segment long, block long, s_state int, s_deadline long, s_mask int, s_until long, next_ns long"


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _beginnings(rows: DataFrame, config: ReconConfig) -> DataFrame:
    """BEGINNINGS: the machine's state before each block of a segment, its timers gone through up to the first event, and
    when the next block begins (null: none does), of rows (order_key, segment, block, ingest_ns, accepted, mask, until_ns, was).

    Each block is reduced to what it makes of any state; one row a block is then carried along its segment.
    """

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made, row, out = None, None, None, []

        def done() -> tuple:
            return (*here, row[0], *made.last, row[4], [x for e in made.ends() for x in e])

        for b in batches:
            for key, segment, block, *now in zip(*(c.to_pylist() for c in b.columns[:8]), strict=True):
                if (key, segment, block) != here:
                    out += [done()] if here else []
                    here, made, row = (key, segment, block), Ways(config, now[0]), now
                made.take(*now[:4])
            yield _batch(out, WAYS)
            out = []
        yield _batch([done()] if here else [], WAYS)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before, at = None, None, None  # before: the row of the block before, but for when this one begins
        for b in batches:
            out = []
            for key, segment, block, first, last, mask, until, was, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                same = (key, segment) == here
                if before:
                    out.append((*before, first if same else None))
                if same:
                    machine = Machine(config, *at)
                    machine.timer(first - 1)
                    at = machine.state, machine.deadline, *at[2:]
                else:
                    here, at = (key, segment), (R_UNKNOWN if not segment else MATCHED if was else DIVERGED_CONFIRMED, None, 0, None)
                before = (key, segment, block, *at)
                at = *after_block(*at[:2], zip(*[iter(ends)] * 6, strict=True), config.gap_recheck_ns), mask, until
            yield _batch(out, BEGINNINGS)
        yield _batch([(*before, None)] if before else [], BEGINNINGS)

    each = folded(rows, ["order_key", "segment", "block"], list(ORDER), ways, WAYS)
    return folded(each, ["order_key", "segment"], ["block"], carried, BEGINNINGS)


def reconciled(viewed: DataFrame, config: ReconConfig = ReconConfig(), block: int = EVENTS, ends: bool = True) -> DataFrame:
    """STEPS, and part if orders have parts: in rows with a mask, divergences to emit as the order was then; in rows with a
    state, an order's state after all events of a segment; in those with neither, counters of some events. ends: whether rows
    of the latter kinds are wanted.

    One sorted pass over the events, in memory for one order, whose rows must be one task's, as `views` leaves them (a table
    read again must be dealt by order first). Orders that have parts fall into segments that don't depend
    on one another: one ends with an event that is rejected, or after which the views agree, unless a gap that made an
    event uncertain is still open. Hot orders' segments fall into blocks of so many events, each of which begins in the
    state to which the blocks before it lead (see `_beginnings`), so that many tasks share one that never ends.
    """
    mask, parts = mismatch(config.qty_tolerance, config.px_tolerance, config.compare_exec_id), "part" in viewed.columns
    rows = viewed.withColumn("mask", mask)
    agree = F.col("accepted") & (F.col("mask") == 0)
    if "until_ns" in viewed.columns:
        agree = agree & F.coalesce(F.col("open_ns") < F.col("ingest_ns"), F.lit(True))
        # what a gap held up before a segment's first event holds it up in the segment
        rows = rows.withColumn("until_ns", F.col("open_ns")) if parts else rows
    else:
        rows = rows.withColumn("until_ns", F.lit(None).cast("long"))
    none = F.lit(None).cast("long")
    if parts:
        rows = rows.withColumns({"ends": (agree | ~F.col("accepted")).cast("int"), "one": F.lit(1)})
        along = {"segment": ("sum", F.col("ends")), "was": ("last", F.col("accepted")), "place": ("sum", F.col("one"))}
        rows = running(rows, ["order_key"], list(ORDER), along, _part(rows), inclusive=False)
        rows = rows.withColumn("block", F.when(F.col("part") == ORDINARY, 0).otherwise(F.expr(f"place div {block}")).cast("long"))
    else:  # an order is one task's, whole
        rows = rows.withColumns({"segment": F.lit(0), "was": F.lit(True), "block": F.lit(0).cast("long")})
    keys = ["order_key", "segment", "block"]
    rows = rows.select("order_key", F.col("segment").cast("long").alias("segment"), "block", "ingest_ns", "accepted", "mask", "until_ns", "was", *SIX, "source", "r", *["part"] * parts)
    if parts:
        rows = written(rows, "segments")
        hot = rows.filter(F.col("part") != ORDINARY).select(*keys, "ingest_ns", "accepted", "mask", "until_ns", "was", "source", "r")
        rows = rows.drop("part").join(_beginnings(hot, config), keys, "left")
    else:
        rows = rows.withColumns({"s_state": none.cast("int"), "s_deadline": none, "s_mask": none.cast("int"), "s_until": none, "next_ns": none})
    rows = rows.select(*keys, "ingest_ns", "accepted", "mask", "until_ns", "was", "s_state", "s_deadline", "s_mask", "s_until", "next_ns", *SIX, "source", "r")
    end, names = FOREVER if config.horizon_ns is None else config.horizon_ns - 1, [x.split()[0] for x in STEPS.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, then, machine, out, blank, before = None, None, None, [], [0] * len(COUNTERS), None

        def emit(row: int, ns: int, mask: int) -> None:
            out.append((row, here[0] if here[3] else None, here[1], ns, mask, None, *blank))

        def finish(row: int) -> None:
            if machine:
                if found := machine.timer(end if then is None else then - 1):
                    emit(row, *found)
                if ends:
                    out.append((row, here[0] if here[3] else None, here[1], None, None, machine.state if then is None else None, *machine.n))

        def given(sides: list[pa.Array]) -> pa.RecordBatch:
            row, key, segment, ns, mask, *rest = zip(*out, strict=True) if out else [()] * (6 + len(COUNTERS))
            at, kinds = pa.array(row, pa.int64()), [pa.int64()] * 3 + [pa.int32()]
            first = [pa.array(c, k) for c, k in zip((key, segment, ns, mask), kinds, strict=True)]
            rest = [pa.array(c, k) for c, k in zip(rest, [pa.int32()] + [pa.int64()] * len(COUNTERS), strict=True)]
            return pa.RecordBatch.from_arrays([*first, *(x.take(at) for x in sides), *rest], names)

        # row i of a batch is row i + 1 of its sides, which begin with the last row before it
        for b in batches:
            if not b.num_rows:
                continue
            sides = [b.column(i) if before is None else pa.concat_arrays([x, b.column(i)]) for i, x in zip(range(13, 19), before or [None] * 6, strict=True)]
            off = 0 if before is None else 1
            key = np.stack([b.column(i).fill_null(0).to_numpy() for i in range(3)] + [b.column(0).is_valid().to_numpy(zero_copy_only=False)])
            changes = np.flatnonzero(np.append(here is None or tuple(key[:, 0].tolist()) != here, (key[:, 1:] != key[:, :-1]).any(0)))
            starts = [b.column(i).take(pa.array(changes)).to_pylist() for i in (7, 8, 9, 10, 11, 12)]
            times, accepted, masks = (b.column(i).to_numpy(zero_copy_only=False).tolist() for i in (3, 4, 5))
            until = b.column(6).to_pylist() if b.column(6).null_count < b.num_rows else [None] * b.num_rows
            first, starts = changes.tolist(), list(zip(*starts, strict=True))
            if not first or first[0]:
                first, starts = [0, *first], [None, *starts]
            for lo, hi, begins in zip(first, [*first[1:], b.num_rows], starts, strict=True):
                if begins:
                    finish(lo - 1 + off)
                    here = tuple(key[:, lo].tolist())
                    was, state, deadline, held, open_to, then = begins
                    machine = Machine(config, R_UNKNOWN if not here[1] else MATCHED if was else DIVERGED_CONFIRMED) if state is None else Machine(config, state, deadline, held, open_to)
                for i in range(lo, hi):
                    ns = times[i]
                    if machine.deadline is not None and machine.deadline < ns and not (begins and i == lo) and (found := machine.timer(ns - 1)):
                        emit(i - 1 + off, *found)
                    if (found := machine.event(ns, accepted[i], masks[i], until[i])) is not None:
                        emit(i + off, ns, found)
            yield given(sides)
            out, before = [], [x[-1:] for x in sides]
        if machine:
            finish(0)
            yield given(before)

    # without parts, acceptance or the views' windows have put each order into one task
    out = folded(rows, keys, list(ORDER), fold, STEPS, together=not parts)
    return out.withColumn("part", F.lit(0)) if parts else out


def two_stage(viewed: DataFrame, config: ReconConfig = ReconConfig()) -> DataFrame:
    """(order_key, detect_ns, mask, ..., type, emitted) of mismatches that outlast the grace period, and invalid events.

    Where viewed has until_ns (see `sequence.uncertain`), mismatches wait for the gaps that make their order uncertain.
    """
    rows = reconciled(viewed, config, ends=False).filter("mask is not null").drop("segment", "state", *COUNTERS)
    rows = rows.withColumn("type", mask_type("mask", F.col("p_status").isNotNull() & F.col("d_status").isNull()))
    return deduplicated(rows, config.dedup_ns).drop("part")


def two_stage_counters(viewed: DataFrame, config: ReconConfig = ReconConfig()) -> DataFrame:
    """COUNTERS and divergence_deduped, in one pass over the events."""
    rows = deduplicated(reconciled(viewed, config), config.dedup_ns)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.count_if(~F.col("emitted")).alias("divergence_deduped"))


def recon_states(viewed: DataFrame, config: ReconConfig = ReconConfig()) -> DataFrame:
    """(order_key, state, label, terminal): where each order's reconciliation ends."""
    rows = reconciled(viewed, config).filter("state is not null").groupBy("order_key").agg(F.max_by("state", "segment").alias("state"))
    label = F.element_at(F.array(*map(F.lit, RECON_NAMES)), F.col("state") + 1)
    return rows.select("order_key", "state", label.alias("label"), F.col("state").isin(*TERMINAL_STATES).alias("terminal"))
