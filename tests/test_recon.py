"""Every query against its SQL, and small cases by hand."""

import builtins
import random
import re
import time
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from twinledger.config import MS, ReconConfig
from twinledger.functions.keys import order_key
from twinledger.operators import machine, orders, sequence
from twinledger.plans import oracle, queries
from twinledger.schema import may_follow
from twinledger.sources import feeds, fix, wire
from twinledger.storage import CLEANUP, shared_dir, written

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", queries.NAMES)
def test_against_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    quoted = ", ".join(f'"{n}"' for n in names)
    wanted = con.execute(f"SELECT {quoted} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*names).collect()) == plain(wanted)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


#: What may follow each status, by name, written out.
ALLOWED = """
New: New Working PartiallyFilled Filled CancelPending Rejected
PartiallyFilled: PartiallyFilled Filled CancelPending
Filled: Filled
Canceled: Canceled
Replaced: Replaced Working PartiallyFilled Filled CancelPending Rejected
Rejected: Rejected
Unknown: New PartiallyFilled Filled Canceled Replaced Rejected Unknown PendingNew Working CancelPending
PendingNew: PendingNew Working PartiallyFilled Filled CancelPending Rejected
Working: Working PartiallyFilled Filled CancelPending Rejected
CancelPending: CancelPending Canceled Rejected PartiallyFilled Filled
"""


def test_transitions(spark):
    table = {k: v.split() for k, v in (line.split(":") for line in ALLOWED.split("\n") if line)}
    names = list(table)
    assert all(may_follow(a, b) == (names[b] in table[names[a]]) for a in range(10) for b in range(10))
    # codes beyond the known ones follow the unknown status and themselves
    assert may_follow(6, 77) and may_follow(77, 77) and not may_follow(77, 2) and not may_follow(0, 77)


EVENTS = "order_key long, source int, r int, ord_status int, cum_qty long, price_micro long, ingest_ns long, transact_time long, exec_id string"


def feed(spark, *rows):
    """(source, status, cum, price, ms, exec id)"""
    data = [(1, s, i, st, cum, px, t * MS, t * MS, x) for i, (s, st, cum, px, t, x) in enumerate(rows)]
    return orders.views(orders.lifecycle(spark.createDataFrame(data, EVENTS)))


def test_matched_within_grace(spark):
    view = feed(spark, (0, 2, 100, 5000, 0, "E"), (1, 2, 100, 5000, 10, "E"))
    assert orders.two_stage(view).count() == 0
    c = orders.two_stage_counters(view).first()
    assert (c.mismatch_observed, c.false_positive_avoided, c.orders_matched, c.mismatch_confirmed) == (1, 1, 1, 0)


@pytest.mark.parametrize(("rows", "kind"), [
    ([(0, 8, 100, 5, 0, "E"), (1, 8, 200, 5, 10, "E")], 3),
    ([(1, 2, 100, 5, 0, "E")], 1),
    ([(0, 2, 100, 5, 0, "E")], 5),
    ([(0, 2, 100, 5, 0, "E"), (1, 2, 100, 5, 10, "F")], 2),
])
def test_confirmed_after_grace(spark, rows, kind):
    found = orders.two_stage(feed(spark, *rows), ReconConfig(grace_ns=100 * MS)).collect()
    assert [(r.type, r.emitted) for r in found] == [(kind, True)]
    assert orders.two_stage(feed(spark, *rows), ReconConfig(grace_ns=100 * MS, horizon_ns=50 * MS)).count() == 0


def test_confirmed_then_resolved(spark):
    view = feed(spark, (0, 8, 100, 5, 0, "E"), (1, 8, 200, 5, 5, "E"), (1, 8, 100, 5, 100, "E"))
    c = orders.two_stage_counters(view, ReconConfig(grace_ns=10 * MS)).first()
    assert (c.mismatch_confirmed, c.divergence_resolved) == (1, 1)


def test_tolerance(spark):
    view = feed(spark, (0, 8, 100, 5, 0, "E"), (1, 8, 95, 9, 5, "E"))
    assert orders.two_stage(view, ReconConfig(qty_tolerance=5, px_tolerance=4)).count() == 0
    assert orders.two_stage(view, ReconConfig(qty_tolerance=4, px_tolerance=4)).count() == 1


def test_dedup(spark):
    rows = [(1, t * MS, 2) for t in (50, 100, 2000)] + [(2, 0, 2), (2, MS, 1), (2, 2 * MS, 2)]
    out = orders.deduplicated(spark.createDataFrame(rows, "order_key long, detect_ns long, mask int"), 1000 * MS).collect()
    assert sorted((r.order_key, r.detect_ns // MS, r.emitted) for r in out) == [(1, 50, True), (1, 100, False), (1, 2000, True), (2, 0, True), (2, 1, True), (2, 2, True)]


@pytest.mark.parametrize(("view", "kind"), [
    ([(0, 8, 37, 412, 0, "a"), (1, 8, 37, 412, 3, "b")], None),
    ([(0, 7, 37, 412, 0, "a"), (1, 1, 61, 399, 3, "a")], 0),
    ([(1, 7, 3, 8, 0, "a")], 1),
    ([(0, 1, 73, 8, 0, "a"), (1, 9, 73, 8, 3, "a")], 2),
    ([(0, 1, 19, 8, 0, "a"), (1, 1, 23, 8, 3, "a")], 3),
    ([(1, 1, 19, 8, 0, "a"), (0, 1, 19, 8, 3, "a")], 4),
])
def test_immediate(spark, view, kind):
    found = orders.immediate(feed(spark, *view)).orderBy("detect_ns").collect()
    assert (found[-1].type if found else None) == kind


def test_immediate_tolerances(spark):
    last = lambda view, **c: [r.type for r in orders.immediate(view, ReconConfig(**c)).orderBy("detect_ns").collect()][-1:]
    view = feed(spark, (0, 1, 19, 8, 0, "a"), (1, 1, 23, 11, 3, "a"))
    assert last(view, qty_tolerance=4, px_tolerance=3) == [] and last(view, qty_tolerance=3, px_tolerance=3) == last(view, qty_tolerance=4, px_tolerance=2) == [3]
    view = feed(spark, (1, 1, 19, 8, 0, "a"), (0, 1, 19, 8, 3, "a"))
    assert last(view, timing_slack_ns=3 * MS) == [1] and last(view, timing_slack_ns=3 * MS - 1) == [4]


def test_full_range_difference(spark):
    row = spark.createDataFrame([(2**63 - 1, -(2**63))], "a long, b long")
    assert row.select(orders.apart("a", "b", 0).alias("x")).first().x


def suppression(spark, rows, until, **config):
    """Counters and (ms, type) of one order's events; until: the last ms of a gap that each event is in."""
    data = [(1, s, i, st, cum, px, t * MS, t * MS, x, None if u is None else u * MS) for i, ((s, st, cum, px, t, x), u) in enumerate(zip(rows, until, strict=True))]
    view = orders.views(orders.lifecycle(spark.createDataFrame(data, EVENTS + ", until_ns long")))
    made = ReconConfig(grace_ns=10 * MS, gap_recheck_ns=7 * MS, **config)
    return orders.two_stage_counters(view, made).first().asDict(), [(r.detect_ns / MS, r.type) for r in orders.two_stage(view, made).filter("emitted").collect()]


def test_gap_suppression(spark):
    lone = [(0, 1, 5, 5, 0, "a")]
    counted, found = suppression(spark, lone, [30])  # checked at 10, 17, 24; the gap is closed at 31
    assert (counted["gap_suppressions"], counted["mismatch_confirmed"], found) == (3, 1, [(31.0, 5)])
    assert suppression(spark, lone, [9])[1] == suppression(spark, lone, [None])[1] == [(10.0, 5)]
    both = [(0, 1, 5, 5, 0, "a"), (1, 1, 5, 5, 20, "a")]
    counted, found = suppression(spark, both, [30, 30])  # agrees at 20 but the gap is open: decided by the check at 24
    assert (counted["gap_suppressions"], counted["orders_matched"], counted["false_positive_avoided"], found) == (2, 1, 1, [])
    soon = [(0, 1, 5, 5, 0, "a"), (1, 1, 5, 5, 16, "a")]
    counted, found = suppression(spark, soon, [15, None])  # the event after the gap decides
    assert (counted["gap_suppressions"], counted["orders_matched"], counted["false_positive_avoided"], found) == (1, 1, 0, [])
    again = [(0, 1, 5, 5, 0, "a"), (1, 1, 6, 5, 16, "a")]
    counted, found = suppression(spark, again, [15, None])  # a new grace period after the gap
    assert (counted["mismatch_observed"], found) == (2, [(26.0, 3)])
    assert suppression(spark, again, [15, None], horizon_ns=26 * MS)[1] == []


def test_uncertain(spark):
    """The event that opens a gap is in it, the one that fills it not, and others of its session, of either feed, are."""
    rows = [(0, 0, 1, 10), (0, 0, 4, 20), (1, 0, 1, 25), (0, 0, 2, 30), (1, 0, 2, 35), (0, 1, 1, 26), (1, 0, 9, 40), (1, 0, 10, 1040), (1, 0, 11, 1041)]
    events = spark.createDataFrame([(i, s, n, q, t * MS) for i, (s, n, q, t) in enumerate(rows)], "i int, source int, session_id int, seq long, arrival long")
    for block in (15 * MS, orders.BLOCK_NS):
        gaps = sequence.timed_gap_intervals(sequence.classify(events.drop("i"), block), F.col("arrival"), block=block)
        got = {r.i: (r.gap_flags, r.p_epoch, r.d_epoch, r.until_ns) for r in sequence.uncertain(events, gaps, block).collect()}
        p, d, none = (1, 1, None, 30 * MS - 1), (2, None, 1, 1040 * MS), (None,) * 4
        assert got == {0: none, 1: p, 2: p, 3: none, 4: none, 5: none, 6: d, 7: d, 8: none}


def random_events(n, seed, orders_=1):
    r = random.Random(seed)
    status = lambda: r.choice([0, 8, 8, 1, 1, 1, 2, 3, 9, 6, 77])
    return [(r.randrange(orders_), r.randrange(2), i, status(), r.choice([1, 2]), 5, t * MS, t * MS, r.choice("ab"), r.choice([None, None, None, (t + 40) * MS])) for i, t in enumerate(sorted(r.sample(range(20 * n), n)))]


@pytest.mark.parametrize("seed", range(2))
def test_hot_order(spark, seed):
    """An order with nine tenths of all events is taken in parts by several tasks; results are the same."""
    rows = [(0, *x[1:]) if i % 10 else (1 + x[0], *x[1:]) for i, x in enumerate(random_events(600, seed, 3))]
    events = spark.createDataFrame(rows, EVENTS + ", until_ns long").repartition(4)
    split = orders.parted(events, hot=100, block_ns=500 * MS)
    assert split.filter(F.col("order_key") == 0).select("part").distinct().count() > 10 and split.filter(F.col("part") == orders.ORDINARY).count() == 60
    config = ReconConfig(grace_ns=30 * MS, dedup_ns=200 * MS, gap_recheck_ns=7 * MS)
    results = []
    for given in (events, split):
        accepted = orders.lifecycle(given)
        view = orders.views(accepted)
        results.append([
            sorted(map(str, accepted.select(*events.columns, "accepted").collect())),
            sorted(map(str, view.select("order_key", *orders.ORDER, *orders.SIX).collect())),
            sorted(map(str, orders.two_stage(view, config).collect())),
            orders.two_stage_counters(view, config).first().asDict(),
            sorted(map(str, orders.immediate(view, config).collect())),
            sorted(map(str, orders.recon_states(view, config).collect())),
        ])
    assert results[0] == results[1]
    now = {}
    for key, source, r, status, *_ in rows:  # the life of each order and feed, one event after another
        good = may_follow(now.get((key, source), 6), status)
        assert f"accepted={good}" in next(x for x in results[0][0] if f"r={r}," in x and f"order_key={key}," in x)
        if good:
            now[key, source] = status
    segments = orders.reconciled(orders.views(orders.lifecycle(split)), config).filter("order_key = 0 and state is not null")
    assert segments.count() > 5


def test_machine_against_a_plain_one():
    """One event or timer at a time, by the table of states."""
    for seed in range(200):
        r = random.Random(seed)
        config = ReconConfig(grace_ns=r.choice([5, 20]), gap_recheck_ns=r.choice([1, 7]))
        machine, got, wanted = orders.Machine(config), [], []
        state, mask, due, until, n = 0, 0, None, -1, [0] * 6
        times = sorted(r.sample(range(300), 25))
        for i, t in enumerate([*times, 1000]):
            while due is not None and due < t:
                if not mask:
                    state, due = 4, None
                    n[2], n[3] = n[2] + 1, n[3] + 1
                elif until >= due:
                    state, due = 6, due + config.gap_recheck_ns
                    n[5] += 1
                else:
                    wanted.append((due, mask))
                    state, due = 5, None
                    n[1] += 1
            if found := machine.timer(t - 1):
                got.append(found)
            if t == 1000:
                break
            good, m, u = i == 0 or r.random() < 0.9, 16 if i == 0 else r.choice([0, 0, 1, 2]), r.choice([None, None, t + 30])
            if (found := machine.event(t, good, m, u)) is not None:
                got.append((t, found))
            until = max(until, -1 if u is None else u)
            if not good:
                state, due = 5, None
                n[1] += 1
                wanted.append((t, 1))
                continue
            mask = m
            if state in (0, 4) and m or state == 6 and until < t and m:
                state, due = 3, t + config.grace_ns
                n[0] += 1
            elif state == 3 and not m:
                state, due = 4, None
                n[2], n[3] = n[2] + 1, n[3] + 1
            elif state == 5 and not m:
                state = 4
                n[4] += 1
            elif state == 6 and until < t:
                state, due = 4, None
                n[3] += 1
        assert (got, machine.n, machine.state) == (wanted, n, state)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_an_order_compose(seed):
    """What a block makes of every state before it is what the machine comes to from there, and so over many blocks."""
    r = random.Random(seed)
    for _ in range(150):
        config = ReconConfig(grace_ns=r.choice([3, 5, 20, 60]), gap_recheck_ns=r.choice([1, 4, 7, 25]))
        events, at, until = [], 0, None
        agrees, gap, apart = r.choice([0.1, 0.5, 0.9]), r.choice([0, 0.2, 0.6]), r.choice([2, 9, 30])
        for _ in range(r.randrange(1, 40)):
            at += r.randrange(apart + 1)
            if r.random() < gap:
                until = max(until or 0, at + r.randrange(50))
            events.append((at, r.random() < 0.97, 0 if r.random() < agrees else r.choice([1, 2]), until))
        first = events[0][0]
        made = machine.Ways(config, first)
        for e in events:
            made.take(*e)
        starts = [(4, None), (5, None)] + [(3, first + i) for i in range(config.grace_ns + 1)] + [(6, first + i) for i in range(config.gap_recheck_ns)]
        for state, deadline in starts:
            plain = machine.Machine(config, state, deadline, 1, first)
            if state == 6 and until is None:
                plain.until = first - 1
            for i, e in enumerate(events):
                if i:
                    plain.timer(e[0] - 1)
                if e[3] is None or i == 0:
                    plain.until = e[3] if e[3] is not None else (first - 1 if state == 6 else None)
                plain.event(*e)
            assert machine.after_block(state, deadline, made.ends(), config.gap_recheck_ns) == (plain.state, plain.deadline)


@pytest.mark.parametrize("gaps", [False, True])
def test_hot_order_that_never_agrees(spark, gaps):
    """One segment with nine tenths of all events is gone through in blocks, by several tasks."""
    r = random.Random(5)
    statuses = [(0, 8, 5), (1, 8, 6)]  # quantities that differ throughout
    rows = [(0, s, i, st, q, 5, i * 9 * MS, i * 9 * MS, "a", (i * 9 + r.randrange(60)) * MS if gaps and i % 40 < 12 else None) for i in range(450) for s, st, q in [statuses[i % 2]]]
    rows += [(1 + x[0], *x[1:]) for x in random_events(50, 5, 3)]
    events = spark.createDataFrame(rows, EVENTS + ", until_ns long").repartition(4)
    config = ReconConfig(grace_ns=30 * MS, dedup_ns=200 * MS, gap_recheck_ns=7 * MS)
    view = lambda e: orders.views(orders.lifecycle(e))
    whole, split = view(events), view(orders.parted(events, hot=100, block_ns=500 * MS)).cache()
    parts = orders.reconciled(split, config, 16)
    names = [c for c in parts.columns if c not in ("part", "segment", "state", *orders.COUNTERS)]
    rows_of = lambda d: sorted(map(str, d.filter("mask is not null").select(names).collect()))
    plain = orders.reconciled(whole, config)
    assert rows_of(parts) == rows_of(plain)
    totals = lambda d: d.agg(*[F.sum(c).alias(c) for c in orders.COUNTERS]).first().asDict()
    assert totals(parts) == totals(plain)
    states = lambda d: sorted(map(tuple, d.filter("state is not null").groupBy("order_key").agg(F.max_by("state", "segment")).collect()))
    assert states(parts) == states(plain)
    assert parts.filter("order_key = 0 and mask is null").groupBy("segment").count().agg(F.max("count")).first()[0] > 20
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, False)
    try:
        tasks = orders.reconciled(split, config, 16).filter("order_key = 0").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset(merging)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hot_tracker(spark):
    """A tracker with nine tenths of all arrivals, in blocks of 16."""
    r = random.Random(3)
    rows = []
    for session, n in ((0, 900), (1, 100)):
        seq = 0
        for i in range(n):
            step = r.choice([1, 1, 1, 1, 2, 4, -1, -3, 0])
            rows.append((0, session, max(1, seq + step), i, i * r.choice([300])))
            seq = max(seq, seq + step)
    arrivals = spark.createDataFrame(rows, "source int, session_id int, seq long, arrival long, ms long").repartition(5)
    by_hand = arrivals.filter("arrival % 41 = 7").select("source", "session_id", "arrival", "ms")
    for config in (None, ReconConfig(gap_close_ns=900 * MS, gap_timeout_ns=2000 * MS)):
        for hands in (None, by_hand):
            wanted = plain_gaps(rows, config, set(map(tuple, hands.select("session_id", "arrival").collect())) if hands else set())
            for block in (16, 65_536):
                seen = sequence.classify(arrivals, block)
                if config:
                    got = sequence.timed_gap_intervals(seen, F.col("ms") * MS, config, hands, block).select("session_id", "epoch", "start_seq", "end_seq", "opened", "closed", "filled_by", "reason", "closed_ns")
                else:
                    got = sequence.gap_intervals(seen, hands, block).select("session_id", "epoch", "start_seq", "end_seq", "opened", "closed", "filled_by", "reason", F.lit(None))
                assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


@pytest.mark.parametrize("block", [16, orders.CANDIDATES])
def test_long_run_of_one_mask(spark, block):
    """One order has nine tenths of all candidates, most of them in one run, which several tasks share."""
    r = random.Random(block)
    rows, at = [], 0
    for i in range(900):
        at += r.choice([1, 3, 9, 9, 40]) if i % 300 else 500
        rows.append((0, at, 2 if i % 450 else 8, i, 0))
    rows += [(1 + i % 20, 10 * i, r.choice([2, 8]), i, 0) for i in range(100)] + [(0, None, None, -1, 0)]
    rows = [x for i, x in enumerate(rows) if not i or x[:2] != rows[i - 1][:2]]
    table = spark.createDataFrame(rows, "order_key long, detect_ns long, mask int, i int, part int").repartition(4)
    wanted, last = {}, {}
    for key, ns, mask, i, _ in sorted(rows, key=lambda x: (x[0], x[1] or 0)):
        if mask is not None:
            before = last.get(key)
            emit = before is None or before[1] != mask or ns - before[0] >= 50
            last[key] = (ns, mask) if emit else before
            wanted[key, i] = emit
    wanted[0, -1] = None
    for t in (table, table.drop("part")):
        assert {(x.order_key, x.i): x.emitted for x in orders.deduplicated(t, 50, block).collect()} == wanted
    assert 20 < sum(v is True for k, v in wanted.items() if not k[0]) < 800


@pytest.mark.parametrize("seed", range(8))
def test_blocks_of_gaps_compose(seed):
    """Summaries of blocks, carried along a tracker, give the gaps of going through it at once; some trackers never close."""
    r = random.Random(seed)
    for _ in range(300):
        config = r.choice([None, ReconConfig(gap_close_ns=r.choice([20, 10**9]), gap_timeout_ns=r.choice([30, 90, 10**9]))])
        rows, last, ns, g = [], 1, 0, (None, None, None)
        late = r.random() < 0.6
        for arrival in range(r.randrange(1, 60)):
            ns += r.choice([0, 1, 5, 25])
            kind = r.choice([0, 0, 2, 2, 2, 4] if late else [0, 2])
            seq, expected = (last + r.randrange(2, 6), last + 1) if kind == 0 else (r.randrange(1, last + 1) if late else 1, last + 1) if kind == 2 else (None, None)
            rows.append((arrival, kind, seq, expected, ns, *g))
            if kind == 0:
                last, g = seq, (seq, arrival, ns)
            elif kind == 2 and r.random() < 0.5:
                last += 1
        whole = list(sequence._folded([(*x, None, None, None, 0, True) for x in rows], config))
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(r.randrange(12)))})
        gap, epoch, parts = None, 0, []
        for a, b in zip(cuts, cuts[1:]):
            parts += sequence._folded([(*x, *(gap or (None,) * 3), epoch, b == len(rows)) for x in rows[a:b]], config)
            gap, opened = sequence._carried(gap, sequence._summary(rows[a:b], config), config)
            epoch += opened
        assert parts == whole


def test_tracker_that_never_closes(spark):
    """Its gap stays open over all of its blocks, which many tasks share."""
    rows = [(0, 0, 1, 0)] + [(0, 0, 10 + 2 * i, 2 * i + 1) for i in range(200)] + [(0, 0, 1, 2 * i + 2) for i in range(200)]
    seen = sequence.classify(spark.createDataFrame(rows, "source int, session_id int, seq long, arrival long").repartition(4), 16)
    blocks = sequence._anomalies(seen, F.lit(None), None, None, 16).repartition(8, "source", "session_id", "block").withColumn("task", F.spark_partition_id())
    assert blocks.select("block").distinct().count() > 10 and blocks.select("task").distinct().count() > 4
    assert [(r.start_seq, r.end_seq, r.opened, r.detected, r.closed, r.epoch) for r in sequence.gap_intervals(seen, block=16).collect()] == [(2, 408, 1, 399, None, 1)]


def plain_gaps(rows, config, hands):
    out = []
    for session in {x[1] for x in rows}:
        last, gap, epoch = None, None, 0
        limit = lambda g: min((g[5] + config.gap_close_ns, 1), (g[4] + config.gap_timeout_ns, 2)) if config else (None, None)
        for _, s, seq, i, ms in rows:
            if s != session:
                continue
            t = ms * MS
            if gap and config and t > limit(gap)[0]:
                out.append((s, epoch, *gap[:3], None, None, limit(gap)[1], limit(gap)[0]))
                gap = None
            if last is not None and seq > last + 1:
                if not gap:
                    epoch += 1
                gap = [gap[0] if gap else last + 1, seq, gap[2] if gap else i, None, gap[4] if gap else t, t]
            elif last is not None and seq < last and gap and gap[0] <= seq < gap[1]:
                out.append((s, epoch, *gap[:3], i, seq, 0, t if config else None))
                gap = None
            last = seq if last is None else max(last, seq)
            if gap and (s, i) in hands:
                out.append((s, epoch, *gap[:3], i, None, 3, t if config else None))
                gap = None
        if gap:
            out.append((session, epoch, *gap[:3], None, None, limit(gap)[1], limit(gap)[0]))
    return out


def test_wire_ids(spark):
    """Ids of any bytes: absent, of more than 32 bytes, cut within a character."""
    ids = [None, "", "plain", "é" * 16, "x" + "é" * 16, "y" * 40]
    rows = spark.createDataFrame([(i, 1, 2, 3 + i, 4, -5, 6, 7, 8, 9, x, x, "z") for i, x in enumerate(ids)], "i int, exec_type int, ord_status int, seq_num long, session_id int, price_micro long, qty long, cum_qty long, sending_time long, transact_time long, exec_id string, order_id string, clord_id string")
    got = {r.i: r for r in wire.decoded(wire.encoded(rows)).collect()}
    for i, x in enumerate(ids):
        cut = (x or "").encode()[:32].decode(errors="replace")
        assert (got[i].exec_id, got[i].order_id, got[i].clord_id, got[i].price_micro, got[i].seq_num) == (cut, cut, "z", -5, 3 + i)
    assert wire.decoded(wire.encoded(rows.limit(0))).count() == 0


def test_wire_carried(spark):
    """Records of which only so many bytes arrive: what is left decodes as it does one step after another."""
    rows = feeds.order_events(spark.read.parquet(f"{DATA}/lineitem.parquet")).withColumnsRenamed({"ingest_ns": "sending_time", "seq": "seq_num"})
    rows = rows.withColumn("exec_id", F.when(F.col("order_key") % 3 == 0, "é" * 20).when(F.col("order_key") % 3 == 1, F.col("exec_id")))
    size = wire.RECORD.itemsize
    arriving = F.element_at(F.array(*map(F.lit, [size, 0, size - 1, size + 1, None, 100])), (F.col("order_key") % 6 + 1).cast("int"))
    records = wire.encoded(rows)
    records = records.withColumn("record", F.when(F.col("order_key") % 6 == 4, F.lit(None)).otherwise(F.substring("record", F.lit(1), F.coalesce(arriving, F.lit(0)))))
    wanted, got = wire.decoded(records), wire.carried(rows, arriving)
    assert got.schema == wanted.schema and got.count() > 0
    assert plain(got.collect()) == plain(wanted.collect())
    assert wire.carried(rows.limit(0), arriving).count() == 0


def test_wire_decode_plan(spark):
    """Events cross to Python once; what goes along sessions has no texts, and sessions' parts are counted without sorting lines."""
    plan = queries.wire_decode(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1
    assert len(re.findall("row_number", plan)) == 1
    assert not re.findall("SortMergeJoin|BroadcastHashJoin", plan) and "ShuffledHashJoin" in plan
    assert "concat(" in plan and "concat(" not in plan[plan.index("Exchange") :]


def test_orders_go_along_sessions(spark):
    """What is shuffled by session is orders with their lines; messages are made of them after that."""
    plan = queries.order_events(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange")
    assert plan[at:].startswith("Exchange hashpartitioning(session_id") and "array_remove" in plan[:at]


@pytest.mark.parametrize("name", ["order_events", "wire_decode"])
def test_orders_of_many_lines(spark, tmp_path, name):
    """Orders of more lines than are counted out at once, and with equal lines, are numbered as in SQL."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM '{DATA}/lineitem.parquet' UNION ALL SELECT l.* REPLACE (20 * (i % 2) + 7 AS l_orderkey, i // 4 AS l_linenumber)
        FROM range({2 * feeds.LINES + 3}) t(i), (SELECT * FROM '{DATA}/lineitem.parquet' LIMIT 1) l) TO '{tmp_path}/lineitem.parquet'""")
    df = queries.queries()[name](spark, str(tmp_path))
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(df.collect()) == plain(wanted)


@pytest.mark.parametrize("lacking", ["twinledger.llm", "tiktoken", "corpus_pipeline"])
def test_entry_without_what_the_corpus_part_needs(monkeypatch, lacking):
    import sys

    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.split(".")[0] == lacking or name.startswith(lacking):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for name in [m for m in sys.modules if m.startswith("twinledger.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(queries.NAMES) <= set(__spark_entry__.queries()) and set(queries.NAMES) <= set(__spark_entry__.oracle_sql())
    assert "pipeline" not in __spark_entry__.queries()


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "yarn", "spark.sql.warehouse.dir": "/w"})

    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(Session) == "hdfs://x/y"
    Session.conf = Conf({"spark.master": "local[2]", "spark.sql.warehouse.dir": "/w"})
    assert shared_dir(Session) == "/w/_shared"


@pytest.mark.parametrize("block", [2, 65_536])
def test_gaps(spark, block):
    seqs = {0: [1, 4, 8, 3], 1: [1, 5, 3], 2: [1, 2, 5, 5], 3: [10, 11, 15, 10], 4: [1, 2, 2]}
    rows = spark.createDataFrame([(0, s, q, i) for s, qs in seqs.items() for i, q in enumerate(qs)], "source int, session_id int, seq long, arrival long")
    found = sequence.classify(rows, block)
    kinds = {s: [r.kind for r in found.filter(F.col("session_id") == s).orderBy("arrival").collect()] for s in seqs}
    assert kinds == {0: [None, 0, 0, 2], 1: [None, 0, 2], 2: [None, None, 0, 1], 3: [None, None, 0, 2], 4: [None, None, 1]}
    gaps = {r.session_id: (r.epoch, r.start_seq, r.end_seq, r.opened, r.closed, r.filled_by) for r in sequence.gap_intervals(found, block=block).collect()}
    assert gaps == {0: (1, 2, 8, 1, 3, 3), 1: (1, 2, 5, 1, 2, 3), 2: (1, 3, 5, 2, None, None), 3: (1, 12, 15, 2, None, None)}


@pytest.mark.parametrize(("text", "result"), [
    ("8=FIX.4.4|35=8|39=1|150=1|11=own-7|17=x9|32=35|31=1204500|14=61|60=77|52=76|37=venue-3|", 0),
    ("8=FIX.4.4|35=8|39=1|150=1|17=x9|32=35|31=1204500|14=61|60=77|", 1),
    ("35=D|150=2|39=2|17=E1|11=C|31=1|32=2|52=1|", 2),
    ("150=2|39=2|17=E1|11=C|31=1|32=2|52=1|", 0),
    ("035=8|150=2|39=2|17=E1|11=C|31=1|32=2|52=1", 0),
    ("35=8|150=2|39=2|17=E1|11=C|31=+1|32=2|52=1|", 2),
    ("35=8|150=2|39=2|17=E1|11=C|31= 1|32=2|52=1|", 2),
    ("35=8|150=2|39=2|17=E1|11=C|31=-1|32=2|52=-1|", 2),
    ("35=8|150=2|39=2|17=E1|11=C|31=1|32=2|52=1|noise", 0),
    ("35=8|noise|150=2|39=2|17=E1|11=C|31=1|32=2|52=1|", 2),
    ("35=8||150=2|39=2|17=E1|11=C|31=1|32=2|52=1|", 2),
    ("35=8|150=2|39=2|17=a=b|11=C|31=1|32=2|14=1|14=x|52=1|", 2),
    ("35=8|150=2|39=2|17=E1|11=C|31=99999999999999999999|32=2|52=1|", 2),
    ("35=8|150=2|39=2|17=E1|11=|31=1|32=2|52=1|", 1),
    ("35=8|150=2|39=2|17=E1|11=|37=|31=1|32=2|52=1|", 1),
    ("35=8|150=2|39=2|17=E1|11=A|11=|31=1|32=2|52=1|", 1),
    ("35=8|150=2|39=2|17=E1|11=A|11=|37=B|31=1|32=2|52=1|", 0),
    ("35=8|150=2|39=2|17=|11=A|31=1|32=2|52=1|", 0),
    ("35=8|150=2|39=2|17=E1|11=C|31=1|32=2|52=18446744073709551615|", 0),
    ("35=8|150=2|39=2|17=E1|11=C|31=1|32=2|52=18446744073709551616|", 2),
    ("35=8|150=2|39=2|17=E1|11=C|31=9223372036854775808|32=2|52=1|", 2),
    (None, 1),
])
def test_fix(spark, text, result):
    rows = spark.createDataFrame([(text,)], "raw string").withColumn("message", fix.pipe_to_soh("raw"))
    assert fix.parse(rows).first().parse_result == result


def test_fix_fields(spark):
    text = "35=8|150=F|39=6|17=a=b|11=" + "X" * 40 + "|31=1|32=2|14=7|14=9|52=5|60=0|"
    row = fix.parse(spark.createDataFrame([(text,)], "raw string").withColumn("message", fix.pipe_to_soh("raw"))).withColumn("at", fix.event_time()).first()
    assert (row.exec_type, row.ord_status, row.exec_id, row.clord_id, row.cum_qty, row.at) == (6, 9, "a=b", "X" * 32, 9, 5)


def test_sides_with_acceptance_as_by_windows(spark):
    """Views that come with acceptance, in one pass over each order, are those of the windows, over small batches too; what is
    reconciled from them is alike, and nothing is shuffled or sorted again for them."""
    r = random.Random(8)
    data = [(k, r.randrange(2), i, r.choice((0, 1, 1, 2, 5, 7, 8, 9)), 10, r.choice((1, 2)), r.choice((5, 6)), r.randrange(900) * MS, i, r.choice("ab")) for k in range(40) for i in range(r.randrange(1, 60))]
    events = spark.createDataFrame(data, "order_key long, source int, r int, ord_status int, qty long, price_micro long, cum_qty long, ingest_ns long, transact_time long, exec_id string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            windows, one_pass = (orders.views(orders.lifecycle(events, sides)) for sides in (False, True))
            assert plain(one_pass.select(*windows.columns).collect()) == plain(windows.collect())
            for made in (orders.two_stage, orders.two_stage_counters, orders.recon_states):
                assert plain(made(one_pass).collect()) == plain(made(windows).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    physical = one_pass._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and physical.count("Sort ") == 1 and "Window" not in physical


def test_tasks_grow_with_the_lines_and_rows_are_shuffled_once(spark):
    """Lines are dealt over tasks by their number, and what follows along orders needs no further shuffle of events; for
    suppression, only what numbers an event goes along its session."""
    before = spark.conf.get(queries.INITIAL, None)
    try:
        assert queries._tasks(spark, DATA, 500) == spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500 > 4
        assert spark.conf.get(queries.INITIAL) == str(queries._tasks(spark, DATA, 500))
    finally:
        spark.conf.unset(queries.INITIAL) if before is None else spark.conf.set(queries.INITIAL, before)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    rows = orders.views(orders.lifecycle(queries.feeds.order_events(lines, False, 9), True, 9))
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert physical(rows).count("Exchange") == 1 and "hashpartitioning(order_key#" in physical(rows) and ", 9)" in physical(rows)
    assert "exec_id" not in physical(queries.marked_keys(spark, DATA))
    carrying = [x for x in physical(queries.guarded(spark, DATA)).split("\n") if "Exchange hashpartitioning(order_key" in x and "plan_id" in x]
    assert len(carrying) == 2  # the lines, and the keys of uncertain events


def test_written_views_are_dealt_by_order_again(spark):
    """A table's rows may come back in any split; end_to_end puts each order into one task before its machine runs."""
    physical = queries.end_to_end(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    branch = physical[physical.index("MapInArrow fold(order_key") :]
    first = [x for x in branch[branch.index("MapInArrow fold(order_key", 1) :].split("\n") if "Exchange" in x or "FileScan" in x][0]
    assert "Exchange hashpartitioning(order_key" in first


def test_end_to_end_carries_events_once(spark, monkeypatch):
    """Both modes read one shuffle of narrow events; hot orders go by parts by themselves, with the same results."""
    whole = queries.end_to_end(spark, DATA)
    rows = sorted(map(tuple, whole.collect()), key=repr)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "clord_id" not in plan
    assert "ReusedExchange" in plan
    monkeypatch.setattr(orders, "HOT", 200)
    ordinary, hot = orders.hot_apart(queries.keyed(queries._parsed(spark, DATA)).withColumn("ingest_ns", F.col("sending_time")))
    assert "part" not in ordinary.columns and {r.order_key for r in hot.select("order_key").distinct().collect()} == {spark.range(1).select(order_key(F.lit(""))).first()[0]}
    assert sorted(map(tuple, queries.end_to_end(spark, DATA).collect()), key=repr) == rows


def test_running_shuffles_no_values(spark):
    """What is aggregated along a key is worked out behind the shuffle of its rows, not carried through it."""
    feed = spark.range(10).selectExpr("0 AS source", "0 AS session_id", "id AS seq", "id AS arrival")
    plan = sequence.classify(feed)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL") :].split("Exchange")[0]
    assert "_part" in below and "_last_seen" not in below


def test_written_keeps_no_shuffle_files(spark):
    """What was shuffled for a written table goes when that is done."""
    kept = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = kept()
    assert written(spark.range(10_000).repartition(7, "id"), "cleaned").count() == 10_000
    end = time.time() + 20
    while time.time() < end and any(f.stat().st_size > 10_000 for f in kept() - before):
        time.sleep(0.1)
    assert not any(f.stat().st_size > 10_000 for f in kept() - before)
    assert spark.conf.get(CLEANUP) == "false"


def test_fix_batches_as_single_messages(spark):
    """What numpy makes of a batch of plain and odd messages, against a plain reading of each; plain ones need no pattern."""
    r, want = random.Random(4), {}
    values = ["8", "D", "", "1", "-1", "12x", "A", "7", "X" * 40, "é" * 20, "a=b", "1" * 18, "9" * 25, "0", "-", "é", "-007"]
    texts = ["|".join(f"{r.choice((8, 35, 150, 39, 31, 32, 14, 17, 11, 37, 52, 60, 9999, *('035', '-5', 'x', '')) if r.random() < 0.1 else list(fix.TAGS))}={r.choice(values)}" for _ in range(r.randrange(14))) for _ in range(300)]
    texts += [None, "", "|", "noise", "35=8|noise|31=1", "|35=8", *("|".join(["35=8", "150=2", "39=2", "17=e", "11=c", "31=5", "32=6", "52=7", *x]) for x in ([], [""], ["14=1", "14=2"], ["31=-4"], ["60=x"], ["11="], ["noise"]))]

    def number(v, signed):
        whole = v is not None and re.fullmatch(r"-?[0-9]+" if signed else "[0-9]+", v, re.ASCII)
        x = int(v) if whole else None
        return None if x is None or not (-(2**63) <= x < 2**63 if signed else x < 2**64) else x - (x >> 63 << 64) if not signed else x

    for i, text in enumerate(texts):
        last, bad, parts = {}, False, (text or "").split("|")
        for j, part in enumerate(parts):
            if "=" not in part:
                bad |= any("=" in x for x in parts[j + 1 :])
                continue
            tag, v = part.split("=", 1)
            if not re.fullmatch("-?[0-9]+", tag, re.ASCII):
                bad = True
                continue
            name = fix.TAGS.get(int(tag)) if tag[0] != "-" else None
            bad |= name == "msg_type" and v[:1] != "8" or name in ("exec", "status") and not v or name in fix.NUMBERS and number(v, name in fix.NUMBERS[:3]) is None
            last[name] = v
        lacks = not (last.get("clord_id") or last.get("order_id")) or not {"exec", "status", "price", "qty", "exec_id"} <= last.keys() or not {"sending", "transact"} & last.keys()
        cut = lambda v: v.encode()[:32].decode(errors="replace")
        want[i] = (2 if bad else 1 if lacks else 0, fix.EXEC_TYPES.get(last.get("exec", "")[:1], 6), fix.STATUSES.get(last.get("status", "")[:1], 6), *(number(last.get(n), n in fix.NUMBERS[:3]) or 0 for n in fix.NUMBERS), *(cut(last.get(n, "")) for n in fix.ID_NAMES))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(3).withColumn("message", fix.pipe_to_soh("raw"))
    got = {x[0]: tuple(x)[3:] for x in fix.parse(rows).collect()}
    assert got == want and {x[0] for x in want.values()} == {0, 1, 2}
    plain = fix.plain_fields(pa.array([fix.SOH + (t or "").replace("|", fix.SOH) for t in texts])).to_pylist()
    assert all(tuple(p.values())[1:5] == want[i][:4] for i, p in enumerate(plain) if p["plain"]) and sum(p["plain"] for p in plain) > 150


def test_fix_times_without_a_sign(spark):
    rows = spark.createDataFrame([(f"35=8|150=2|39=2|17=e|11=c|31=1|32=2|52={2**64 - 1}|60={2**63}|",)], "raw string").withColumn("message", fix.pipe_to_soh("raw"))
    row = fix.parse(rows).first()
    assert (row.parse_result, row.sending_time, row.transact_time) == (0, -1, -(2**63))


def test_a_filter_on_the_result_does_not_repeat_the_search(spark):
    plan = fix.parse(spark.createDataFrame([("x",)], "message string")).filter("parse_result = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:150|39)=") == 1 and plan.count("Filter (parse_result") == 1


def test_order_key(spark):
    def plain(text):
        h = 14695981039346656037
        for b in (text or "").encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h - (h >> 63 << 64)

    texts = ["", None, "CID1", "é\x00\U0001f642", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select("t", order_key("t").alias("k"))
    assert {r.t: r.k for r in rows.collect()} == {t: plain(t) for t in texts}


@pytest.mark.parametrize(
    "times, wanted",
    [
        ((0, 10, 900), [(2, 5, 900 * MS, 3)]),  # filled in time
        ((0, 10, 1010), [(2, 5, 1010 * MS, 3)]),  # at the very limit: the arrival comes first
        ((0, 10, 1011), [(2, 5, 1010 * MS, None)]),  # too late
    ],
)
def test_gap_timeouts(spark, times, wanted):
    feed = spark.createDataFrame([(0, 0, s, i, t) for i, (s, t) in enumerate(zip((1, 5, 3), times), 1)], "source int, session_id int, seq long, arrival long, ms long")
    got = sequence.timed_gap_intervals(sequence.classify(feed), F.col("ms") * MS).collect()
    assert [(r.start_seq, r.end_seq, r.closed_ns, r.filled_by) for r in got] == wanted


def test_gap_that_keeps_growing(spark):
    """Extended every 900 ms, so that only the long timeout ends it; the next gap is a new one."""
    feed = spark.createDataFrame([(0, 0, 1, 0, 0)] + [(0, 0, 3 * i, i, 900 * i) for i in range(1, 40)], "source int, session_id int, seq long, arrival long, ms long")
    got = sequence.timed_gap_intervals(sequence.classify(feed), F.col("ms") * MS).orderBy("epoch").collect()
    assert [(r.start_seq, r.end_seq, r.closed_ns // MS) for r in got] == [(2, 102, 30_900), (103, 117, 36_100)]


def test_empty(spark):
    none = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(0)
    view = orders.views(orders.lifecycle(queries.feeds.order_events(none)))
    assert orders.immediate(view).count() == orders.two_stage(view).count() == 0
