"""Streams against their batch forms: the same rows, however the input falls into batches."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from twinledger.config import MS, ReconConfig
from twinledger.operators import amendments, orders, sequence
from twinledger.plans import queries
from twinledger.sources import wire
from twinledger.streaming import late, processors, sessions

DATA = "/root/testdata/sf0.001"


def streamed(spark, parts, transform, tmp_path):
    """The rows of a stream over the parts, one batch each."""
    at = str(tmp_path / "in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(at)
    query = processors.to_parquet(transform(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def rows(df, names):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*names).collect())


def in_thirds(spark, events):
    """The events by time, and an event of order -1 an hour later, after which all else is decided."""
    end = events.agg(F.max("ingest_ns")).first()[0]
    stop = events.limit(1).withColumns({"order_key": F.lit(-1).cast("long"), "ingest_ns": F.lit(end + 3_600_000 * MS)})
    third = F.expr(f"ingest_ns div {end // 3 + 1}")
    return [*(events.filter(third == i) for i in range(3)), stop]


@pytest.mark.parametrize("mode", ["two_stage", "immediate"])
def test_modes(spark, tmp_path, mode):
    events = queries.events(spark, DATA).filter("order_key > 0 and order_key % 9 = 0").cache()
    names = [x.split()[0] for x in processors.DIVERGENCES.split(", ")]
    view = orders.views(orders.lifecycle(events))
    want = rows(orders.two_stage(view).filter("emitted") if mode == "two_stage" else orders.immediate(view), names)
    got = streamed(spark, in_thirds(spark, events), getattr(processors, mode), tmp_path)
    assert want and rows(got.filter("order_key != -1"), names) == want


def test_closed_gaps(spark, tmp_path):
    events = queries.events(spark, DATA, True).cache()
    feed = events.select("order_key", "source", "session_id", "seq", "ingest_ns")
    arrivals = feed.select("source", "session_id", "seq", F.col("ingest_ns").alias("arrival"))
    gaps = sequence.timed_gap_intervals(sequence.classify(arrivals, orders.BLOCK_NS), F.col("arrival"), block=orders.BLOCK_NS)
    names = [x.split()[0] for x in processors.CLOSED.split(", ")]
    want = rows(gaps, names)
    got = streamed(spark, [x.withColumn("session_id", F.when(F.col("order_key") == -1, 99).otherwise(F.col("session_id"))) for x in in_thirds(spark, feed)], processors.closed_gaps, tmp_path)
    assert len({w[-1] for w in want}) > 1 and rows(got, names) == want


def test_records_from_a_bus(spark, tmp_path):
    """Binary records, some cut, as a stream: decoded, and reconciled like the events that they were made of."""
    events = queries.events(spark, DATA, True).filter("order_key % 7 = 0").withColumn("sending_time", F.col("ingest_ns")).withColumnRenamed("seq", "seq_num").cache()
    records = wire.encoded(events).select("source", "ingest_ns", F.when(F.col("order_key") % 2 == 0, F.substring("record", 1, 90)).otherwise(F.col("record")).alias("record"))
    records.coalesce(1).write.parquet(str(tmp_path / "bus"))
    good, bad = wire.subscribed(spark, str(tmp_path / "bus"))
    for name, stream in (("good", good), ("bad", bad)):
        processors.to_parquet(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    names = ["source", "ingest_ns", "ord_status", "cum_qty", "price_micro", "exec_id", "clord_id", "seq_num"]
    got = spark.read.parquet(str(tmp_path / "good"))
    assert rows(got, names) == rows(events.filter("order_key % 2 = 1"), names)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == events.filter("order_key % 2 = 0").count() > 0


def test_late_rows_are_counted(spark, tmp_path):
    events = queries.events(spark, DATA).filter("order_key = 63").cache()
    on_time, late = in_thirds(spark, events)[3], events
    at = str(tmp_path / "in")
    for part in (on_time, on_time.withColumn("ingest_ns", F.col("ingest_ns") + 1), late):
        part.coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)
    query = processors.to_parquet(processors.two_stage(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert processors.late_rows(query) == events.count() > 0


def test_late_rows_are_applied_afterwards(spark, tmp_path):
    """A stream drops late events; its rows with the amendments of two runs are those of the batch form, as far as the
    watermark has come, and a run that is repeated amends nothing twice."""
    events = queries.events(spark, DATA).filter("order_key > 0 and order_key % 7 = 3").cache()
    first, second, third, stop = in_thirds(spark, events)
    is_late = (F.col("source") == 1) & (F.col("r") % 3 == 1)
    later = is_late & (F.col("order_key") % 2 == 0)
    parts = [first.filter(~is_late), second.filter(~later), third.unionByName(first.filter(is_late)), stop.unionByName(second.filter(later))]
    names = [x.split()[0] for x in processors.DIVERGENCES.split(", ")]
    batch = lambda e: orders.two_stage(orders.views(orders.lifecycle(e))).filter("emitted")
    at = str(tmp_path / "in")
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)

    def step(some):
        for part in some:
            part.coalesce(1).write.mode("append").parquet(at)
            time.sleep(0.05)
        processors.to_parquet(processors.two_stage(source()), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        late.recorded(source(), str(tmp_path / "record"), str(tmp_path / "c2")).awaitTermination()
        given = spark.read.parquet(str(tmp_path / "out"))
        run = lambda: late.amend(spark, str(tmp_path / "record"), given, str(tmp_path / "amended"))
        once, made = rows(run(), [*names, "change"]), run()
        assert rows(made, [*names, "change"]) == once
        return given.filter("order_key != -1"), made.filter("order_key != -1")

    given, made = step(parts[:3])
    assert spark.read.parquet(str(tmp_path / "record" / "events")).filter("late").count() == first.filter(is_late).count() > 0
    passed = events.agg(F.max("ingest_ns")).first()[0] // MS * MS - 1000 * MS + 999
    known = F.col("detect_ns") <= passed
    assert {r.change for r in made.select("change").distinct().collect()} == {1, -1}
    assert rows(amendments.net(given, made).filter(known), names) == rows(batch(first.unionByName(parts[1]).unionByName(third)).filter(known), names) != rows(given.filter(known), names)
    given, made = step(parts[3:])
    assert made.select("upto").distinct().count() > 1
    assert rows(amendments.net(given, made), names) == rows(batch(events), names)


@pytest.mark.parametrize("seed", range(3))
def test_order_in_any_batches(spark, seed):
    """Held events: the fold gives the same whether all come at once or shuffled a few at a time, the watermark behind."""
    r = random.Random(seed)
    config = ReconConfig(grace_ns=20, dedup_ns=15)
    status = lambda: r.choice([0, 8, 1, 2, 3, 9])
    events = [[t, r.randrange(2), 0, status(), r.choice([10, 20]), 5, r.choice(["a", None]), t] for t in sorted(r.sample(range(400), 60))]
    whole = processors.Order(config)
    want = whole.advance(events, 10_000)
    parts = processors.Order(config)
    got = []
    for at in range(0, 60, 6):
        batch = r.sample(events[at : at + 6], 6)
        got += parts.advance(batch, events[at][0] - 1)
    got += parts.advance([], 10_000)
    assert got == want and parts.next_ns() is None
    schema = "order_key long, ingest_ns long, source int, r int, ord_status int, cum_qty long, price_micro long, exec_id string, transact_time long"
    table = spark.createDataFrame([(1, *e) for e in events], schema)
    batch = orders.two_stage(orders.views(orders.lifecycle(table)), config).filter("emitted").orderBy("detect_ns", "mask")
    assert [list(x) for x in batch.select([x.split()[0] for x in processors.DIVERGENCES.split(", ")][1:]).collect()] == want


@pytest.fixture
def rocks(spark):
    """The state store that keeps maps and timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sessions.ROCKS)
    yield
    spark.conf.set(name, before)


def marked_views(rows):
    return orders.views(orders.lifecycle(queries.marked(rows)))


def test_suppressed(spark, tmp_path, rocks):
    events = queries.events(spark, DATA, True).filter("session_id = 1").cache()
    names = [x.split()[0] for x in processors.DIVERGENCES.split(", ")]
    want = rows(orders.two_stage(marked_views(events)).filter("emitted"), names)
    plain = rows(orders.two_stage(orders.views(orders.lifecycle(events))).filter("emitted"), names)
    got = streamed(spark, in_thirds(spark, events), sessions.two_stage_suppressed, tmp_path)
    assert want != plain and rows(got.filter("order_key != -1"), names) == want


def test_two_sinks_of_one_pass(spark, tmp_path, rocks):
    """Divergences and gaps in folders of their own; the last batch is run again and leaves no row twice."""
    events = queries.events(spark, DATA, True).filter("session_id = 1 and order_key < 700").cache()
    arrivals = events.withColumn("arrival", F.col("ingest_ns"))
    gaps = sequence.timed_gap_intervals(sequence.classify(arrivals.select("source", "session_id", "seq", "arrival"), orders.BLOCK_NS), F.col("arrival"), block=orders.BLOCK_NS)
    names = [x.split()[0] for x in processors.DIVERGENCES.split(", ")]
    ends = [x.split()[0] for x in processors.CLOSED.split(", ")]
    want = rows(orders.two_stage(marked_views(events)).filter("emitted"), names), rows(gaps, ends)
    at = str(tmp_path / "in")
    for part in in_thirds(spark, events):
        part.coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)

    def run():
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)
        query = sessions.to_parquet(sessions.both(source), str(tmp_path / "divergences"), str(tmp_path / "gaps"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        found = [spark.read.parquet(str(tmp_path / x)) for x in ("divergences", "gaps")]
        return rows(found[0].filter("order_key != -1"), names), rows(found[1], ends)

    assert run() == want and all(want)
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda x: int(x.name))
    for x in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        x.unlink(missing_ok=True)
    assert run() == want


class Store(dict):
    def put(self, key, text):
        self[key] = text

    def remove(self, key):
        del self[key]


def feed_of(r, n, sources=2):
    """Events of a few orders whose trackers lose, repeat and delay numbers; some at one time."""
    out, t, last = [], 0, [0, 0]
    for i in range(n):
        t += r.choice([0, 1, 3, 8, 40])
        source = r.randrange(sources)
        last[source] += r.choice([0, 1, 1, 1, 1, 2, 3])
        seq = max(1, last[source] - r.choice([0, 0, 0, 0, 0, 1, 2]))
        out.append([t, source, i, r.choice([0, 8, 1, 2, 3, 9]), r.choice([10, 20]), 5, r.choice(["a", "b"]), t, r.randrange(4), seq, None])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sessions_in_any_batches(spark, seed):
    """The fold of a session equals the batch form, divergences and gaps, all at once and a few at a time, its state cut and
    read again; half of the feeds have gaps closed by hand."""
    r = random.Random(seed)
    config = ReconConfig(grace_ns=20, dedup_ns=15, gap_close_ns=60, gap_timeout_ns=150, gap_recheck_ns=7)
    events = feed_of(r, 160)
    hands = sorted({(r.choice(events)[0], r.randrange(2)) for _ in range(12)}) if seed % 2 else []
    control = [[t, source, 0, 0, 0, 0, None, t, -5, 0, sessions.CLOSE] for t, source in hands]
    whole = sessions.Session(config, Store())
    want = whole.advance(events + control, 100_000)
    store, kept, got, ends = Store(), None, [], []
    times = sorted({e[0] for e in events})
    for a, b in zip([-1, *times[9::10]], [*times[9::10], times[-1]], strict=True):
        part = sessions.Session(config, store, kept)
        batch = [e for e in events + control if a < e[0] <= b]
        got += part.advance(r.sample(batch, len(batch)), b - r.randrange(3))
        kept, ends = json.loads(json.dumps(part.kept)), ends + part.gaps
    last = sessions.Session(config, store, kept)
    got += last.advance([], 100_000)
    assert got == want and len(want) > 20 and ends + last.gaps == whole.gaps
    schema = "session_id int, ingest_ns long, source int, r int, ord_status int, cum_qty long, price_micro long, exec_id string, transact_time long, order_key long, seq long"
    table = spark.createDataFrame([(0, *e[:-1]) for e in events], schema)
    arrivals = table.withColumn("arrival", F.col("ingest_ns"))
    closings = spark.createDataFrame([(source, 0, t) for t, source in hands], "source int, session_id int, arrival long") if hands else None
    gaps = sequence.timed_gap_intervals(sequence.classify(arrivals.select("source", "session_id", "seq", "arrival")), F.col("arrival"), config, closings)
    ended = gaps.select("source", "epoch", "start_seq", "end_seq", "opened_ns", "closed_ns", "filled_by", "reason")
    assert sorted(map(str, map(list, ended.collect()))) == sorted(map(str, whole.gaps)) and (not hands or any(x[-1] == sequence.CLOSED_BY_HAND for x in whole.gaps))
    view = orders.views(orders.lifecycle(sequence.uncertain(arrivals, gaps).drop("arrival")))
    names = [x.split()[0] for x in processors.DIVERGENCES.split(", ")]
    batch = rows(orders.two_stage(view, config).filter("emitted"), names)
    assert batch == sorted(tuple(-1 if v is None else v for v in x) for x in want)
    assert batch != rows(orders.two_stage(orders.views(orders.lifecycle(table)), config).filter("emitted"), names)


def test_control_rows():
    config = ReconConfig(grace_ns=20, dedup_ns=15, gap_close_ns=1000, gap_timeout_ns=5000, gap_recheck_ns=7)
    event = lambda t, source, seq, key=1, control=None: [t, source, seq, 0, 10, 5, "a", t, key, seq, control]
    first = [event(0, 0, 1, 9), event(10, 0, 5)]  # a gap opens at 10; the order is on one feed only, due at 30
    assert sessions.Session(config, Store()).advance(first, 900) == sessions.Session(config, Store()).advance(first, 37)
    found = sessions.Session(config, Store()).advance([*first, event(100, 0, 0, -5, sessions.CLOSE)], 900)
    assert [(k, at) for k, at, *_ in found if k == 1] == [(1, 107)]  # checks at 30, 37, ..., 100; the next one confirms
    assert [(k, at) for k, at, *_ in sessions.Session(config, Store()).advance([*first, event(100, 1, 0, -5, sessions.CLOSE)], 900) if k == 1] == []
    store = Store()
    session = sessions.Session(config, store)
    assert [k for k, *_ in session.advance([*first, event(25, 0, 0, -5, sessions.RESET), event(40, 0, 77)], 26)] == [9] and not store
    assert [(k, at) for k, at, *_ in session.advance([], 900)] == [(1, 60)] and session.kept["trackers"][0]["epoch"] == 0  # a new day, no gap
    session.advance([event(2000, 0, 0, -5, sessions.RESET)], 2000)
    assert session.empty() and not store


def test_idle_orders_are_forgotten():
    config = ReconConfig(grace_ns=20, dedup_ns=15)
    store = Store()
    session = sessions.Session(config, store, keep_ns=100)
    session.advance([[0, 0, 0, 2, 10, 5, "a", 0, 1, 1, None], [5, 1, 0, 2, 10, 5, "a", 0, 1, 1, None], [50, 0, 0, 2, 10, 5, "a", 0, 2, 2, None]], 60)
    assert set(store) == {1, 2}
    session.advance([], 104)
    assert set(store) == {1, 2}
    session.advance([], 105)
    assert set(store) == {2}
    session.advance([], 10_000)
    assert not store


def test_sequence(spark, tmp_path):
    rows_ = queries.classified(spark, DATA).cache()
    names = [x.split()[0] for x in processors.ANOMALIES.split(", ")]
    want = rows(sequence.with_fills(rows_, sequence.gap_intervals(rows_)).filter("kind is not null"), names)
    feed = rows_.select("source", "session_id", "seq", "arrival")
    got = streamed(spark, [feed.filter("arrival <= 40"), feed.filter("arrival > 40 and arrival <= 90"), feed.filter("arrival > 90")], processors.sequence_anomalies, tmp_path)
    assert want and rows(got, names) == want


def test_empty(spark, tmp_path):
    events = queries.events(spark, DATA).limit(0)
    assert streamed(spark, [events], processors.two_stage, tmp_path).count() == 0
