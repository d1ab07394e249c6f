"""Order-execution feeds derived from the tables: two views of each order's life, and numbered sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MS
from ..operators.running import running
from ..schema import CANCEL_PENDING, CANCELED, DROPCOPY, FILLED, NEW, PARTIALLY_FILLED, PENDING_NEW, PRIMARY, REJECTED, REPLACED, UNKNOWN, WORKING
from ..storage import written

#: The exec type that goes with each status.
EXEC_OF = (0, 1, 2, 3, 4, 5, 6, 0, 0, 6)
FIRST = (NEW, PENDING_NEW, WORKING, REPLACED, UNKNOWN, WORKING)
#: Session events and nanoseconds of order events whose running aggregates are taken at once.
BLOCK, BLOCK_NS = 65_536, 60_000 * MS
#: What messages a line gives rise to.
OPEN_P, OPEN_D, LINE_P, LINE_D, END_P, END_D, BAD_1, BAD_2, BAD_3, AGAIN = range(10)
#: Lines of an order that are counted out at once.
LINES = 4_096


def order_events(lineitem: DataFrame, numbered: bool = True, tasks: int | None = None) -> DataFrame:
    """Both feeds of every order as they arrive, numbered (seq) by source and session as they were sent, if that is asked;
    tasks: how many share the orders.

    An order begins with one of six statuses, is filled line by line, and ends filled, or cancelled or rejected after a
    pending cancel. By key modulo 20: 0 and 1 are on one feed only; 2 lacks the last line on the drop copy; 3 has
    another quantity there; 5 lacks the primary's lines; 6 has other exec ids; 7 has three events that no status allows;
    2, 4 and 8 repeat the primary's last status; 9 delivers one message twice. Some messages are numbered but lost (those
    missing where the key modulo 120 is 2, and the primary's last lines where it is 70) or 700 ms late (the drop copy's last
    lines where the key modulo 60 is 4).
    """
    line = Window.partitionBy("order_key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    price = F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000
    rows = lineitem.select(F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", price.alias("price"))
    rows = rows.repartition(tasks, "order_key") if tasks else rows
    rows = rows.withColumn("qty", F.col("l_quantity").cast("long"))
    rows = rows.withColumns({"line": F.row_number().over(line), "cum": F.sum("qty").over(line.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count("*").over(Window.partitionBy("order_key"))})
    rows = rows.select("order_key", "line", "n", "qty", "price", "cum")
    sent = _numbered(rows, lineitem, tasks) if numbered else _sent(rows)
    key, n, last, how, what, r = F.col("order_key"), F.col("n"), F.col("line") == F.col("n"), F.col("order_key") % 7, F.col("what"), _row()
    k, opening = key % 20, what.isin(OPEN_P, OPEN_D)
    begins = F.element_at(F.array(*map(F.lit, FIRST)), (key % 6 + 1).cast("int"))
    end = F.when(how == 3, CANCELED).when(how == 5, REJECTED).otherwise(FILLED)
    status = F.when(opening, begins).when(what.isin(END_P, END_D, AGAIN), end).when(what.isin(BAD_1, BAD_3), WORKING).when(what == BAD_2, NEW).when(~last, PARTIALLY_FILLED).when(how.isin(3, 5), CANCEL_PENDING).otherwise(FILLED)
    # ms until a message arrives, and the row whose exec id is given
    late = F.when((what == LINE_D) & (key % 60 == 4) & last, 700).otherwise(0)
    ident = F.when(what == AGAIN, F.when(how.isin(3, 5), n + 1).otherwise(n)).otherwise(r)
    lost = last & ((what == LINE_P) & (key % 120 == 70) | (what == LINE_D) & (key % 120 == 2))
    copies = F.when((what == LINE_D) & (k == 9) & last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    zero, text = F.lit(0).cast("long"), key.cast("string")
    out = sent.filter(~lost).withColumns({"ingest": F.col("sent_ns") + late * MS, "ord_status": status.cast("int"), "copy": F.explode(copies)})
    return out.select(
        "order_key", "source", (r + 6 * F.col("copy")).cast("int").alias("r"), F.element_at(F.array(*map(F.lit, EXEC_OF)), F.col("ord_status") + 1).alias("exec_type"), "ord_status", "session_id", *["seq"] * numbered,
        F.when(opening, zero).otherwise(F.col("price")).alias("price_micro"), F.when(opening, zero).otherwise(F.col("qty")).alias("qty"), (F.when(opening, zero).otherwise(F.col("cum")) + F.when((what == LINE_D) & (k == 3) & last, 1).otherwise(0)).alias("cum_qty"),
        (F.col("ingest") + F.col("copy") * MS).alias("ingest_ns"), F.col("ingest").alias("transact_time"), F.concat(F.when((F.col("source") == DROPCOPY) & (k == 6), "D").otherwise("E"), text, F.lit("-"), ident.cast("string")).alias("exec_id"),
        F.concat(F.lit("OID"), text).alias("order_id"), F.concat(F.lit("CID"), text).alias("clord_id"),
    )


def _row() -> Column:
    """A message's number in its order, by what it is."""
    line, n, what = F.col("line"), F.col("n"), F.col("what")
    return F.when(what.isin(OPEN_P, OPEN_D), 0).when(what.isin(LINE_P, LINE_D), line).otherwise(n + F.when(what.isin(END_P, END_D), 1).when(what == AGAIN, 5).otherwise(what - BAD_1 + 2))


def _session() -> Column:
    return (F.floor(F.col("order_key") / 3) % 2).cast("int")


def _numbered(lines: DataFrame, lineitem: DataFrame, tasks: int | None) -> DataFrame:
    """The messages of lines with their numbers (seq) by source and session.

    Orders go along sessions, not messages, of which each has some ten: up to LINES lines of an order as one row, to each part
    of its session's time in which these may have messages. Messages are made there, and those of other parts left out. How
    many messages are before a part comes from the orders' numbers of lines alone.
    """
    key, n, block, part = F.col("order_key"), F.col("n"), F.col("_block"), F.expr(f"sent_ns div {BLOCK_NS}")
    held = lines.groupBy("order_key", "n", F.expr(f"(line - 1) div {LINES}").alias("_block")).agg(F.collect_list(F.struct("line", "qty", "price", "cum")).alias("lines"))
    # bounds of their sending times (see `_sent`)
    upto = (block + 1) * LINES
    low = (key * 50 + block * (10 * LINES) - 1) * MS
    high = (key * 50 + F.when(upto < n, upto * 10).otherwise((n + 2) * 10 + 1200) + 3) * MS + (n + 6) * 2
    held = held.withColumns({"session_id": _session(), "_low": low, "_high": high})
    held = held.select("session_id", F.explode(F.sequence(F.expr(f"_low div {BLOCK_NS}"), F.expr(f"_high div {BLOCK_NS}"))).alias("_part"), "order_key", "n", "lines")
    held = held.repartition(*([tasks] if tasks else []), "session_id", "_part")
    counts = _sent(_lines(lineitem)).groupBy("session_id", part.alias("_part")).agg(F.count_if(F.col("source") == PRIMARY).alias("p"), F.count_if(F.col("source") == DROPCOPY).alias("d"))
    before = Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("session_id", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in "pd"])
    rows = held.join(counts.hint("shuffle_hash"), ["session_id", "_part"])
    rows = rows.withColumn("_line", F.explode("lines")).select("order_key", "n", "session_id", "_part", "_before_p", "_before_d", "_line.*")
    rows = _sent(rows).filter(part == F.col("_part"))
    inside = Window.partitionBy("_part", "source", "session_id").orderBy("sent_ns").rowsBetween(Window.unboundedPreceding, 0)
    seq = F.count("*").over(inside) + F.when(F.col("source") == PRIMARY, F.col("_before_p")).otherwise(F.col("_before_d"))
    return rows.withColumn("seq", seq).drop("_part", "_before_p", "_before_d")


def _sent(lines: DataFrame) -> DataFrame:
    """The messages that each of the lines (order_key, line of n) gives rise to: what, their source, session and sending time."""
    key, n, what = F.col("order_key"), F.col("n"), F.col("what")
    k, how, first, last = key % 20, key % 7, F.col("line") == 1, F.col("line") == n
    closed, p, d = last & how.isin(3, 5), k != 1, k != 0
    given = {
        OPEN_P: first & p, OPEN_D: first & d, LINE_P: p & (k != 5), LINE_D: d & ~((k == 2) & (key % 120 != 2) & last), END_P: closed & p & (k != 5), END_D: closed & d,
        BAD_1: last & (k == 7), BAD_2: last & (k == 7), BAD_3: last & (k == 7), AGAIN: last & k.isin(2, 4, 8),
    }
    # array_remove is compiled with what is around it, array_compact runs its own function for each element
    rows = lines.withColumn("what", F.explode(F.array_remove(F.array(*[F.when(when, i).otherwise(-1) for i, when in given.items()]), -1)))
    source, r = F.when(what.isin(OPEN_D, LINE_D, END_D), DROPCOPY).otherwise(PRIMARY), _row()
    # the row that the sending time is counted from, and ms after it
    place = F.when(what == AGAIN, n + 1).when(what.isin(BAD_2, BAD_3), n + 2).otherwise(r)
    wait = F.when(what == BAD_2, 600).when(what == BAD_3, 1200).when(what == AGAIN, 200).otherwise(0)
    sent = (key * 50 + place * 10 + source * 2 + wait) * MS + key % 10_000 * 64 + r * 2 + source
    return rows.withColumns({"source": source, "sent_ns": sent, **({} if "session_id" in lines.columns else {"session_id": _session()})})


def _lines(lineitem: DataFrame) -> DataFrame:
    """(order_key, line, n): every order's lines, from their count."""
    rows = lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(LINES).cast("long"))))
    return rows.select("order_key", F.explode(F.sequence("_from", F.least(F.col("_from") + (LINES - 1), F.col("n")))).alias("line"), "n")


def session_events(events: DataFrame) -> DataFrame:
    """Numbered messages of four sessions per source: some lost, late, or delivered twice; arrival is their order."""
    tracker = ["source", "session_id"]
    rows = events.select((F.col("event_id") % 2).cast("int").alias("source"), (F.col("user_id") % 4).cast("int").alias("session_id"), "event_id")
    rows = running(rows, tracker, ["event_id"], {"seq": ("sum", F.lit(1).cast("long"))}, F.expr(f"event_id div {BLOCK}")).filter("seq % 97 != 0")
    rows = written(rows, "sessions")
    s = F.col("seq")
    at = F.array(
        s * 10 + F.when(s % 53 == 0, 35).otherwise(0),
        F.when((s % 53 != 0) & (s % 71 == 0), s * 10 + 1),
        F.when((s % 53 != 0) & (s % 71 != 0) & (s % 61 == 0), s * 10 + 55),
    )
    rows = rows.withColumn("o", F.explode(F.array_compact(at)))
    rows = running(rows, tracker, ["o", "seq"], {"arrival": ("sum", F.lit(1).cast("long"))}, F.expr(f"o div {10 * BLOCK}"))
    return rows.select("source", "session_id", "event_id", "seq", "arrival")


def closings(events: DataFrame) -> DataFrame:
    """Gaps closed by hand: (source, session_id, arrival) after which a tracker's open gap, if any, is closed."""
    rows = events.filter("event_id % 211 = 0")
    return rows.select((F.col("event_id") % 2).cast("int").alias("source"), (F.col("user_id") % 4).cast("int").alias("session_id"), F.expr("event_id div 8").alias("arrival")).distinct()
