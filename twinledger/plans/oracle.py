"""The registered queries in SQL, for an engine that runs it on the same tables. Nothing here comes from the operators."""

from __future__ import annotations

_FIRST = "[0, 7, 8, 4, 6, 8][k % 6 + 1]"
_LINE = "CASE WHEN r < n THEN 1 WHEN k % 7 IN (3, 5) THEN 9 ELSE 2 END"
_END = "CASE k % 7 WHEN 3 THEN 3 WHEN 5 THEN 5 ELSE 2 END"
_FEED = f"""
RECURSIVE l AS (
    SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS price,
        row_number() OVER w AS r, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, count(*) OVER (PARTITION BY l_orderkey) AS n
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
m0 AS (
    SELECT k, 0 AS source, 0 AS r, {_FIRST} AS st, 0 AS price, 0 AS qty, 0 AS cum, 0 AS place, 0 AS wait, 0 AS late, false AS lost, false AS twice, 0 AS x FROM l WHERE r = 1 AND k % 20 != 1
    UNION ALL SELECT k, 1, 0, {_FIRST}, 0, 0, 0, 0, 0, 0, false, false, 0 FROM l WHERE r = 1 AND k % 20 != 0
    UNION ALL SELECT k, 0, r, {_LINE}, price, qty, cum, r, 0, 0, k % 120 = 70 AND r = n, false, r FROM l WHERE k % 20 NOT IN (1, 5)
    UNION ALL SELECT k, 1, r, {_LINE}, price, qty, cum + CASE WHEN k % 20 = 3 AND r = n THEN 1 ELSE 0 END, r, 0, CASE WHEN k % 60 = 4 AND r = n THEN 700 ELSE 0 END, k % 120 = 2 AND r = n, k % 20 = 9 AND r = n, r
        FROM l WHERE k % 20 != 0 AND NOT (k % 20 = 2 AND k % 120 != 2 AND r = n)
    UNION ALL SELECT k, 0, n + 1, {_END}, price, qty, cum, n + 1, 0, 0, false, false, n + 1 FROM l WHERE r = n AND k % 7 IN (3, 5) AND k % 20 NOT IN (1, 5)
    UNION ALL SELECT k, 1, n + 1, {_END}, price, qty, cum, n + 1, 0, 0, false, false, n + 1 FROM l WHERE r = n AND k % 7 IN (3, 5) AND k % 20 != 0
    UNION ALL SELECT k, 0, n + 2, 8, price, qty, cum, n + 2, 0, 0, false, false, n + 2 FROM l WHERE r = n AND k % 20 = 7
    UNION ALL SELECT k, 0, n + 3, 0, price, qty, cum, n + 2, 600, 0, false, false, n + 3 FROM l WHERE r = n AND k % 20 = 7
    UNION ALL SELECT k, 0, n + 4, 8, price, qty, cum, n + 2, 1200, 0, false, false, n + 4 FROM l WHERE r = n AND k % 20 = 7
    UNION ALL SELECT k, 0, n + 5, {_END}, price, qty, cum, n + 1, 200, 0, false, false, CASE WHEN k % 7 IN (3, 5) THEN n + 1 ELSE n END FROM l WHERE r = n AND k % 20 IN (2, 4, 8)),
m1 AS (SELECT *, (k * 50 + place * 10 + source * 2 + wait) * 1000000 + k % 10000 * 64 + r * 2 + source AS sent, CAST(k // 3 % 2 AS INT) AS session_id FROM m0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY sent) AS seq FROM m1),
m3 AS (SELECT *, 0 AS copy FROM m2 WHERE NOT lost UNION ALL SELECT *, 1 FROM m2 WHERE twice),
e AS (
    SELECT k AS order_key, source, CAST(r + 6 * copy AS INT) AS r, [0, 1, 2, 3, 4, 5, 6, 0, 0, 6][st + 1] AS exec_type, st AS ord_status, session_id, seq,
        CAST(price AS BIGINT) AS price_micro, CAST(qty AS BIGINT) AS qty, CAST(cum AS BIGINT) AS cum_qty, CAST(sent + (late + copy) * 1000000 AS BIGINT) AS ingest_ns, CAST(sent + late * 1000000 AS BIGINT) AS transact_time,
        CASE WHEN source = 1 AND k % 20 = 6 THEN 'D' ELSE 'E' END || k || '-' || x AS exec_id, 'OID' || k AS order_id, 'CID' || k AS clord_id
    FROM m3)"""

# Which status may follow which: anything the unknown one (6), each status itself, and these.
_MAY = """(f.now = 6 OR f.now = o.ord_status OR CASE f.now WHEN 0 THEN o.ord_status IN (8, 1, 2, 9, 5) WHEN 7 THEN o.ord_status IN (8, 1, 2, 9, 5) WHEN 8 THEN o.ord_status IN (1, 2, 9, 5)
        WHEN 1 THEN o.ord_status IN (1, 2, 9) WHEN 9 THEN o.ord_status IN (3, 5, 1, 2) WHEN 4 THEN o.ord_status IN (8, 1, 2, 9, 5) ELSE false END)"""


def _fold(feed: str = _FEED, e: str = "e") -> str:
    return f"""{feed},
o AS (SELECT *, row_number() OVER (PARTITION BY order_key, source ORDER BY ingest_ns, r) AS i FROM {e}),
f AS (
    SELECT *, true AS accepted, ord_status AS now FROM o WHERE i = 1
    UNION ALL SELECT o.*, {_MAY}, CASE WHEN {_MAY} THEN o.ord_status ELSE f.now END
    FROM f JOIN o ON o.order_key = f.order_key AND o.source = f.source AND o.i = f.i + 1)"""


def _last(side: int, column: str) -> str:
    return f"last_value(CASE WHEN source = {side} AND accepted THEN {column} END IGNORE NULLS) OVER w"


_SIDES = {"status": "ord_status", "cum_qty": "cum_qty", "avg_px": "price_micro", "ts": "transact_time", "exec_id": "exec_id"}


def _views(feed: str = _FEED, e: str = "e") -> str:
    return f"""{_fold(feed, e)},
v AS (
    SELECT order_key, ingest_ns, source, r, session_id, accepted, {", ".join(f"{_last(i, c)} AS {s}_{n}" for i, s in enumerate("pd") for n, c in _SIDES.items())}
    FROM f WINDOW w AS (PARTITION BY order_key ORDER BY ingest_ns, source, r ROWS UNBOUNDED PRECEDING))"""


def _mask(qty: int = 0, px: int = 0, ids: bool = True) -> str:
    last = " + CASE WHEN p_exec_id != d_exec_id THEN 32 ELSE 0 END" if ids else ""
    return f"""CASE WHEN p_status IS NULL AND d_status IS NULL THEN 0 WHEN p_status IS NULL OR d_status IS NULL THEN 16
        ELSE CASE WHEN p_status != d_status THEN 1 ELSE 0 END + CASE WHEN abs(p_cum_qty - d_cum_qty) > {qty} THEN 2 ELSE 0 END
            + CASE WHEN abs(p_avg_px - d_avg_px) > {px} THEN 8 ELSE 0 END{last} END"""


_KIND = "CASE WHEN mask & 16 != 0 THEN CASE WHEN p_status IS NOT NULL AND d_status IS NULL THEN 5 ELSE 1 END WHEN mask & 1 != 0 THEN 2 WHEN mask & 2 != 0 THEN 3 ELSE 2 END"
_CLOSE = f"""{_views()},
z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY ingest_ns DESC, source DESC, r DESC) = 1)"""


def _at_once(feed: str = _FEED, e: str = "e", qty: int = 0, px: int = 0, slack: int = 0) -> str:
    """t: what each valid event shows; u: invalid events, with whether each is emitted (a greedy choice, one after another)."""
    return f"""{_views(feed, e)},
t AS (SELECT *, CASE WHEN d_status IS NULL THEN NULL WHEN p_status IS NULL THEN 1 WHEN d_status IN (1, 2) AND p_status IN (0, 7, 8) THEN 0 WHEN p_status != d_status THEN 2
    WHEN abs(p_cum_qty - d_cum_qty) > {qty} OR abs(p_avg_px - d_avg_px) > {px} THEN 3 WHEN d_ts + {slack} < p_ts THEN 4 END AS type FROM v WHERE accepted),
u0 AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY ingest_ns, source, r) AS i FROM v WHERE NOT accepted),
u AS (
    SELECT *, true AS emitted, ingest_ns AS la FROM u0 WHERE i = 1
    UNION ALL SELECT u0.*, u0.ingest_ns - u.la >= 1000000000, CASE WHEN u0.ingest_ns - u.la >= 1000000000 THEN u0.ingest_ns ELSE u.la END FROM u JOIN u0 ON u0.order_key = u.order_key AND u0.i = u.i + 1)"""


def _immediate(with_: str) -> str:
    return f"""WITH {with_} SELECT order_key, source, r, ingest_ns AS detect_ns, type, 0 AS mask, p_status, p_cum_qty, d_status, d_cum_qty FROM t WHERE type IS NOT NULL
        UNION ALL SELECT order_key, source, r, ingest_ns, 2, 1, p_status, p_cum_qty, d_status, d_cum_qty FROM u WHERE emitted"""


def _machine(views: str, grace: int = 500_000_000, dedup: int = 1_000_000_000, ids: bool = True, until: str = "CAST(NULL AS BIGINT)", source: str = "v", horizon: int = 1 << 62) -> str:
    """h: every step of every order, an event or a timer, whichever comes first (at one time events do)."""
    emits = f"cand AND NOT coalesce(lm = cm AND ct - la < {dedup}, false)"
    return f"""{views},
ev AS (SELECT order_key, ingest_ns AS t, accepted, {_mask(ids=ids)} AS m, {until} AS u, p_status, p_cum_qty, d_status, d_cum_qty,
    row_number() OVER (PARTITION BY order_key ORDER BY ingest_ns, source, r) AS i FROM {source} WHERE ingest_ns < {horizon}),
h AS (
    SELECT order_key, i, 0 AS step, 3 AS state, t + {grace} AS deadline, u, m, p_status, p_cum_qty, d_status, d_cum_qty, CAST(NULL AS BIGINT) AS la, CAST(NULL AS INT) AS lm, false AS cand, CAST(NULL AS BIGINT) AS ct, CAST(NULL AS INT) AS cm,
        false AS emitted, 1 AS obs, 0 AS conf, 0 AS avoided, 0 AS matched, 0 AS resolved, 0 AS supp FROM ev WHERE i = 1
    UNION ALL SELECT order_key, i, step, state, deadline, u, m, p_status, p_cum_qty, d_status, d_cum_qty, CASE WHEN {emits} THEN ct ELSE la END, CASE WHEN {emits} THEN cm ELSE lm END, cand, ct, cm, {emits},
        CAST(NOT timer AND state = 3 AND was != 3 AS INT), CAST(cand AS INT), CAST(state = 4 AND (was = 3 OR timer) AS INT), CAST(state = 4 AND (was = 3 OR was = 6) AS INT), CAST(state = 4 AND was = 5 AS INT), CAST(timer AND state = 6 AS INT)
    FROM (SELECT *, CASE WHEN timer THEN CASE WHEN m = 0 THEN 4 WHEN u >= due THEN 6 ELSE 5 END WHEN NOT accepted THEN 5 WHEN was = 6 AND u >= t THEN 6 WHEN m = 0 THEN 4 WHEN was IN (4, 6) THEN 3 ELSE was END AS state,
        CASE WHEN timer THEN CASE WHEN m != 0 AND u >= due THEN due + 100000000 END WHEN NOT accepted OR (m = 0 AND NOT coalesce(was = 6 AND u >= t, false)) THEN NULL
            WHEN was = 4 OR (was = 6 AND NOT coalesce(u >= t, false)) THEN t + {grace} ELSE due END AS deadline,
        CASE WHEN timer THEN m != 0 AND NOT coalesce(u >= due, false) ELSE NOT accepted END AS cand, CASE WHEN timer THEN due ELSE t END AS ct, CASE WHEN timer THEN m ELSE 1 END AS cm
    FROM (SELECT h.order_key, h.step + 1 AS step, h.state AS was, h.deadline AS due, h.la, h.lm, timer, CASE WHEN timer THEN h.i ELSE h.i + 1 END AS i, ev.t, ev.accepted,
        CASE WHEN timer THEN h.u ELSE greatest(h.u, ev.u) END AS u, CASE WHEN timer OR NOT ev.accepted THEN h.m ELSE ev.m END AS m,
        CASE WHEN timer THEN h.p_status ELSE ev.p_status END AS p_status, CASE WHEN timer THEN h.p_cum_qty ELSE ev.p_cum_qty END AS p_cum_qty,
        CASE WHEN timer THEN h.d_status ELSE ev.d_status END AS d_status, CASE WHEN timer THEN h.d_cum_qty ELSE ev.d_cum_qty END AS d_cum_qty
    FROM h LEFT JOIN ev ON ev.order_key = h.order_key AND ev.i = h.i + 1, LATERAL (SELECT h.deadline IS NOT NULL AND (ev.t IS NULL OR h.deadline < ev.t) AS timer)
    WHERE ev.t IS NOT NULL OR h.deadline < {horizon})))"""


def _emissions(with_: str) -> str:
    return f"WITH {with_} SELECT order_key, ct AS detect_ns, mask, {_KIND} AS type, emitted, p_status, p_cum_qty, d_status, d_cum_qty FROM (SELECT *, cm AS mask FROM h WHERE cand)"


def _counted(with_: str) -> str:
    names = {"obs": "mismatch_observed", "conf": "mismatch_confirmed", "avoided": "false_positive_avoided", "matched": "orders_matched", "resolved": "divergence_resolved", "supp": "gap_suppressions"}
    return f"WITH {with_} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {n}' for c, n in names.items())}, count(*) FILTER (cand AND NOT emitted) AS divergence_deduped FROM h"


_SESSIONS = """
RECURSIVE s0 AS (SELECT CAST(event_id % 2 AS INT) AS source, CAST(user_id % 4 AS INT) AS session_id, event_id, row_number() OVER (PARTITION BY event_id % 2, user_id % 4 ORDER BY event_id) AS seq FROM events),
s1 AS (
    SELECT *, seq * 10 + CASE WHEN seq % 53 = 0 THEN 35 ELSE 0 END AS o FROM s0 WHERE seq % 97 != 0
    UNION ALL SELECT *, seq * 10 + 1 FROM s0 WHERE seq % 97 != 0 AND seq % 53 != 0 AND seq % 71 = 0
    UNION ALL SELECT *, seq * 10 + 55 FROM s0 WHERE seq % 97 != 0 AND seq % 53 != 0 AND seq % 71 != 0 AND seq % 61 = 0),
s2 AS (SELECT source, session_id, seq, row_number() OVER (PARTITION BY source, session_id ORDER BY o, seq) AS arrival FROM s1)"""
_HANDS = "hands AS (SELECT DISTINCT CAST(event_id % 2 AS INT) AS source, CAST(user_id % 4 AS INT) AS session_id, event_id // 8 AS arrival FROM events WHERE event_id % 211 = 0)"


def _tracked(feed: str, rows: str) -> str:
    return f"""{feed},
s3 AS (SELECT *, max(seq) OVER (PARTITION BY source, session_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {rows}),
s AS (SELECT source, session_id, seq, arrival, last + 1 AS expected_seq, CASE WHEN seq > last + 1 THEN 0 WHEN seq = last THEN 1 WHEN seq < last THEN 2 END AS kind FROM s3)"""


def _gaps(tracked: str, ns: str = "arrival", timed: bool = True, hands: bool = False) -> str:
    """gaps: every gap with how it ended; g: a step for each anomaly (or closing by hand) of a tracker."""
    extra = "UNION ALL SELECT source, session_id, NULL, arrival, NULL, 4 FROM hands" if hands else ""
    limit = "least(det_ns + 1000000000, open_ns + 30000000000)" if timed else "CAST(NULL AS BIGINT)"
    fills = "alive AND kind = 2 AND seq >= start_seq AND seq < end_seq"
    return f"""{tracked},
a0 AS (SELECT source, session_id, seq, arrival, expected_seq, kind FROM s WHERE kind IN (0, 2) {extra}),
a AS (SELECT *, {ns} AS ns, row_number() OVER (PARTITION BY source, session_id ORDER BY arrival, kind, seq) AS i FROM a0),
g AS (
    SELECT source, session_id, i, kind = 0 AS is_open, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS epoch, expected_seq AS start_seq, seq AS end_seq, arrival AS opened, arrival AS detected, ns AS open_ns, ns AS det_ns,
        CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS filled_by, CAST(NULL AS BIGINT) AS end_ns, CAST(NULL AS INT) AS how FROM a WHERE i = 1
    UNION ALL SELECT source, session_id, i, kind = 0 OR (alive AND kind != 4 AND NOT ({fills})), epoch + CASE WHEN kind = 0 AND NOT alive THEN 1 ELSE 0 END,
        CASE WHEN kind = 0 AND NOT alive THEN expected_seq ELSE start_seq END, CASE WHEN kind = 0 THEN seq ELSE end_seq END, CASE WHEN kind = 0 AND NOT alive THEN arrival ELSE opened END,
        CASE WHEN kind = 0 THEN arrival ELSE detected END, CASE WHEN kind = 0 AND NOT alive THEN ns ELSE open_ns END, CASE WHEN kind = 0 THEN ns ELSE det_ns END,
        CASE WHEN alive AND kind = 4 OR {fills} THEN arrival END, CASE WHEN {fills} THEN seq END, CASE WHEN alive AND kind = 4 OR {fills} THEN ns END, CASE WHEN alive AND kind = 4 THEN 3 WHEN {fills} THEN 0 END
    FROM (SELECT a.*, g.epoch, g.start_seq, g.end_seq, g.opened, g.detected, g.open_ns, g.det_ns, g.is_open AND coalesce(a.ns <= {limit}, true) AS alive
        FROM g JOIN a ON a.source = g.source AND a.session_id = g.session_id AND a.i = g.i + 1)),
gaps AS (
    SELECT source, session_id, CAST(epoch AS BIGINT) AS epoch, max(start_seq) AS start_seq, max(end_seq) AS end_seq, max(opened) AS opened, max(detected) AS detected, max(closed) AS closed, max(filled_by) AS filled_by,
        coalesce(max(how), CASE WHEN {str(timed).lower()} THEN CASE WHEN max(det_ns) + 1000000000 <= max(open_ns) + 30000000000 THEN 1 ELSE 2 END END) AS reason,
        coalesce(max(end_ns), least(max(det_ns) + 1000000000, max(open_ns) + 30000000000)) AS closed_ns
    FROM g WHERE epoch > 0 GROUP BY source, session_id, epoch)"""


def _uncertain(feed: str = _FEED, e: str = "e", rows: str = "e") -> str:
    """q: rows with the last time at which a gap that was open at them is open."""
    tracked = _tracked(f"{feed},\nw AS (SELECT source, session_id, seq, ingest_ns AS arrival FROM {e})", "w")
    gap = lambda s: f"(SELECT session_id, opened, epoch, CASE WHEN reason = 0 THEN closed_ns - 1 ELSE closed_ns END AS until FROM gaps WHERE source = {s})"
    return f"""{_gaps(tracked)},
q0 AS (SELECT x.*, CASE WHEN p.until >= ingest_ns THEN p.until END AS pu, CASE WHEN p.until >= ingest_ns THEN p.epoch END AS p_epoch FROM {rows} x ASOF LEFT JOIN {gap(0)} p ON x.session_id = p.session_id AND x.ingest_ns >= p.opened),
q AS (SELECT y.*, CASE WHEN d.until >= ingest_ns THEN d.until END AS du, CASE WHEN d.until >= ingest_ns THEN d.epoch END AS d_epoch FROM q0 y ASOF LEFT JOIN {gap(1)} d ON y.session_id = d.session_id AND y.ingest_ns >= d.opened)"""


def _guarded(feed: str = _FEED, e: str = "e", **options) -> str:
    return _machine(_uncertain(_views(feed, e), e, "v"), until="greatest(pu, du)", source="q", **options)


# FIX text, and what it says: segments between bars, of which the last of a tag counts.
_TEXT = f"""{_FEED},
txt AS (SELECT order_key, source, r, session_id, seq, ingest_ns, '8=FIX.4.4|' || CASE WHEN order_key % 50 = 2 THEN '35=D|' ELSE '35=8|' END || '150=' || substr('0124580009', ord_status + 1, 1) || '|39=' || substr('0124580A06', ord_status + 1, 1)
    || '|17=' || exec_id || '|' || CASE WHEN order_key % 50 IN (0, 4) THEN '' WHEN order_key % 50 = 7 THEN '11=|' WHEN order_key % 50 = 8 THEN '11=' || clord_id || '|11=|' WHEN order_key % 50 = 5 THEN '11=' || rpad(clord_id, 40, 'X') || '|' ELSE '11=' || clord_id || '|' END
    || CASE WHEN order_key % 50 = 0 THEN '' WHEN order_key % 50 = 7 THEN '37=|' ELSE '37=' || order_id || '|' END || '31=' || CASE WHEN order_key % 50 = 1 THEN '12x' ELSE CAST(price_micro AS VARCHAR) END || '|32=' || qty || '|'
    || CASE WHEN order_key % 50 = 3 THEN '14=7|' ELSE '' END || '14=' || cum_qty || '|52=' || ingest_ns || '|60=' || transact_time || '|' AS raw FROM e),
seg AS (SELECT *, list_filter(string_split(raw, '|'), lambda x: x != '') AS segs FROM txt),
val AS (SELECT *, {", ".join(f"list_filter(segs, lambda x: split_part(x, '=', 1) = '{t}')[-1] AS s{t}" for t in (35, 150, 39, 31, 32, 14, 17, 11, 37, 52, 60))} FROM seg),
par AS (SELECT order_key, source, r, session_id, seq, ingest_ns, CASE WHEN substr(s35, 4, 1) != '8'
        OR len(list_filter(segs, lambda x: split_part(x, '=', 1) IN ('31', '32', '14') AND NOT regexp_full_match(substr(x, 4), '-?[0-9]+') OR split_part(x, '=', 1) IN ('52', '60') AND NOT regexp_full_match(substr(x, 4), '[0-9]+'))) > 0 THEN 2
        WHEN (coalesce(s11, '11=') = '11=' AND coalesce(s37, '37=') = '37=') OR s150 IS NULL OR s39 IS NULL OR s31 IS NULL OR s32 IS NULL OR s17 IS NULL OR (s52 IS NULL AND s60 IS NULL) THEN 1 ELSE 0 END AS parse_result,
    CASE substr(s150, 5, 1) WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '4' THEN 3 WHEN '5' THEN 4 WHEN '8' THEN 5 ELSE 6 END AS exec_type,
    CASE substr(s39, 4, 1) WHEN '0' THEN 0 WHEN 'A' THEN 7 WHEN '6' THEN 9 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '4' THEN 3 WHEN '5' THEN 4 WHEN '8' THEN 5 ELSE 6 END AS ord_status,
    TRY_CAST(substr(s31, 4) AS BIGINT) AS price_micro, TRY_CAST(substr(s32, 4) AS BIGINT) AS qty, TRY_CAST(substr(s14, 4) AS BIGINT) AS cum_qty, TRY_CAST(substr(s52, 4) AS BIGINT) AS sending_time,
    TRY_CAST(substr(s60, 4) AS BIGINT) AS transact_time, substr(s17, 4, 32) AS exec_id, coalesce(substr(s37, 4, 32), '') AS order_id, coalesce(substr(s11, 4, 32), '') AS clord_id FROM val)"""


def _hash(text: str) -> str:
    """FNV-1a of ASCII text, as a signed long."""
    h = f"""list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS UBIGINT)),
        lambda a, b: CAST((CAST(xor(a, b) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT), CAST(14695981039346656037 AS UBIGINT))::HUGEINT"""
    return f"(SELECT CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) FROM (SELECT {h} AS h))"


_KEYED = f"""{_TEXT},
keys AS (SELECT clord_id, {_hash("clord_id")} AS hash FROM (SELECT DISTINCT clord_id FROM par WHERE parse_result = 0)),
own AS (SELECT par.* EXCLUDE (order_key, parse_result), hash AS order_key, clord_id = '' AS key_is_default FROM par JOIN keys USING (clord_id) WHERE parse_result = 0)"""
_MS = 1_000_000
_KINDS = "['MissingFill', 'PhantomOrder', 'StateMismatch', 'QuantityMismatch', 'TimingAnomaly', 'MissingDropCopy']"
_STATES = "['Unknown', 'AwaitingPrimary', 'AwaitingDropCopy', 'InGrace', 'Matched', 'DivergedConfirmed', 'SuppressedByGap']"


def oracle_sql() -> dict[str, str]:
    sessions = _tracked(_SESSIONS, "s2")
    by_hand = _gaps(f"{sessions},\n{_HANDS}", "arrival * 300000000", hands=True)
    untimed = _gaps(sessions, timed=False)
    columns = "source, session_id, epoch, start_seq, end_seq, opened, detected, closed, filled_by"
    last = ", ".join(f"arg_max({c}, (ingest_ns, r)) FILTER (accepted) AS {n}" for n, c in _SIDES.items())
    two, short, guarded = _machine(_views()), _machine(_views(), _MS, 15 * _MS, ids=False), _guarded()
    in_time = _machine(_views(f"{_FEED},\non_time AS (SELECT * FROM e WHERE NOT (order_key % 11 = 3 AND source = 1 AND r % 3 = 1))", "on_time"))
    horizon = 40_000 * _MS
    end = "order_key, detect_ns, type, mask, p_status, p_cum_qty, d_status, d_cum_qty"
    return {
        "seq_classify": f"WITH {sessions} SELECT * FROM s",
        "seq_counters": f"""WITH {untimed} SELECT source, count(*) AS events, count(*) FILTER (kind = 0) AS gaps, count(*) FILTER (kind = 1) AS duplicates, count(*) FILTER (kind = 2) AS out_of_order,
            (SELECT count(*) FROM gaps WHERE gaps.source = s.source AND closed IS NOT NULL) AS fills FROM s GROUP BY source""",
        "gap_intervals": f"WITH {untimed} SELECT {columns} FROM gaps",
        "gap_timeouts": f"WITH {_gaps(sessions, 'arrival * 300000000')} SELECT {columns}, reason, closed_ns FROM gaps",
        "gap_closings": f"WITH {by_hand} SELECT {columns}, reason, closed_ns FROM gaps",
        "gap_closing_counters": f"""WITH {by_hand} SELECT source, count(*) FILTER (reason = 0) AS gaps_closed_by_fill, count(*) FILTER (reason = 1) AS gaps_closed_by_timeout,
            count(*) FILTER (reason = 2) AS gap_timeouts, count(*) FILTER (reason IN (2, 3)) AS gaps_closed FROM gaps GROUP BY source""",
        "gap_suppressed_arrivals": f"""WITH {untimed} SELECT s.source, s.session_id, s.seq, s.arrival, gaps.epoch AS gap_epoch FROM s JOIN gaps
            ON s.source = gaps.source AND s.session_id = gaps.session_id AND s.arrival >= opened AND (closed IS NULL OR s.arrival < closed)""",
        "gap_suppressed_orders": f"""WITH {_uncertain()} SELECT order_key, source, r, CASE WHEN pu IS NULL THEN 0 ELSE 1 END + CASE WHEN du IS NULL THEN 0 ELSE 2 END AS gap_flags, p_epoch, d_epoch, greatest(pu, du) AS until_ns
            FROM q WHERE pu IS NOT NULL OR du IS NOT NULL""",
        "order_events": f"WITH {_FEED} SELECT * FROM e",
        "event_ordinals": f"WITH {_FEED} SELECT order_key, source, r, row_number() OVER (ORDER BY ingest_ns, source, session_id, seq, exec_id) - 1 AS ordinal FROM e",
        "source_counters": f"WITH {_fold()} SELECT source, count(*) AS events, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (ord_status IN (2, 3, 5)) AS terminal FROM f GROUP BY source",
        "order_keys": f"SELECT o_orderkey, {_hash('t')} AS order_key FROM (SELECT o_orderkey, 'CID' || o_orderkey AS t FROM orders)",
        "fix_parse": f"""WITH {_TEXT} SELECT order_key, source, r, exec_type, ord_status, price_micro, qty, cum_qty, sending_time, transact_time, CASE WHEN transact_time != 0 THEN transact_time ELSE sending_time END AS event_ts,
            exec_id, order_id, clord_id FROM par WHERE parse_result = 0""",
        "fix_rejects": f"WITH {_TEXT} SELECT order_key, source, r, parse_result FROM par WHERE parse_result != 0",
        "parse_stats": f"WITH {_TEXT} SELECT source, count(*) FILTER (parse_result = 0) AS parsed, count(*) FILTER (parse_result = 1) AS missing_field, count(*) FILTER (parse_result = 2) AS invalid FROM par GROUP BY source",
        "wire_decode": f"""WITH {_FEED} SELECT order_key, source, r, exec_type, ord_status, seq AS seq_num, session_id, price_micro, qty, cum_qty, ingest_ns AS sending_time, transact_time,
            exec_id, order_id, clord_id FROM e WHERE order_key % 50 != 6""",
        "wire_rejects": f"WITH {_FEED} SELECT order_key, source, r FROM e WHERE order_key % 50 = 6",
        "lifecycle_state": f"WITH {_fold()} SELECT order_key, source, {last}, count(*) FILTER (NOT accepted) AS n_rejected, arg_max(ord_status, (ingest_ns, r)) FILTER (accepted) IN (2, 3, 5) AS terminal FROM f GROUP BY order_key, source",
        "lifecycle_rejects": f"WITH {_fold()} SELECT order_key, source, r, ord_status FROM f WHERE NOT accepted",
        "order_views": f"WITH {_views()} SELECT order_key, source, r, accepted, p_status, p_cum_qty, p_avg_px, d_status, d_cum_qty, d_avg_px FROM v",
        "mismatch_mask": f"WITH {_CLOSE} SELECT order_key, {_mask()} AS mask FROM z",
        "mismatch_tolerance": f"WITH {_CLOSE} SELECT order_key, {_mask(1, 10_000, False)} AS mask FROM z",
        "immediate_divergences": _immediate(_at_once()),
        "immediate_tolerance": _immediate(_at_once(qty=1, px=100_000_000, slack=150 * _MS)),
        "immediate_counters": f"WITH {_at_once()} SELECT type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ROLLUP (type)",
        "two_stage_divergences": _emissions(two),
        "two_stage_counters": _counted(two),
        "two_stage_short_grace": f"SELECT mask, type, emitted, count(*) AS n FROM ({_emissions(short)}) GROUP BY ALL",
        "two_stage_suppressed": _emissions(guarded),
        "two_stage_suppressed_counters": _counted(guarded),
        "late_amendments": f"""SELECT {end}, CAST(sum(change) AS BIGINT) AS change FROM (
            SELECT {end}, 1 AS change FROM ({_emissions(two)}) WHERE emitted AND order_key % 11 = 3 UNION ALL SELECT {end}, -1 FROM ({_emissions(in_time)}) WHERE emitted AND order_key % 11 = 3)
            GROUP BY ALL HAVING sum(change) != 0""",
        "recon_states": f"""WITH {_guarded(horizon=horizon)} SELECT state, {_STATES}[state + 1] AS label, state IN (4, 5) AS terminal, count(*) AS n
            FROM (SELECT order_key, arg_max(state, step) AS state FROM h GROUP BY order_key) GROUP BY state""",
        "phantom_orders": f"WITH {_FEED} SELECT DISTINCT order_key FROM e WHERE source = 1 AND order_key NOT IN (SELECT order_key FROM e WHERE source = 0)",
        "missing_dropcopy": f"WITH {_FEED} SELECT DISTINCT order_key FROM e WHERE source = 0 AND order_key NOT IN (SELECT order_key FROM e WHERE source = 1)",
        "eod_summary": f"""WITH {_CLOSE}, k AS (SELECT *, {_mask()} AS mask FROM z), y AS (SELECT CAST(order_key % 8 AS INT) AS session_id, CASE WHEN mask = 0 THEN 'Matched' ELSE {_KINDS}[{_KIND} + 1] END AS kind FROM k)
            SELECT session_id, kind, count(*) AS n FROM y GROUP BY ROLLUP (session_id, kind)""",
        "order_lookup": f"WITH {_fold()} SELECT order_key, source, arg_max(ord_status, (ingest_ns, r)) FILTER (accepted) AS status, arg_max(cum_qty, (ingest_ns, r)) FILTER (accepted) AS cum_qty FROM f WHERE order_key IN (1, 2, 3, 21, 47) GROUP BY order_key, source",
        "divergence_range": f"SELECT order_key, detect_ns, mask, type FROM ({_emissions(two)}) WHERE emitted AND detect_ns >= {20_000 * _MS} AND detect_ns < {60_000 * _MS}",
        "end_to_end": f"""SELECT 'immediate' AS mode, {end} FROM ({_immediate(_at_once(_KEYED, "own"))})
            UNION ALL SELECT 'two-stage', {end} FROM ({_emissions(_guarded(_KEYED, "own"))}) WHERE emitted""",
        "default_keys": f"WITH {_KEYED} SELECT key_is_default, count(*) AS n, count(DISTINCT order_key) AS n_keys FROM own GROUP BY key_is_default",
    }
