"""Codes of the event model, as numbers on the wire and in results."""

from __future__ import annotations

# Fixed values.
PRIMARY, DROPCOPY = 0, 1
NEW, PARTIALLY_FILLED, FILLED, CANCELED, REPLACED, REJECTED, UNKNOWN, PENDING_NEW, WORKING, CANCEL_PENDING = range(10)
EXEC_NEW, EXEC_PARTIAL, EXEC_FILL, EXEC_CANCEL, EXEC_REPLACE, EXEC_REJECTED, EXEC_UNKNOWN = range(7)
MISSING_FILL, PHANTOM_ORDER, STATE_MISMATCH, QUANTITY_MISMATCH, TIMING_ANOMALY, MISSING_DROPCOPY = range(6)
GAP, DUPLICATE, OUT_OF_ORDER, GAP_FILL = range(4)
M_STATUS, M_CUM_QTY, M_LEAVES_QTY, M_AVG_PX, M_EXISTENCE, M_EXEC_ID = 1, 2, 4, 8, 16, 32
PARSE_OK, MISSING_FIELD, INVALID = range(3)
R_UNKNOWN, AWAITING_PRIMARY, AWAITING_DROPCOPY, IN_GRACE, MATCHED, DIVERGED_CONFIRMED, SUPPRESSED_BY_GAP = range(7)
GAP_PRIMARY, GAP_DROPCOPY = 1, 2

DIVERGENCE_NAMES = ("MissingFill", "PhantomOrder", "StateMismatch", "QuantityMismatch", "TimingAnomaly", "MissingDropCopy")
RECON_NAMES = ("Unknown", "AwaitingPrimary", "AwaitingDropCopy", "InGrace", "Matched", "DivergedConfirmed", "SuppressedByGap")
#: Statuses and states of reconciliation after which nothing more is due.
TERMINAL_STATUSES, TERMINAL_STATES = (FILLED, CANCELED, REJECTED), (MATCHED, DIVERGED_CONFIRMED)

#: Which statuses may follow each; besides, anything follows UNKNOWN, and each status itself.
SUCCESSORS = {
    NEW: (WORKING, PARTIALLY_FILLED, FILLED, CANCEL_PENDING, REJECTED),
    PENDING_NEW: (WORKING, PARTIALLY_FILLED, FILLED, CANCEL_PENDING, REJECTED),
    WORKING: (PARTIALLY_FILLED, FILLED, CANCEL_PENDING, REJECTED),
    PARTIALLY_FILLED: (PARTIALLY_FILLED, FILLED, CANCEL_PENDING),
    CANCEL_PENDING: (CANCELED, REJECTED, PARTIALLY_FILLED, FILLED),
    REPLACED: (WORKING, PARTIALLY_FILLED, FILLED, CANCEL_PENDING, REJECTED),
}


def may_follow(current: int, new: int) -> bool:
    return current == UNKNOWN or current == new or new in SUCCESSORS.get(current, ())


#: For each current status, a bit for each status that may follow.
FOLLOW_BITS = [sum(1 << n for n in range(10) if may_follow(c, n)) for c in range(10)]
