"""Settings of a reconciliation, in nanoseconds and units of the fields compared."""

from __future__ import annotations

from dataclasses import dataclass

MS = 1_000_000


@dataclass(frozen=True)
class ReconConfig:
    grace_ns: int = 500 * MS
    dedup_ns: int = 1000 * MS
    gap_close_ns: int = 1000 * MS
    gap_timeout_ns: int = 30_000 * MS
    gap_recheck_ns: int = 100 * MS
    qty_tolerance: int = 0
    px_tolerance: int = 0
    #: Immediate mode: by how much the drop copy's time may precede the primary's.
    timing_slack_ns: int = 0
    compare_exec_id: bool = True
    #: The time of the last poll: open mismatches whose deadline lies before it are confirmed. None: all are.
    horizon_ns: int | None = None
