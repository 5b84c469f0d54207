"""Time arithmetic as plain integer column expressions.

Times are handled as microseconds since the epoch (UTC) and grid positions as
``slot`` numbers counted from the epoch, so every step below stays inside
whole-stage codegen and no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

_FREQ = re.compile(r"^\s*(\d*)\s*(us|ms|s|sec|min|t|h|d)\s*$", re.IGNORECASE)
_UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "sec": 1_000_000,
    "min": 60_000_000,
    "t": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}
DAY_US = 86_400_000_000


def freq_to_micros(freq: str | int) -> int:
    """Parse a step such as ``5min``, ``15min``, ``1h`` or ``30s`` (driver side)."""
    if isinstance(freq, int):
        step = freq
    else:
        m = _FREQ.match(freq)
        if not m:
            raise ValueError(f"unsupported frequency: {freq!r}")
        step = int(m.group(1) or 1) * _UNIT_US[m.group(2).lower()]
    if step <= 0:
        raise ValueError(f"frequency must be positive: {freq!r}")
    if DAY_US % step != 0:
        # slots are counted from the epoch; a step that does not divide a day
        # would put bins off midnight, which the grid semantics do not define
        raise ValueError(f"frequency must divide one day: {freq!r}")
    return step


def micros(ts: Column | str, dtype=None) -> Column:
    """Microseconds since the epoch of a timestamp column (session zone UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    return F.unix_micros(c.cast(TimestampType()))


def round_half_even(us: Column, step: int) -> Column:
    """Nearest slot number for ``us``; exact halves go to the even slot."""
    r = F.pmod(us, F.lit(step))
    # (us - r) is an exact multiple of step, so the quotient is exact
    q = ((us - r) / F.lit(step)).cast("bigint")
    half = step // 2
    up = (r > F.lit(half)) | ((r == F.lit(half)) & (F.lit(step % 2) == 0) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, F.lit(1)).otherwise(F.lit(0))


def slot_of(ts: Column | str, step: int, dtype=None) -> Column:
    """Round a timestamp to the grid (ties to even), as a slot number."""
    return round_half_even(micros(ts, dtype), step)


def slot_to_ts(slot: Column | str, step: int) -> Column:
    """Slot number back to a naive (UTC) timestamp."""
    c = F.col(slot) if isinstance(slot, str) else slot
    return F.timestamp_micros(c * F.lit(step)).cast(TimestampNTZType())
