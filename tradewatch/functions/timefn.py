"""Time expressions.

All event times are TIMESTAMP_NTZ in UTC wall time. ``as_of`` replaces CURRENT_TIMESTAMP
so that look-back filters are literals Catalyst can push into the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def as_ts(value) -> Column:
    """A TIMESTAMP_NTZ literal from 'YYYY-MM-DD HH:MM:SS' (or a Column passed through)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch (floor), i.e. the second boundary count."""
    return F.floor(epoch_micros(ts) / F.lit(1_000_000)).cast("long")


def trunc(unit: str, ts) -> Column:
    """date_trunc that keeps TIMESTAMP_NTZ (Spark's date_trunc returns TIMESTAMP)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def boundary_diff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    Equals the warehouse DATEDIFF semantics: 00:59 -> 01:01 is one hour, 01:00 -> 01:59
    is zero. Spark's ``timestampdiff`` counts elapsed units instead, so it is not used.
    """
    step = _UNIT_MICROS[unit]
    s = F.floor(epoch_micros(start) / F.lit(step))
    e = F.floor(epoch_micros(end) / F.lit(step))
    return (e - s).cast("long")


def shift(as_of: str, amount: float, unit: str) -> str:
    """``as_of + amount unit`` computed on the driver, as a literal string."""
    base = datetime.fromisoformat(str(as_of))
    return (base + timedelta(**{unit + "s": amount})).isoformat(sep=" ")


def since(ts, as_of, amount: int, unit: str) -> Column:
    """``ts >= as_of - amount unit`` with a literal bound, so the filter reaches the scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c >= as_ts(shift(as_of, -amount, unit))

