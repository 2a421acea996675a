"""Small column helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_MONEY = "decimal(38,2)"


def money_sum(c: str | Column) -> Column:
    """Exact decimal sum with a fixed result type (38,2)."""
    return F.sum(c).cast(SUM_MONEY)


def mean_of(total: Column, n: Column) -> Column:
    """Mean as a double from an exact decimal sum and a count (one
    rounding step, independent of summation order; NULL for n = 0)."""
    return total.cast("double") / F.nullif(n, F.lit(0)).cast("double")


def pct(part: Column, total: Column, scale: int = 2) -> Column:
    """round(100 * part / nullif(total, 0), scale) in decimal arithmetic."""
    return F.round(F.lit(100).cast("decimal(3,0)") * part / F.nullif(total, F.lit(0)), scale)


def row_json(*cols: str | Column) -> Column:
    """JSON image of a row keeping NULL fields (like a database row_to_json)."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def truncate_text(c: str | Column, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, 1, n)


def utc_from_offset_text(c: str | Column) -> Column:
    """'2024-01-15 08:00:00+03' -> the instant's UTC wall time as timestamp_ntz.
    Relies on the session zone being UTC (``session.CORE_CONF``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp(c, "yyyy-MM-dd HH:mm:ssX").cast("timestamp_ntz")


def epoch_seconds(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)
