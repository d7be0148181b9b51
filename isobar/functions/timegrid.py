"""Time arithmetic on zone-free timestamps.

Longer formulas are written as SQL text, which Spark parses in one call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def sql_seconds(ts: str) -> str:
    """Whole seconds since 1970-01-01 of a timestamp expression, without going through a time zone."""
    return f"(unix_date(cast({ts} as date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"


def sql_plus(ts: str, secs: str) -> str:
    return f"timestampadd(SECOND, {secs}, {ts})"


def sql_floor(ts: str, step: int) -> str:
    """Start of the step (in seconds) that holds a timestamp expression."""
    secs = sql_seconds(ts)
    return sql_plus(EPOCH, f"{secs} - pmod({secs}, {step}L)")


def seconds(ts: str) -> Column:
    return F.expr(sql_seconds(ts))


def floor_to(ts: str, step: int) -> Column:
    return F.expr(sql_floor(ts, step))


def plus_seconds(ts: Column, secs: Column | int) -> Column:
    return F.timestamp_add("SECOND", F.lit(secs).cast("long") if isinstance(secs, int) else secs.cast("long"), ts)


def at(text: str) -> Column:
    """Timestamp literal without zone."""
    return F.to_timestamp_ntz(F.lit(text))
