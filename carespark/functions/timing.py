"""Time helpers. Every look-back takes an explicit reference time (`as_of`)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def as_column(as_of) -> Column:
    """Accept a Column, a datetime or an ISO string as the reference time."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        return F.lit(as_of)
    return F.lit(as_of).cast("timestamp")


def back(as_of, *, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return as_column(as_of) - F.expr(
        f"make_dt_interval({days}, {hours}, {minutes}, {seconds})"
    )


def recent(df: DataFrame, ts: str, as_of, **span: int) -> DataFrame:
    """Rows strictly newer than `as_of - span`; the bound reaches the scan.

    Where the rows have a `day` of their time, as history tables do, earlier
    day partitions are not read.
    """
    since = back(as_of, **span)
    rows = df.where(F.col(ts) > since)
    return rows.where(F.col("day") >= F.to_date(since)) if dict(df.dtypes).get("day") == "date" else rows


def seconds_between(later, earlier) -> Column:
    """Whole-second boundaries crossed from `earlier` to `later`."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def minutes_between(later, earlier) -> Column:
    """Whole-minute boundaries crossed from `earlier` to `later`."""
    minute = lambda c: F.floor(F.unix_timestamp(c) / 60)
    return minute(later) - minute(earlier)


def compact_stamp(ts) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def recency_key(ts, tiebreak) -> Column:
    """One sortable decimal from (timestamp, numeric id).

    A primitive key keeps `max_by` inside hash aggregation; a struct key would
    force a sort of all input rows.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + F.col(
        tiebreak
    ).cast("decimal(18,0)")
