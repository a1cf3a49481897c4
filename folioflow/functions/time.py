"""UTC calendar arithmetic as column expressions; weeks start on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor(ts: Column, period: str) -> Column:
    return F.date_trunc(period, ts).cast("date")


def step(start: Column, period: str, n: int) -> Column:
    """The bucket n periods later (earlier, if negative)."""
    if period == "month":
        return F.add_months(start, n)
    return F.date_add(start, n * (7 if period == "week" else 1))


def next_renewal(start: Column, now: Column) -> Column:
    """The first monthly return of a day after now; the 31st falls on shorter months' last day."""
    months = F.floor(F.months_between(now, start)).cast("int") + 1
    return F.add_months(start, F.greatest(months, F.lit(0)))


def duration(seconds: Column) -> Column:
    """1h 02m, or 5m 09s under an hour."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm %02ds", m, s % 60))
