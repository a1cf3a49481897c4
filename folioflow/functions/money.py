"""Money and its displays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000


def zero(c: Column) -> Column:
    """A sum over no rows is 0."""
    return F.coalesce(c, F.lit(0))


def call_cost(tokens_in: Column, cached: Column, tokens_out: Column, p_in: Column, p_cached: Column, p_out: Column, share: Column) -> Column:
    """Price of one call: fresh, cached and written tokens at their prices a million, times the plan's share, half-even to 6 places."""
    wide = "decimal(20,6)"
    fresh = F.greatest(F.lit(0), tokens_in - cached)
    total = fresh.cast(wide) * p_in.cast("decimal(10,4)") + cached.cast(wide) * p_cached.cast("decimal(10,4)") + tokens_out.cast(wide) * p_out.cast("decimal(10,4)")
    exact = total.cast("decimal(28,6)") * share.cast("decimal(6,4)")
    # millionths of a dollar are whole numbers here, so the quotient is exact
    return (F.bround(exact, 0).cast("decimal(18,0)") / F.lit(MILLION)).cast("decimal(18,6)")


def clamped_share(spent: Column, cap: Column) -> Column:
    """Whole percent of a cap, at most 100; null without a cap."""
    return F.when(cap > 0, F.least(F.lit(100), F.floor(spent * 100 / cap))).cast("long")


def nice_max(v: Column) -> Column:
    """The smallest 4 * {1, 2, 2.5, 5} * 10^k that reaches v."""
    steps = F.array(*[F.lit(4 * m * 10.0**k) for k in range(-4, 12) for m in (1.0, 2.0, 2.5, 5.0)])
    return F.array_min(F.filter(steps, lambda x: x >= v))


def format_usd(v: Column) -> Column:
    """Dollars with cents, four places below one cent."""
    return F.concat(F.lit("$"), F.when((v != 0) & (F.abs(v) < 0.01), F.format_number(v, 4)).otherwise(F.format_number(v, 2)))


def tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")
