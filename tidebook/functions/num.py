"""Null-honest numeric helpers shared by every price rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-7


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_dp(x: Column, dp: int) -> Column:
    """Decimal half-up rounding that does not depend on a value's binary tail.

    The nudge lifts values such as 5002.4999999999 (a decimal tie that binary
    arithmetic lands just below) onto the tie, so every engine rounds alike.
    """
    scale = float(10**dp)
    return F.floor(lit(x) * scale + (0.5 + NUDGE)).cast("double") / scale


def finite(x: Column) -> Column:
    """NaN and infinities are unknown, never numbers."""
    x = lit(x)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~bad, x)


def as_price(x) -> Column:
    """Anything to a finite double, else NULL."""
    return finite(lit(x).try_cast("double"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Guarded clamp: greatest/least skip NULLs, so an unguarded clamp invents a price."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def milli(x: Column) -> Column:
    """Integer thousandths, for equality and threshold tests on the price grid."""
    return F.floor(x * 1000.0 + (0.5 + NUDGE)).cast("int")


def decimilli(x: Column) -> Column:
    return F.floor(x * 10000.0 + (0.5 + NUDGE)).cast("int")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
