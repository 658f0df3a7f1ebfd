"""Rounding and exact order statistics, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, functions as F


#: Splits a double into two halves of 26 bits, whose products are exact.
_SPLIT = float(2**27 + 1)


def round_half(x: Column, k: int = 0) -> Column:
    """``x`` to ``k`` decimals, as a double: the exact binary value is rounded, ties away from zero. So 0.25 gives 0.3, but 1.45, which
    as a double is a little less, gives 1.4.

    ``|x| * 10^k`` is rounded itself; its error is found by splitting both factors, and added to what is left beyond the
    whole number. From 2^52 on there is nothing to round.
    """
    m = float(10**k)
    m_high = m * _SPLIT - (m * _SPLIT - m)
    m_low = m - m_high
    v = F.abs(x.cast("double"))
    product = v * m
    high = v * _SPLIT - (v * _SPLIT - v)
    low = v - high
    error = ((high * m_high - product) + high * m_low + low * m_high) + low * m_low
    whole = F.floor(product)
    up = (product - whole - 0.5) + error >= 0
    return F.signum(x.cast("double")) * F.when(product < float(2**52), (whole + up.cast("int")) / m).otherwise(v) + F.lit(0.0)  # no -0


def round_near(x: Column, k: int = 6) -> Column:
    """``x`` to about ``k`` decimals, for results that are compared with those of another order of summation."""
    m = float(10**k)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m


def round_up_half(x: Column) -> Column:
    """To a whole number, ties upwards (-2.5 -> -2)."""
    return F.floor(x + 0.5).cast("bigint")


def fixed(x: float | None, k: int) -> str | None:
    """Display form with ``k`` decimals of the exact binary value, ties away from zero."""
    return None if x is None else str(Decimal(x).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP, context=Context(prec=400)))


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent; null when there is nothing to compare with."""
    return F.when(before > 0, (after / before - 1) * 100)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside lambdas no common subexpression is kept, and an expression
    that is written several times is evaluated as often."""
    return F.transform(F.array(value), use)[0]


def array_median(a: Column) -> Column:
    """Exact median of an array, the mean of the middle two where their number is even; null elements do not count,
    an array without others gives null."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.array_sort(F.filter(a, lambda x: x.isNotNull())), middle)


def damped(v: Column) -> Column:
    """Natural logarithm of one more than a count; null and negative counts are 0."""
    return F.log1p(F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)).cast("double"))


def nice_ceiling(x: Column) -> Column:
    """The least number of one significant digit that is not below ``x``; 1 for what is not positive."""
    m = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.ceil(x / m) * m).otherwise(1.0)


def abbreviated(n: Column) -> Column:
    """Compact figure: 261, 8.6k, 193k, 1.2M; a dash for null. Rounded before the unit is chosen."""
    a = F.abs(n)
    tenth = lambda x: F.format_string("%.1f", round_half(x, 1))
    return (
        F.when(n.isNull(), "–")
        .when(a < 1000, n.cast("string"))
        .when(a < 9950, F.concat(tenth(n / 1000.0), F.lit("k")))
        .when(a < 999_500, F.concat(round_up_half(n / 1000.0).cast("string"), F.lit("k")))
        .otherwise(F.concat(tenth(n / 1e6), F.lit("M")))
    )
