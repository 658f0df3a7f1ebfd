"""Calendar arithmetic. Nothing reads the clock: the day of the analysis is an argument."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta
import re

from pyspark.sql import Column, functions as F

#: First day with counts; days until a count is published; days at the end of a series that may still be revised.
FLOOR, LAG_DAYS, VOLATILE_DAYS = date(2015, 7, 1), 2, 3


@dataclass(frozen=True)
class Span:
    start: date
    end: date
    months: int


def add_months(d: date, n: int) -> date:
    """``n`` months on, the day clamped to the month's length."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, monthrange(y, m + 1)[1]))


def month_end(d: date) -> date:
    return d.replace(day=monthrange(d.year, d.month)[1])


def last_complete_month(as_of: date) -> date:
    """First day of the month before ``as_of``'s, even on a month's last day."""
    return add_months(as_of.replace(day=1), -1)


def latest_published(as_of: date) -> date:
    return as_of - timedelta(days=LAG_DAYS)


def since_months(text: str) -> int:
    """Months of ``2y``, ``18m`` or ``90d`` (a month has 30 days, at least one month)."""
    m = re.fullmatch(r"(\d+)([dmy])", text)
    if not m:
        raise ValueError(f"not a span: {text!r}; write 2y, 18m or 90d")
    n = int(m[1])
    return {"y": 12 * n, "m": n, "d": max(1, int(n / 30 + 0.5))}[m[2]]


def since_start(text: str, end: date) -> date:
    """First day of the span that ends on ``end``."""
    m = re.fullmatch(r"(\d+)([dmy])", text)
    if not m:
        raise ValueError(f"not a span: {text!r}; write 2y, 18m or 90d")
    n = int(m[1])
    return end - timedelta(days=n) if m[2] == "d" else add_months(end, -n * (12 if m[2] == "y" else 1))


def month_window(as_of: date, months: int) -> Span:
    """The ``months`` complete months before ``as_of``."""
    last = last_complete_month(as_of)
    return Span(add_months(last, 1 - months), month_end(last), months)


def month_of(d: Column) -> Column:
    return F.trunc(d, "MM")


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def month_label(month: Column) -> Column:
    """``01.26``."""
    return F.date_format(month, "MM.yy")


def quarter_label(month: Column) -> Column:
    """``Q1 26``."""
    return F.concat(F.lit("Q"), F.quarter(month).cast("string"), F.lit(" "), F.date_format(month, "yy"))
