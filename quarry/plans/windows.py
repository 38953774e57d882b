"""Half-open time windows [start, end) relative to a given day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.model import PlanError, TimeRange


def months(day: date, n: int) -> date:
    """The first of the month n months from the day's."""
    k = day.year * 12 + day.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def shift(day: date, n: int) -> date:
    """The day n months later, or the last day of that month if it is shorter."""
    first = months(day, n)
    return min(first + timedelta(day.day - 1), months(first, 1) - timedelta(1))


def bounds(time: TimeRange, as_of: date, comparing: bool = False) -> tuple[date, date]:
    """The window of a kind. Compared with an earlier period, the current year ends tomorrow; otherwise at the year's end."""
    year = date(as_of.year, 1, 1)
    tomorrow = as_of + timedelta(1)
    if time.kind == "current_year":
        return year, tomorrow if comparing else date(as_of.year + 1, 1, 1)
    if time.kind == "year_to_date":
        return year, tomorrow
    if time.kind == "first_half":
        return year, date(as_of.year, 7, 1)
    if time.kind == "current_month":
        return months(as_of, 0), tomorrow if comparing else months(as_of, 1)
    if time.kind == "previous_month":
        return months(as_of, -1), months(as_of, 0)
    if time.kind == "month":
        y, m = map(int, (time.value or "").split("-"))
        return date(y, m, 1), months(date(y, m, 1), 1)
    if time.kind == "complete_months":
        return months(as_of, -time.count), months(as_of, 0)
    if time.kind == "days":  # so many days up to and with today
        return tomorrow - timedelta(time.count), tomorrow
    raise PlanError(f"unknown time range {time.kind!r}")


def inside(column: Column, window: tuple[date, date]) -> Column:
    day = column.cast("date")
    return (day >= F.lit(window[0])) & (day < F.lit(window[1]))


def period(column: Column, grain: str) -> Column:
    return F.date_format(column.cast("date"), "yyyy" if grain == "year" else "yyyy-MM")
