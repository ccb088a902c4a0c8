"""Date windows: the period families as intervals, and columns for calendar buckets. ``today`` is always given."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("single_day", "rolling_days", "previous_days", "rolling_weeks", "completed_weeks", "week_to_date", "rolling_months", "completed_months", "month_to_date", "rolling_years", "completed_years", "year_to_date")


def period(kind: str, today: Column, n: Column | int = 1) -> Column:
    """struct<start, end> (closed) of a period family, for a column of reference days and one of quantities."""
    n = F.lit(n) if isinstance(n, int) else n
    week, month, year = F.date_trunc("week", today).cast("date"), F.trunc(today, "month"), F.trunc(today, "year")
    windows = {
        "single_day": (F.date_sub(today, n), F.date_sub(today, n)),
        "rolling_days": (F.date_sub(today, n - 1), today),
        "previous_days": (F.date_sub(today, n), F.date_sub(today, 1)),
        "rolling_weeks": (F.date_sub(today, 7 * n - 1), today),
        "completed_weeks": (F.date_sub(week, 7 * n), F.date_sub(week, 1)),
        "week_to_date": (week, today),
        "rolling_months": (F.date_add(F.add_months(today, -n), 1), today),
        "completed_months": (F.add_months(month, -n), F.date_sub(month, 1)),
        "month_to_date": (month, today),
        "rolling_years": (F.date_add(F.add_months(today, -12 * n), 1), today),
        "completed_years": (F.add_months(year, -12 * n), F.date_sub(year, 1)),
        "year_to_date": (year, today),
    }
    if kind not in windows:
        raise ValueError(f"unknown period family {kind}")
    start, end = windows[kind]
    return F.struct(start.alias("start"), end.alias("end"))


def explicit(text: Column) -> Column:
    """The day that a text of the form YYYY-MM-DD names; null for any other text and for days that no calendar has."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text))


def days_of(interval: Column) -> Column:
    return F.datediff(interval["end"], interval["start"]) + 1


def previous(start: date, end: date) -> tuple[date, date]:
    """The interval of equal length just before."""
    days = (end - start).days + 1
    return start - timedelta(days=days), start - timedelta(days=1)
