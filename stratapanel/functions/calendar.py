"""Trading days of the New York exchange by rule, as a table to join with."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def easter(year: int) -> date:
    """Sunday of Easter in the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def holidays(year: int) -> set[date]:
    """Full-day closings; those on a Saturday move to Friday (New Year's Day does not), on a Sunday to Monday."""
    fixed = [date(year, 7, 4), date(year, 12, 25)] + ([date(year, 6, 19)] if year >= 2022 else [])
    out = {d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d for d in fixed}
    new_year = date(year, 1, 1)
    out |= {new_year + timedelta(1)} if new_year.weekday() == 6 else {new_year}
    out |= {_nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    return out | ({_nth(year, 1, 0, 3)} if year >= 1998 else set())


def is_trading_day(day: date) -> bool:
    return day.weekday() < 5 and day not in holidays(day.year)


def previous_trading_day(day: date) -> date:
    day -= timedelta(1)
    return day if is_trading_day(day) else previous_trading_day(day)


def next_trading_day(day: date) -> date:
    day += timedelta(1)
    return day if is_trading_day(day) else next_trading_day(day)


def trading_days(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(date): a row a trading day, so at most some 260 a year."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date").where(F.weekday("date") < 5)
    closed = sorted({d for y in range(first.year, last.year + 1) for d in holidays(y)})
    return days.where(~F.col("date").isin(closed))


def business_days_old(day: str, today: str = "today"):
    """Column: weekdays after a date up to another one."""
    span = F.sequence(F.col(day), F.col(today))
    return F.when(F.col(day) <= F.col(today), F.size(F.filter(span, lambda d: F.weekday(d) < 5)) - (F.weekday(F.col(day)) < 5).cast("int"))
