"""Month-grain validity: intervals are ``[valid_from, valid_to)``, NULL ``valid_to`` = open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def month_date(value: str | dt.date) -> dt.date:
    """Read a first-of-month date; anything else is refused.

    Month grids step from their first month, so a start on day 29-31 would have
    no single meaning.
    """
    day = dt.date.fromisoformat(value) if isinstance(value, str) else value
    if day.day != 1:
        raise ValueError(f"{day} is not the first day of a month")
    return day


def month_lit(value: str | dt.date) -> Column:
    return F.lit(month_date(value))


def active_at(month: Column, valid_from="valid_from", valid_to="valid_to", is_deleted="is_deleted") -> Column:
    """Rows in force at ``month``. A soft delete hides the row's whole interval."""
    return (
        (F.col(valid_from) <= month)
        & (F.col(valid_to).isNull() | (F.col(valid_to) > month))
        & ~F.col(is_deleted)
    )


def is_open(valid_to="valid_to", is_deleted="is_deleted") -> Column:
    return F.col(valid_to).isNull() & ~F.col(is_deleted)


def first_active_month(valid_from: str | Column = "valid_from") -> Column:
    """First month start on or after ``valid_from``."""
    return F.trunc(F.add_months(F.date_sub(valid_from, 1), 1), "MM")


def last_active_month(valid_to: str | Column = "valid_to") -> Column:
    """Last month start before ``valid_to``, right for mid-month ends too."""
    return F.trunc(F.date_sub(valid_to, 1), "MM")


def month_sequence(first: Column, last: Column) -> Column:
    """Array of month starts, both ends included; empty where ``first > last``."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))


def period_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def next_period_start(year: str | Column, month: str | Column) -> Column:
    return F.add_months(period_start(year, month), 1)


def horizon_end(start: str | dt.date, months: int) -> dt.date:
    """Last month of a grid of ``months`` months that begins at ``start``."""
    day = month_date(start)
    if months < 1:
        raise ValueError("a horizon has at least one month")
    index = day.year * 12 + day.month - 1 + months - 1
    return dt.date(index // 12, index % 12 + 1, 1)
