"""Reads of the state at one month, and month grids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from headgrid.functions.temporal import active_at, is_open, month_lit, month_sequence


def in_versions(entries: DataFrame, versions: str | Iterable[str] | None) -> DataFrame:
    """Keep some versions. ``version_id`` is the partition column, so this prunes files."""
    if versions is None:
        return entries
    wanted = [versions] if isinstance(versions, str) else list(versions)
    return entries.where(F.col("version_id").isin(wanted))


def asof(entries: DataFrame, month: str | dt.date, versions: str | Iterable[str] | None = None) -> DataFrame:
    """Rows in force at ``month``: a pushed-down filter, no shuffle."""
    return in_versions(entries, versions).where(active_at(month_lit(month)))


def asof_snapshot(entries: DataFrame, month: str | dt.date, version: str, ordered: bool = False) -> DataFrame:
    """Snapshot of a version. ``ordered`` adds the report order, which costs a total sort."""
    rows = asof(entries, month, version)
    if ordered:
        rows = rows.orderBy(F.asc_nulls_last("employee_id"), F.asc_nulls_last("container_id"))
    return rows


def _asof_subject(entries, month, version, subject, subjects):
    rows = asof(entries, month, version).where(F.col(subject).isNotNull())
    if subjects is not None:
        rows = rows.join(subjects.select(subject).distinct(), subject, "left_semi")
    # One row per subject. min over a struct is combined before the shuffle, so a
    # subject with very many overlapping rows does not gather in one task.
    rest = [c for c in rows.columns if c not in ("version_id", subject)]
    first = [c for c in ("valid_from", "id") if c in rest]
    state = F.struct(*first, *[c for c in rest if c not in first])
    picked = rows.groupBy("version_id", subject).agg(F.min(state).alias("state"))
    return picked.select("version_id", subject, *[F.col("state")[c].alias(c) for c in rest])


def asof_employee(entries: DataFrame, month, version: str, employees: DataFrame | None = None) -> DataFrame:
    """The active row of each employee, or of those listed in ``employees``.

    Overlapping rows are possible after a backdated insert; the earliest
    ``(valid_from, id)`` is then the one returned.
    """
    return _asof_subject(entries, month, version, "employee_id", employees)


def asof_container(entries: DataFrame, month, version: str, containers: DataFrame | None = None) -> DataFrame:
    """The active row of each planning container, or of those listed."""
    return _asof_subject(entries, month, version, "container_id", containers)


def open_rows(entries: DataFrame, versions: str | Iterable[str] | None = None) -> DataFrame:
    return in_versions(entries, versions).where(is_open())


def month_spine(ranges: DataFrame, start: str | Column, end: str | Column, name: str = "month_start") -> DataFrame:
    """One row per month of each row's range, both ends included; none where start > end."""
    first = F.col(start) if isinstance(start, str) else start
    last = F.col(end) if isinstance(end, str) else end
    return ranges.withColumn(name, F.explode(month_sequence(first, last)))
