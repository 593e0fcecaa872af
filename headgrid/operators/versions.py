"""Version life cycle: first version, archive, month-end rollover."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from headgrid.functions.keys import hashed_id
from headgrid.functions.temporal import month_date, month_lit, next_period_start
from headgrid.operators.audit import CHANGE_MAP, audit_record
from headgrid.operators.scd2 import PAYLOAD
from headgrid.operators.snapshot import asof, in_versions
from headgrid.schema import TABLES


class NoWorkingVersion(LookupError):
    """There is no working version to archive."""


class NotWorking(ValueError):
    """The version to archive is not the working one."""


@dataclass
class Rollover:
    """Registry after the rollover, rows of the new version, their audit, and rows left behind."""

    version_id: str
    versions: DataFrame
    seeded: DataFrame
    audit: DataFrame
    not_copied: DataFrame


def working_row(versions: DataFrame) -> Row | None:
    """The registry row of the working version. Two of them break a rule and raise."""
    rows = versions.where(F.col("status") == "working").take(2)
    if len(rows) > 1:
        raise ValueError("more than one working version")
    return rows[0] if rows else None


def new_version(versions: DataFrame, label: str, period: str | dt.date, horizon: int, user: str, at: dt.datetime, source: str | None) -> DataFrame:
    """One registry row for a new working version."""
    month = month_date(period)
    if not 1 <= horizon <= 60:
        raise ValueError("the horizon is 1 to 60 months")
    spark = versions.sparkSession
    schema = TABLES["forecast_versions"]
    row = spark.createDataFrame(
        [("", label, "working", month.year, month.month, horizon, source, None, None, user, at)], schema
    )
    ident = hashed_id(F.lit("version"), "label", "period_year", "period_month", "source_version_id")
    return row.withColumn("id", ident)


def archive_version(versions: DataFrame, version: str, user: str, at: dt.datetime) -> DataFrame:
    """Registry with ``version`` archived. Only a working version can be."""
    hit = (F.col("id") == version) & (F.col("status") == "working")
    if versions.where(hit).isEmpty():
        raise NotWorking(f"{version} is not a working version")
    return (
        versions.withColumn("__hit", hit)
        .withColumn("status", F.when(F.col("__hit"), "archived").otherwise(F.col("status")))
        .withColumn("archived_at", F.when(F.col("__hit"), F.lit(at)).otherwise(F.col("archived_at")))
        .withColumn("archived_by", F.when(F.col("__hit"), F.lit(user)).otherwise(F.col("archived_by")))
        .drop("__hit")
    )


def create_initial_version(versions: DataFrame, label: str, period, horizon: int, user: str, at: dt.datetime) -> DataFrame:
    """Registry with a first working version."""
    if working_row(versions) is not None:
        raise ValueError("a working version exists")
    return versions.unionByName(new_version(versions, label, period, horizon, user, at, None))


def get_or_create_working(versions: DataFrame, label: str, period, horizon: int, user: str, at: dt.datetime) -> DataFrame:
    """The registry itself if it has a working version, else with a first one."""
    if working_row(versions) is not None:
        return versions
    return create_initial_version(versions, label, period, horizon, user, at)


def seed_rows(entries: DataFrame, source: str, target: str, period, user: str, at) -> DataFrame:
    """Rows of ``source`` in force at the new period, as open rows of ``target``.

    Rows that start later are not copied, and a planned end is dropped. This is one
    scan of one version partition and needs no shuffle.
    """
    start = month_lit(period)
    payload = [c for c in PAYLOAD if c in entries.columns]
    return asof(entries, period, source).select(
        hashed_id(F.lit(target), F.col("id")).alias("id"),
        F.lit(target).alias("version_id"),
        "employee_id",
        "container_id",
        *payload,
        start.alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit(False).alias("is_deleted"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_by"),
        F.lit(user).alias("created_by"),
        F.lit(at).alias("created_at"),
        F.col("id").alias("source_entry_id"),
    )


def rows_left_behind(entries: DataFrame, source: str, period) -> DataFrame:
    """Live rows of ``source`` that start after the new period: planned changes a rollover loses."""
    later = F.col("valid_from") > month_lit(period)
    return in_versions(entries, source).where(~F.col("is_deleted") & later)


def insert_audit(rows: DataFrame) -> DataFrame:
    """INSERT records for new rows."""
    return audit_record(
        rows.select(
            F.col("id").alias("forecast_entry_id"),
            "version_id",
            F.lit("INSERT").alias("action"),
            F.lit(None).cast(CHANGE_MAP).alias("changed_fields"),
            F.col("created_by").alias("changed_by"),
            F.col("created_at").alias("changed_at"),
        )
    )


def rollover(entries: DataFrame, versions: DataFrame, label: str, period, horizon: int, user: str, at: dt.datetime) -> Rollover:
    """Archive the working version, register a new one and seed it."""
    current = working_row(versions)
    if current is None:
        raise NoWorkingVersion("no working version exists")
    archived = archive_version(versions, current.id, user, at)
    created = new_version(versions, label, period, horizon, user, at, current.id)
    target = created.first().id
    seeded = seed_rows(entries, current.id, target, period, user, at)
    return Rollover(
        target,
        archived.unionByName(created),
        seeded.drop("source_entry_id"),
        insert_audit(seeded),
        rows_left_behind(entries, current.id, period),
    )


def next_period(periods: DataFrame, year: str = "period_year", month: str = "period_month") -> DataFrame:
    """Add the following period, with the year carried over after December."""
    start = next_period_start(year, month)
    return periods.select("*", F.year(start).alias("next_year"), F.month(start).alias("next_month"))
