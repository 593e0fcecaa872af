"""Keyed lookups and sorted listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lookup_by_id(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is listed. Small key sets are broadcast by Spark's own size check."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def config_value(config: DataFrame, key: str, kind: str = "string") -> DataFrame:
    """The value of a setting as ``kind``; NULL if it cannot be read as that."""
    return config.where(F.col("key") == key).select(F.expr(f"try_cast(value as {kind})").alias("value"))


def resolve_codes(rows: DataFrame, lookup: DataFrame, code: str, into: str, lookup_code: str = "code", lookup_id: str = "id") -> DataFrame:
    """Add the id behind each code as ``into``; an unknown code gives NULL and keeps its row."""
    ids = lookup.select(F.col(lookup_code).alias(code), F.col(lookup_id).alias(into))
    return rows.join(ids, code, "left")


def run_by_period(runs: DataFrame, periods: DataFrame) -> DataFrame:
    """Import runs of the listed ``(period_year, period_month)``, whatever their status."""
    period = ["period_year", "period_month"]
    return runs.join(periods.select(*period).distinct(), period, "left_semi")


def working_version(versions: DataFrame) -> DataFrame:
    """The working version, or no row. Two of them break a rule; reading the result then fails."""
    columns = ["id", "label", "period_year", "period_month", "fc_horizon_months", "source_version_id", "created_at"]
    working = versions.where(F.col("status") == "working").select(*[c for c in columns if c in versions.columns])
    row = F.struct(*working.columns)
    only = working.agg(F.count("*").alias("n"), F.first(row).alias("row")).where("n > 0")
    checked = F.when(F.col("n") > 1, F.raise_error(F.lit("more than one working version"))).otherwise(F.col("row"))
    return only.select(checked.alias("row")).select("row.*")


def latest_completed_run(runs: DataFrame) -> DataFrame:
    return (
        runs.where(F.col("status") == "completed")
        .orderBy(F.desc("period_year"), F.desc("period_month"))
        .limit(1)
    )


def actuals_history(actuals: DataFrame, runs: DataFrame, employees: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Monthly states of employees with their period, newest first when ``ordered``."""
    rows = actuals if employees is None else lookup_by_id(actuals, employees, "employee_id")
    periods = runs.select(F.col("id").alias("import_run_id"), "period_year", "period_month")
    joined = rows.join(periods, "import_run_id")
    if ordered:
        joined = joined.orderBy("employee_id", F.desc("period_year"), F.desc("period_month"))
    return joined


def sorted_listing(table: DataFrame, columns: list[str], order: list[str | Column], where: str | None = None) -> DataFrame:
    rows = table if where is None else table.where(where)
    return rows.orderBy(*order).select(*columns)


def list_active_costcenters(costcenters: DataFrame) -> DataFrame:
    return sorted_listing(costcenters, ["id", "code", "name", "level", "parent_id"], ["level", "code"], "is_active")


def list_lookups(table: DataFrame) -> DataFrame:
    """Active classification types or employee groups in display order."""
    return sorted_listing(table, ["id", "code", "label", "sort_order"], ["sort_order", "label"], "is_active")


def list_versions(versions: DataFrame) -> DataFrame:
    columns = ["id", "label", "status", "period_year", "period_month", "source_version_id", "archived_at", "created_at"]
    order = [F.desc(c) for c in ("period_year", "period_month", "created_at") if c in versions.columns]
    return sorted_listing(versions, [c for c in columns if c in versions.columns], order)


def list_import_runs(runs: DataFrame) -> DataFrame:
    columns = ["id", "period_year", "period_month", "status", "row_count", "imported_at"]
    order = [F.desc("period_year"), F.desc("period_month")]
    return sorted_listing(runs, [c for c in columns if c in runs.columns], order)
