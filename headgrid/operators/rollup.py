"""FTE and head-count roll-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from headgrid.functions.keys import total
from headgrid.functions.temporal import (
    first_active_month,
    horizon_end,
    last_active_month,
    month_date,
    month_sequence,
)
from headgrid.operators.hierarchy import hierarchy_descendants, hierarchy_tree
from headgrid.operators.snapshot import asof, in_versions


def month_runs(entries: DataFrame, start, end, by: list[str], measure: str = "fte") -> DataFrame:
    """Sum and count per ``by`` and run of months within the grid ``start..end``.

    Each row covers a run of months, clipped to the grid. A grid of 18 months has at
    most 171 runs, so after the map-side combine only ``groups x runs`` rows are
    shuffled, and a group that holds a third of the table is combined before it
    moves.
    """
    first_day, last_day = month_date(start), month_date(end)
    first, last = F.lit(first_day), F.lit(last_day)
    return (
        entries.where(~F.col("is_deleted"))
        .where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
        .select(
            *by,
            F.greatest(first_active_month(), first).alias("first_month"),
            F.least(F.coalesce(last_active_month(), last), last).alias("last_month"),
            measure,
        )
        .where(F.col("first_month") <= F.col("last_month"))
        .groupBy(*by, "first_month", "last_month")
        .agg(F.sum(measure).alias("run_fte"), F.count("*").alias("run_heads"))
    )


def explode_months(entries: DataFrame, start, end, by: list[str], measure: str = "fte") -> DataFrame:
    """Sum and count per ``by`` and month of the grid ``start..end``.

    The months are unfolded from the few summed runs, not from the rows of the table,
    and no join with a calendar is needed.
    """
    months = F.explode(month_sequence(F.col("first_month"), F.col("last_month"))).alias("month_start")
    return (
        month_runs(entries, start, end, by, measure)
        .select(*by, months, "run_fte", "run_heads")
        .groupBy("month_start", *by)
        .agg(total("run_fte").alias("total_fte"), F.sum("run_heads").alias("headcount"))
    )


def monthly_rollup(entries: DataFrame, start, end, version: str, by: str = "costcenter_id", ordered: bool = True) -> DataFrame:
    """Total FTE and head count per month and cost centre of a version.

    A month without an active row for a cost centre has no output row. Head count
    counts every active row, containers included.
    """
    rolled = explode_months(in_versions(entries, version), start, end, [by])
    return rolled.orderBy("month_start", by) if ordered else rolled


def monthly_rollup_horizon(entries: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """Roll-up over the months that the version itself covers, from its period on."""
    row = versions.where(F.col("id") == version).select("period_year", "period_month", "fc_horizon_months").first()
    if row is None:
        raise LookupError(f"no version {version}")
    start = dt.date(row.period_year, row.period_month, 1)
    return monthly_rollup(entries, start, horizon_end(start, row.fc_horizon_months), version)


def monthly_rollup_positive(entries: DataFrame, start, end, version: str) -> DataFrame:
    """Roll-up that counts only employees with FTE above zero."""
    return monthly_rollup(
        entries.where((F.col("fte") > 0) & F.col("employee_id").isNotNull()), start, end, version
    )


def rollup_grid(entries: DataFrame, start, end, version: str) -> DataFrame:
    """Cost centres as rows, one FTE and one head-count column per month."""
    first, last = month_date(start), month_date(end)
    span = (last.year - first.year) * 12 + last.month - first.month
    months = [horizon_end(first, i + 1) for i in range(span + 1)]
    runs = month_runs(in_versions(entries, version), first, last, ["costcenter_id"])
    # The month list is known, so the columns are conditional sums over the runs: no pass to
    # find them, and no unfolding.
    sums = []
    for m in months:
        covers = (F.col("first_month") <= F.lit(m)) & (F.col("last_month") >= F.lit(m))
        sums.append(total(F.when(covers, F.col("run_fte"))).alias(f"fte_{m:%Y_%m}"))
        sums.append(F.sum(F.when(covers, F.col("run_heads"))).alias(f"heads_{m:%Y_%m}"))
    return runs.groupBy("costcenter_id").agg(*sums).orderBy("costcenter_id")


def actuals_rollup(actuals: DataFrame, run: str | None = None) -> DataFrame:
    """FTE and head count per cost centre of one import run, or of every run."""
    rows = actuals if run is None else actuals.where(F.col("import_run_id") == run)
    by = ["costcenter_id"] if run is not None else ["import_run_id", "costcenter_id"]
    return rows.groupBy(*by).agg(total("fte").alias("total_fte"), F.count("*").alias("headcount")).orderBy(*by)


def snapshot_by_cc(entries: DataFrame, month, version: str) -> DataFrame:
    return asof(entries, month, version).groupBy("costcenter_id").agg(
        total("fte").alias("total_fte"), F.count("*").alias("headcount")
    )


def hierarchy_rollup(entries: DataFrame, costcenters: DataFrame, month, version: str) -> DataFrame:
    """FTE of every node of the active tree, its descendants included.

    The table is summed per cost centre first; only those sums meet the tree.
    """
    tree = hierarchy_tree(costcenters, ordered=False).select("id", "path_ids")
    sums = snapshot_by_cc(entries, month, version)
    return (
        sums.join(tree, sums["costcenter_id"] == tree["id"])
        .select(F.explode("path_ids").alias("costcenter_id"), "total_fte", "headcount")
        .groupBy("costcenter_id")
        .agg(total("total_fte").alias("total_fte"), F.sum("headcount").alias("headcount"))
    )


def subtree_rollup(entries: DataFrame, costcenters: DataFrame, roots: DataFrame, start, end, version: str) -> DataFrame:
    """Monthly roll-up per root, over the active cost centres below it.

    ``roots`` has a column ``root_id``. The roll-up runs once for all roots and its
    result, not the table, is joined with the sub-trees.
    """
    below = hierarchy_descendants(costcenters, roots, ordered=False).select("root_id", F.col("id").alias("costcenter_id"))
    rolled = monthly_rollup(entries, start, end, version, ordered=False)
    return rolled.join(below, "costcenter_id").select(
        "root_id", "month_start", "costcenter_id", "total_fte", "headcount"
    )
