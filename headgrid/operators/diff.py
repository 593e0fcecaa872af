"""Comparisons between versions, months and tracks.

Both sides of a comparison live in the same table, so each is one pass with
conditional aggregates instead of two aggregates and a full outer join. A side
without rows stays NULL. Map-side combine keeps a dominating key small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headgrid.functions.keys import distinct_from, join_on, subject_key, subject_kind, total
from headgrid.operators.hierarchy import version_chain
from headgrid.operators.snapshot import asof
from headgrid.session import broadcast_if_small, cut

WIDE = "decimal(38,4)"
PRUNED_VERSIONS = 1000
STATE = ("costcenter_id", "classification_id", "employee_group_id", "fte")


def _delta(new: str, old: str) -> Column:
    zero = F.lit(0).cast(WIDE)
    return (F.coalesce(F.col(new), zero) - F.coalesce(F.col(old), zero)).cast(WIDE)


def _sum_where(condition: Column, measure: str = "fte") -> Column:
    return total(F.when(condition, F.col(measure)))


def diff_versions_by_cc(entries: DataFrame, version_a: str, version_b: str, month) -> DataFrame:
    """Cost centres whose FTE differs at ``month``. A total of 0 differs from none."""
    version = F.col("version_id")
    return (
        asof(entries, month, [version_a, version_b])
        .groupBy("costcenter_id")
        .agg(
            _sum_where(version == version_a).alias("fte_version_a"),
            _sum_where(version == version_b).alias("fte_version_b"),
        )
        .where(distinct_from(F.col("fte_version_a"), F.col("fte_version_b")))
        .withColumn("fte_delta", _delta("fte_version_b", "fte_version_a"))
        .orderBy("costcenter_id")
    )


def diff_versions_by_subject(entries: DataFrame, version_a: str, version_b: str, month, ordered: bool = False) -> DataFrame:
    """Employees and containers whose cost centre, classification, group or FTE differs.

    The two versions are multisets of (subject, state): a row of the newer one counts +1, one of
    the older one -1, and equal states cancel in one combined sum. What is left of a subject is its
    change: one state at most on each side gives a paired row. Where rows overlap, more may be left;
    then each state gives its own one-sided row (``rows_a``/``rows_b`` say how often it is held
    beyond the other side). Pairing every state with every other would count the FTE more than
    once. The deltas always add up to the difference of the two totals.
    """
    subject = ["subject_kind", "subject_key"]
    version = F.col("version_id")
    sign = (version == version_b).cast("long") - (version == version_a).cast("long")
    rows = asof(entries, month, [version_a, version_b]).select(
        subject_kind().alias("subject_kind"), subject_key().alias("subject_key"), *STATE, sign.alias("sign")
    )
    changed = rows.groupBy(*subject, *STATE).agg(F.sum("sign").alias("surplus")).where("surplus <> 0")
    changed = changed.select(
        *subject,
        "surplus",
        F.struct(*STATE).alias("state"),
        F.greatest(-F.col("surplus"), F.lit(0)).alias("rows_a"),
        F.greatest(F.col("surplus"), F.lit(0)).alias("rows_b"),
    )
    left = changed.groupBy(*subject).agg(F.sum("rows_a").alias("all_a"), F.sum("rows_b").alias("all_b"))
    several = left.where("all_a > 1 or all_b > 1").select(*subject)
    in_a, in_b = F.col("surplus") < 0, F.col("surplus") > 0
    one_sided = join_on(changed, several, subject, "left_semi").select(
        *subject, F.when(in_a, F.col("state")).alias("a"), F.when(in_b, F.col("state")).alias("b"), "rows_a", "rows_b"
    )
    # Two rows a subject at most, the older version's first.
    beside = Window.partitionBy(*subject).orderBy("surplus")
    paired = join_on(changed, several, subject, "left_anti").select(
        *subject, "surplus", "state", F.lead("state").over(beside).alias("following"), F.row_number().over(beside).alias("nth")
    ).where("nth = 1")
    b = F.when(in_a, F.col("following")).otherwise(F.col("state"))
    paired = paired.select(
        *subject, F.when(in_a, F.col("state")).alias("a"), b.alias("b"), in_a.cast("long").alias("rows_a"), b.isNotNull().cast("long").alias("rows_b")
    )
    both = paired.unionByName(one_sided)
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in STATE for s in ("a", "b")]
    zero = F.lit(0).cast(WIDE)
    held_a = F.coalesce(F.col("a.fte") * F.col("rows_a"), zero)
    held_b = F.coalesce(F.col("b.fte") * F.col("rows_b"), zero)
    out = both.select(
        "subject_key",
        F.when(F.col("subject_kind") == "employee", F.col("subject_key")).alias("employee_id"),
        F.when(F.col("subject_kind") == "container", F.col("subject_key")).alias("container_id"),
        *sides,
        (held_b - held_a).cast(WIDE).alias("fte_delta"),
        "rows_a",
        "rows_b",
    )
    return out.orderBy("subject_key") if ordered else out


def actuals_mom_delta(actuals: DataFrame, prev_run: str, curr_run: str) -> DataFrame:
    """FTE per cost centre of two import runs. Unchanged cost centres are listed too."""
    run = F.col("import_run_id")
    return (
        actuals.where(run.isin(prev_run, curr_run))
        .groupBy("costcenter_id")
        .agg(
            _sum_where(run == prev_run).alias("prev_fte"),
            _sum_where(run == curr_run).alias("curr_fte"),
        )
        .withColumn("delta_fte", _delta("curr_fte", "prev_fte"))
        .orderBy("costcenter_id")
    )


def actual_vs_forecast(actuals: DataFrame, entries: DataFrame, run: str, version: str, month) -> DataFrame:
    """Actual and planned FTE and heads per cost centre for one month."""
    columns = ["costcenter_id", "fte"]
    actual = actuals.where(F.col("import_run_id") == run).select(*columns, F.lit(True).alias("is_actual"))
    planned = asof(entries, month, version).select(*columns, F.lit(False).alias("is_actual"))
    is_actual = F.col("is_actual")
    return (
        actual.unionByName(planned)
        .groupBy("costcenter_id")
        .agg(
            _sum_where(is_actual).alias("actual_fte"),
            _sum_where(~is_actual).alias("forecast_fte"),
            F.count_if(is_actual).alias("actual_headcount"),
            F.count_if(~is_actual).alias("forecast_headcount"),
        )
        .withColumn("fte_delta", _delta("forecast_fte", "actual_fte"))
        .orderBy("costcenter_id")
    )


def chain_diff(entries: DataFrame, versions: DataFrame, start: str, month) -> DataFrame:
    """Cost-centre diffs of every neighbouring pair of versions along the chain.

    The table is read once and summed per version and cost centre; each sum then
    serves as the newer side of one pair and the older side of the next.
    """
    first = versions.where(F.col("id") == start).select(F.col("id").alias("start_id"))
    chain = version_chain(versions, first)
    newer, older = chain.alias("n"), chain.alias("o")
    pairs = newer.join(older, F.col("o.position") == F.col("n.position") + 1).select(
        F.col("n.position").alias("position"), F.col("o.id").alias("version_a"), F.col("n.id").alias("version_b")
    )
    roles = pairs.withColumn("is_b", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "version_id", F.when(F.col("is_b"), F.col("version_b")).otherwise(F.col("version_a"))
    )
    roles = broadcast_if_small(cut(roles.select("position", "version_a", "version_b", "is_b", "version_id")))
    ids = [r.version_id for r in roles.select("version_id").distinct().take(PRUNED_VERSIONS + 1)]
    if len(ids) <= PRUNED_VERSIONS:  # known ids prune the version partitions before the scan
        in_chain = asof(entries, month, ids)
    else:
        in_chain = asof(entries, month).join(roles, "version_id", "left_semi")
    sums = in_chain.groupBy("version_id", "costcenter_id").agg(F.sum("fte").alias("fte"))
    return (
        sums.join(roles, "version_id")
        .groupBy("position", "version_a", "version_b", "costcenter_id")
        .agg(_sum_where(~F.col("is_b")).alias("fte_version_a"), _sum_where(F.col("is_b")).alias("fte_version_b"))
        .where(distinct_from(F.col("fte_version_a"), F.col("fte_version_b")))
        .withColumn("fte_delta", _delta("fte_version_b", "fte_version_a"))
        .orderBy("position", "costcenter_id")
    )
