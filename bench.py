"""Headline queries over staged tables; prints one JSON line.

The planning tables are derived from the Parquet files of ``BENCH_SF_DIR`` and written
in their layout first (``staging``, not part of ``value``). Each query then runs over
the stored tables, once to warm up and ``BENCH_RUNS`` times measured; the median counts.
``BENCH_COPIES=n`` multiplies the subjects of the forecast table by n.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

from pyspark.sql import functions as F

from headgrid.operators import audit, diff, hierarchy, quality, rollup, scd2, snapshot, versions
from headgrid.plans.queries import END, MONTH, NOW, START
from headgrid.session import local_session, shared_dir
from headgrid.sources import derived, tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def stage(spark, root: str) -> None:
    entries = derived.full_entries(spark, SF_DIR)
    if COPIES > 1:
        copy = F.lpad(F.col("copy").cast("string"), 6, "0")
        entries = (
            entries.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
            .withColumns({c: F.concat_ws(".", F.col(c), copy) for c in ("id",)})
            .withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.col(c), copy)) for c in ("employee_id", "container_id")})
            .drop("copy")
        )
    tables.write_table(entries, root, "forecast_entries")
    actuals = derived.employee_actuals(spark, SF_DIR).withColumns({c: F.col("employee_id") for c in ("first_name", "last_name")})
    tables.write_table(actuals, root, "employee_actuals")
    tables.write_table(derived.costcenters(spark, SF_DIR), root, "costcenters")
    tables.write_table(derived.forecast_versions(spark, SF_DIR), root, "forecast_versions")
    derived.change_feed(derived.read(spark, SF_DIR, "events")).write.parquet(f"{root}/feed")


def headline(spark, root: str):
    entries = tables.read_table(spark, root, "forecast_entries")
    actuals = tables.read_table(spark, root, "employee_actuals")
    centres = tables.read_table(spark, root, "costcenters")
    registry = tables.read_table(spark, root, "forecast_versions")
    feed = spark.read.parquet(f"{root}/feed")
    return {
        "monthly_rollup": lambda: rollup.monthly_rollup(entries, START, END, "v4"),
        "asof_snapshot": lambda: snapshot.asof_snapshot(entries, MONTH, "v4"),
        "diff_versions_by_cc": lambda: diff.diff_versions_by_cc(entries, "v3", "v4", MONTH),
        "diff_versions_by_subject": lambda: diff.diff_versions_by_subject(entries, "v3", "v4", MONTH),
        "actuals_mom_delta": lambda: diff.actuals_mom_delta(actuals, "RUN-1998-09", "RUN-1998-10"),
        "actual_vs_forecast": lambda: diff.actual_vs_forecast(actuals, entries, "RUN-1998-10", "v4", MONTH),
        "chain_diff": lambda: diff.chain_diff(entries, registry, "v4", MONTH),
        "hierarchy_tree": lambda: hierarchy.hierarchy_tree(centres),
        "hierarchy_rollup": lambda: rollup.hierarchy_rollup(entries, centres, MONTH, "v4"),
        "rollup_grid": lambda: rollup.rollup_grid(entries, START, END, "v4"),
        "scd2_apply": lambda: scd2.scd2_apply(None, feed).final,
        "rollover_seed": lambda: versions.seed_rows(entries, "v4", "v5", MONTH, "planner", NOW),
        "audit_diff": lambda: audit.audit_explode(
            audit.audit_diff(
                *[entries.where(F.col("version_id") == v).withColumn("id", F.expr("substr(id, 4)")) for v in ("v3", "v4")],
                "planner",
                F.lit(NOW),
            )
        ),
        "dq_overlap": lambda: quality.dq_overlap(entries),
    }


def run(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "headgrid-bench")
    root = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    start = time.perf_counter()
    stage(spark, root)
    staging = time.perf_counter() - start
    wanted = sys.argv[1:]
    times = {}
    for name, build in headline(spark, root).items():
        if wanted and name not in wanted:
            continue
        run(build)
        times[name] = round(statistics.median(run(build) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "copies": COPIES,
                "staging": round(staging, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
