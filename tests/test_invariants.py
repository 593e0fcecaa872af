"""Properties that hold for any table."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from headgrid.operators import diff, rollup, snapshot
from headgrid.sources import derived

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return derived.full_entries(spark, SMALL).cache()


@pytest.mark.parametrize("month", ["1998-01-01", "1998-07-01", "1999-06-01"])
def test_rollup_month_equals_snapshot(table, month):
    grid = rollup.monthly_rollup(table, "1998-01-01", "1999-06-01", "v4").where(F.col("month_start") == month).drop("month_start")
    at = rollup.snapshot_by_cc(table, month, "v4").select(*grid.columns)
    assert grid.exceptAll(at).isEmpty() and at.exceptAll(grid).isEmpty() and at.count() > 0


def test_grid_equals_rollup(table):
    grid = rollup.rollup_grid(table, "1998-01-01", "1998-03-01", "v4")
    cells = rollup.monthly_rollup(table, "1998-01-01", "1998-03-01", "v4").where("month_start = '1998-02-01'")
    wide = grid.where("heads_1998_02 is not null").select("costcenter_id", F.col("fte_1998_02").alias("total_fte"), F.col("heads_1998_02").alias("headcount"))
    assert wide.exceptAll(cells.drop("month_start").select(*wide.columns)).isEmpty() and wide.count() == cells.count()


def test_root_total_equals_reachable_leaves(spark, table):
    centres = derived.costcenters(spark, SMALL)
    rolled = rollup.hierarchy_rollup(table, centres, "1998-10-01", "v4")
    roots = rolled.join(centres.where("level = 1").select(F.col("id").alias("costcenter_id")), "costcenter_id").agg(F.sum("headcount")).first()[0]
    leaves = rolled.join(centres.where("level = 3").select(F.col("id").alias("costcenter_id")), "costcenter_id").agg(F.sum("headcount")).first()[0]
    assert roots == leaves > 0


def test_diff_with_itself_is_empty_and_diff_is_antisymmetric(table):
    assert diff.diff_versions_by_cc(table, "v3", "v3", "1998-10-01").isEmpty()
    assert diff.diff_versions_by_subject(table, "v3", "v3", "1998-10-01").isEmpty()
    ab = diff.diff_versions_by_cc(table, "v3", "v4", "1998-10-01").select("costcenter_id", "fte_delta")
    ba = diff.diff_versions_by_cc(table, "v4", "v3", "1998-10-01").select("costcenter_id", (-F.col("fte_delta")).cast("decimal(38,4)").alias("fte_delta"))
    assert ab.exceptAll(ba).isEmpty() and ab.count() > 0


def test_subject_deltas_add_up_even_with_overlaps(entries):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        version = rng.choice(["v1", "v2"])
        rows.append(dict(id=f"e{i}", version=version, employee=rng.choice("ABCDEFGH") + str(i % 9), cc=rng.choice(["c1", "c2"]), fte=rng.choice([0.25, 0.5, 1]), valid_from="2025-01"))
    table = entries(*rows)
    found = diff.diff_versions_by_subject(table, "v1", "v2", "2025-01-01")
    total = found.agg(F.sum("fte_delta")).first()[0]
    want = {v: sum(Decimal(str(r["fte"])) for r in rows if r["version"] == v) for v in ("v1", "v2")}
    assert total == want["v2"] - want["v1"]
    # Every state held more often on one side is listed with its surplus, and none twice.
    surplus = {}
    for r in rows:
        key = (r["employee"], r["cc"], Decimal(str(r["fte"])))
        surplus[key] = surplus.get(key, 0) + (1 if r["version"] == "v2" else -1)
    listed = {}
    for r in found.collect():
        for side, sign in (("a", -1), ("b", 1)):
            if r[f"rows_{side}"]:
                key = (r.subject_key, r[f"costcenter_id_{side}"], r[f"fte_{side}"])
                listed[key] = listed.get(key, 0) + sign * r[f"rows_{side}"]
    assert listed == {k: n for k, n in surplus.items() if n}


def test_asof_equals_brute_force(table):
    month = "1998-05-01"
    rows = [r for r in table.collect() if not r.is_deleted and str(r.valid_from) <= month and (r.valid_to is None or str(r.valid_to) > month)]
    assert snapshot.asof(table, month).count() == len(rows) > 0
