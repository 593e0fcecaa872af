"""The physical plans that the operators are meant to get."""

import re

import pytest
from pyspark.sql import functions as F

from headgrid.operators import audit, diff, quality, rollup, rules, scd2, snapshot, versions
from headgrid.plans.queries import NOW
from headgrid.sources import derived, tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    root = str(tmp_path_factory.mktemp("plans"))
    tables.write_table(derived.full_entries(spark, SMALL), root, "forecast_entries")
    return tables.read_table(spark, root, "forecast_entries")


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text), text
    return text


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def test_round_trip(spark, stored):
    rows = derived.full_entries(spark, SMALL)
    assert stored.select(*rows.columns).exceptAll(rows).isEmpty() and stored.count() == rows.count()


def test_snapshot_is_a_pruned_scan(stored):
    text = plan(snapshot.asof_snapshot(stored, "1998-10-01", "v4"))
    assert "Exchange" not in text
    assert re.search(r"PartitionFilters: \[[^\]]*version_id", text)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "LessThanOrEqual(valid_from" in pushed and "GreaterThan(valid_to" in pushed


def test_rollup_reads_four_columns_and_never_joins(stored):
    text = plan(rollup.monthly_rollup(stored, "1998-01-01", "1999-06-01", "v4", ordered=False))
    assert "Join" not in text and scans(text) == 1 and shuffles(text) == 2
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"costcenter_id", "fte", "valid_from", "valid_to", "is_deleted"}
    # Runs are summed before the months are unfolded: an aggregate below the generator.
    assert text.rindex("HashAggregate") > text.index("Generate")


@pytest.mark.parametrize("build", [
    lambda t: diff.diff_versions_by_cc(t, "v3", "v4", "1998-10-01"),
    lambda t: rollup.snapshot_by_cc(t, "1998-10-01", "v4"),
    lambda t: rollup.monthly_rollup_positive(t, "1998-01-01", "1999-06-01", "v4"),
])
def test_one_scan_and_no_join(stored, build):
    text = plan(build(stored))
    assert scans(text) == 1 and "Join" not in text


def test_chain_diff_prunes_versions(spark, stored):
    text = plan(diff.chain_diff(stored, derived.forecast_versions(spark, SMALL), "v4", "1998-10-01"))
    assert scans(text) == 1 and re.search(r"PartitionFilters: \[[^\]]*version_id#\d+ IN", text)


def test_partial_aggregation_before_every_shuffle(stored):
    for df in (diff.diff_versions_by_cc(stored, "v3", "v4", "1998-10-01"), quality.dq_overlap(stored), snapshot.asof_employee(stored, "1998-10-01", "v4")):
        assert "partial_" in plan(df)


def test_rollover_seed_has_no_shuffle(stored):
    assert "Exchange" not in plan(versions.seed_rows(stored, "v4", "v5", "1998-10-01", "u", NOW))


def test_apply_reads_open_rows_only(spark, stored):
    feed = derived.change_feed(derived.read(spark, SMALL, "events"))
    text = plan(scd2.scd2_apply(stored, feed).final)
    scan = next(line for line in text.splitlines() if "forecast_entries" in line and "FileScan" in line)
    assert "IsNull(valid_to)" in scan


def test_feed_takes_top_rows_before_the_join(spark, stored):
    log = spark.createDataFrame([], "id string, forecast_entry_id string, version_id string, action string, changed_by string, changed_at timestamp")
    text = plan(audit.audit_version_feed(log, stored, "v4", 50))
    assert "TakeOrderedAndProject(limit=50" in text or "LocalTableScan" in text


def test_foreign_key_values_are_counted_before_a_shuffled_join(spark, stored):
    centres = derived.costcenters(spark, SMALL)
    found = quality.dq_foreign_keys(stored, "costcenter_id", centres, "id", "r")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(found.select("*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.index("Join") < text.index("partial_count")


def test_all_rules_of_all_tables_take_one_shuffle(spark, stored):
    given = {"forecast_entries": stored, "costcenters": tables.conform(derived.costcenters(spark, SMALL), "costcenters")}
    text = plan(rules.check_rules(given))
    assert shuffles(text) == 1 and "Join" not in text and "SortAggregate" not in text, text


def test_unchanged_parts_are_not_shuffled(spark, stored):
    found = quality.dq_immutable(stored, stored, stored.columns, "version_id")
    assert "Exchange hashpartitioning" not in plan(found) and found.isEmpty()
    digests = plan(quality._part_digests(stored, "version_id", stored.columns, "old"))
    (exchange,) = re.findall(r"Exchange hashpartitioning\((\w+)#", digests)
    assert exchange == "part" and digests.index("partial_sum") > digests.index("Exchange") and "SortAggregate" not in digests, digests


def test_subject_diff_is_summed_by_hash_in_one_scan(spark, stored):
    found = diff.diff_versions_by_subject(stored, "v3", "v4", "1998-10-01")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows reuse before the run
        text = plan(found.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scans(text) == 1 and text.count("ReusedExchange") >= 2 and "SortAggregate" not in text, text


def test_audit_compares_digests_before_it_moves_columns(spark, stored):
    versions = [stored.where(F.col("version_id") == v).withColumn("id", F.expr("substr(id, 4)")) for v in ("v3", "v4")]
    narrow = audit._differing(*versions, "id", [c for c in audit.TRACKED if c in stored.columns])
    text = plan(narrow)
    (exchange,) = re.findall(r"Exchange hashpartitioning.*", text)
    (partial,) = re.findall(r"HashAggregate\(keys=\[key#\d+\], functions=\[partial_count.*", text)
    assert "bit_xor" in partial and "costcenter_id" not in partial and "SortAggregate" not in text, text


def test_overlap_shuffles_once_by_subject(spark, stored):
    text = plan(quality.dq_overlap(stored))
    assert shuffles(text) == 1 and "SortAggregate" not in text, text


def test_apply_sorts_twice_and_shuffles_once(spark):
    feed = derived.change_feed(derived.read(spark, SMALL, "events"))
    text = plan(scd2.scd2_apply(None, feed).final)
    assert shuffles(text) == 1 and len(re.findall(r"\bSort \[", text)) == 2


def test_no_explicit_broadcast_without_a_size_check():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "headgrid"
    # the corpus package has the same test of its own
    used = {p.name for p in root.rglob("*.py") if "llm" not in p.parts and "F.broadcast(" in p.read_text()}
    assert used == {"session.py", "audit.py"}  # both count or know the rows first
    assert not any("localCheckpoint" in p.read_text() for p in root.rglob("*.py"))
