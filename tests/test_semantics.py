"""One small case per rule of the data model."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import NOW, day
from headgrid.functions import temporal
from headgrid.operators import audit, diff, hierarchy, lookup, quality, rollup, rules, scd2, snapshot, upsert, versions
from headgrid.schema import NOT_NULL, PRIMARY_KEY, TABLES, TEXT_LIMITS, UNIQUE_KEYS
from headgrid.sources import imports, tables

D = Decimal


def ids(df):
    return sorted(r.id for r in df.collect())


def test_validity_is_half_open(entries):
    rows = entries(dict(id="x", valid_from="2025-01", valid_to="2025-03"))
    assert [ids(snapshot.asof(rows, f"2025-0{m}-01")) for m in (1, 2, 3)] == [["x"], ["x"], []]


def test_soft_delete_hides_the_whole_interval(entries):
    rows = entries(dict(id="old", valid_from="2024-10", valid_to="2025-01"), dict(id="x", valid_from="2025-01", is_deleted=True))
    assert ids(snapshot.asof(rows, "2024-12-01")) == ["old"]
    assert ids(snapshot.asof(rows, "2025-01-01")) == []
    assert ids(snapshot.asof(rows, "2025-05-01")) == []


@pytest.mark.parametrize("month, reason", [("2025-04", "same_month"), ("2025-02", "backdated")])
def test_change_not_after_the_open_start_is_rejected(entries, changes, month, reason):
    stored = entries(dict(id="x", valid_from="2025-04"))
    done = scd2.scd2_apply(stored, changes((1, "set", month, "A", 0.5)))
    assert [r.reason for r in done.rejects.collect()] == [reason]
    assert done.inserted.isEmpty() and done.updated.isEmpty() and done.audit.isEmpty()
    after = done.merge_into(stored)
    assert after.exceptAll(stored).isEmpty() and stored.exceptAll(after).isEmpty()


def test_change_closes_and_opens(entries, changes):
    stored = entries(dict(id="x", valid_from="2025-01"))
    done = scd2.scd2_apply(stored, changes((1, "set", "2025-04", "A", 0.5)))
    after = {(r.valid_from, r.valid_to, r.fte) for r in done.merge_into(stored).collect()}
    assert after == {(day("2025-01"), day("2025-04"), D("1.0000")), (day("2025-04"), None, D("0.5000"))}
    actions = {(r.action, str(r.changed_fields)) for r in done.audit.collect()}
    assert {a for a, _ in actions} == {"INSERT", "UPDATE"}
    assert any("valid_to" in text and "2025-04-01" in text for _, text in actions)


def test_backdated_after_delete_is_accepted_and_overlaps(entries, changes):
    stored = entries(dict(id="x", valid_from="2025-01", valid_to="2025-04"), dict(id="y", valid_from="2025-04", is_deleted=True))
    done = scd2.scd2_apply(stored, changes((1, "set", "2025-02", "A", 0.5)))
    assert done.rejects.isEmpty()
    found = quality.dq_overlap(done.merge_into(stored)).collect()
    assert [(r.valid_from, r.n_rows, r.overlaps_from, r.overlaps_to) for r in found] == [(day("2025-02"), 1, day("2025-01"), day("2025-04"))]


def test_employee_and_container_are_separate_subjects(entries, changes):
    stored = entries(dict(id="x", employee="P1", valid_from="2025-01"), dict(id="y", container="P1", valid_from="2025-01"))
    done = scd2.scd2_apply(stored, changes((1, "set", "2025-03", "P1", 4)))
    assert ids(done.updated) == ["y"]
    assert done.inserted.first().container_id == "P1"


def test_invalid_changes_are_rejected_and_do_not_count(entries, changes):
    feed = changes((1, "set", "2025-03-15", "A", 1), (2, "set", "2025-02", "A", 1)).unionByName(
        changes((3, "set", "2025-03", "A", 1), actor=None)
    )
    done = scd2.scd2_apply(None, feed)
    assert sorted((r.seq, r.reason) for r in done.rejects.collect()) == [(1, "valid_from_not_month_start"), (3, "missing_actor")]
    assert [r.valid_from for r in done.inserted.collect()] == [day("2025-02")]


def test_rollover_copies_the_state_of_the_new_month(spark, entries):
    stored = entries(
        dict(id="x", valid_from="2025-01", valid_to="2025-09", fte=0.5, cc="c9"),
        dict(id="y", valid_from="2025-09", fte=1),
        dict(id="z", employee="B", valid_from="2025-01", is_deleted=True),
    )
    registry = spark.createDataFrame(
        [("v1", "2025-07", "working", 2025, 7, 18, None, None, None, "u", NOW)], TABLES["forecast_versions"]
    )
    done = versions.rollover(stored, registry, "2025-08", "2025-08-01", 18, "u", NOW)
    seeded = done.seeded.collect()
    assert [(r.version_id, r.valid_from, r.valid_to, r.fte, r.costcenter_id) for r in seeded] == [
        (done.version_id, day("2025-08"), None, D("0.5000"), "c9")
    ]
    assert ids(done.not_copied) == ["y"]
    assert [r.action for r in done.audit.collect()] == ["INSERT"]
    after = {r.id: r for r in done.versions.collect()}
    assert (after["v1"].status, after["v1"].archived_by, after["v1"].archived_at) == ("archived", "u", NOW)
    assert (after[done.version_id].status, after[done.version_id].source_version_id) == ("working", "v1")
    assert quality.dq_one_working(done.versions).isEmpty()
    again = versions.rollover(stored, registry, "2025-08", "2025-08-01", 18, "u", NOW)
    assert again.version_id == done.version_id


def test_version_life_cycle(spark):
    none = spark.createDataFrame([], TABLES["forecast_versions"])
    with pytest.raises(versions.NoWorkingVersion):
        versions.rollover(spark.createDataFrame([], TABLES["forecast_entries"]), none, "x", "2025-01-01", 18, "u", NOW)
    first = versions.get_or_create_working(none, "first", "2025-01-01", 18, "u", NOW)
    row = first.first()
    assert (row.status, row.source_version_id, row.fc_horizon_months) == ("working", None, 18)
    assert versions.get_or_create_working(first, "other", "2025-02-01", 18, "u", NOW).count() == 1
    archived = versions.archive_version(first, row.id, "u", NOW)
    with pytest.raises(versions.NotWorking):
        versions.archive_version(archived, row.id, "u", NOW)
    with pytest.raises(ValueError):
        versions.new_version(none, "x", "2025-01-01", 61, "u", NOW, None)
    assert lookup.working_version(archived).isEmpty()
    twice = first.unionByName(first.withColumn("id", F.lit("other")))
    assert quality.dq_one_working(twice).first().n_rows == 2
    with pytest.raises(ValueError):
        versions.working_row(twice)


def test_month_grid_is_inclusive(spark):
    one = spark.createDataFrame([(day("2025-01"), day("2026-06")), (day("2025-02"), day("2025-01"))], "a date, b date")
    assert snapshot.month_spine(one, "a", "b").count() == 18
    assert temporal.horizon_end("2025-01-01", 18) == dt.date(2026, 6, 1)
    assert temporal.horizon_end("2025-01-01", 12) == dt.date(2025, 12, 1)
    with pytest.raises(ValueError):
        temporal.month_date("2025-01-31")


def test_rollup_skips_empty_months_and_counts_containers(entries):
    rows = entries(
        dict(valid_from="2025-01", valid_to="2025-02"),
        dict(valid_from="2025-03", valid_to="2025-03-15"),
        dict(container="P1", fte=3, valid_from="2025-03", valid_to="2025-04"),
        dict(container="P2", fte=-1, cc="c2", valid_from="2025-03"),
    )
    got = [(r.month_start.month, r.costcenter_id, r.total_fte, r.headcount) for r in rollup.monthly_rollup(rows, "2025-01-01", "2025-04-01", "v1").collect()]
    assert got == [(1, "c1", D("1"), 1), (3, "c1", D("4"), 2), (3, "c2", D("-1"), 1), (4, "c2", D("-1"), 1)]
    positive = rollup.monthly_rollup_positive(rows, "2025-01-01", "2025-04-01", "v1").collect()
    assert [(r.month_start.month, r.headcount) for r in positive] == [(1, 1), (3, 1)]
    assert rollup.monthly_rollup(rows, "2025-04-01", "2025-01-01", "v1").isEmpty()


def test_mid_month_bounds(entries):
    rows = entries(dict(id="x", valid_from="2025-01", valid_to="2025-03-15"), dict(id="y", employee="B", valid_from="2025-01-15", valid_to="2025-01-20"))
    assert ids(snapshot.asof(rows, "2025-03-01")) == ["x"]
    got = rollup.monthly_rollup(rows, "2024-12-01", "2025-06-01", "v1").collect()
    assert [(r.month_start.month, r.headcount) for r in got] == [(1, 1), (2, 1), (3, 1)]


def test_cc_diff_tells_zero_from_none(entries):
    rows = entries(dict(container="P1", fte=1, valid_from="2025-01"), dict(container="P2", fte=-1, valid_from="2025-01"), dict(cc="c2", valid_from="2025-01"), dict(cc="c2", version="v2", valid_from="2025-01"))
    got = diff.diff_versions_by_cc(rows, "v1", "v2", "2025-01-01").collect()
    assert [(r.costcenter_id, r.fte_version_a, r.fte_version_b, r.fte_delta) for r in got] == [("c1", D("0"), None, D("0"))]


def test_subject_diff_compares_four_attributes(entries):
    rows = entries(
        dict(employee="A", valid_from="2025-01"), dict(employee="A", version="v2", last_name="Z", valid_from="2025-01"),
        dict(employee="B", version="v2", fte=0.5, valid_from="2025-01"),
        dict(employee="C", valid_from="2025-01"), dict(employee="C", version="v2", grp="g", valid_from="2025-01"),
    )
    got = {r.subject_key: r for r in diff.diff_versions_by_subject(rows, "v1", "v2", "2025-01-01").collect()}
    assert set(got) == {"B", "C"}
    assert (got["B"].costcenter_id_a, got["B"].fte_a, got["B"].fte_delta, got["B"].rows_a) == (None, None, D("0.5"), 0)
    assert (got["C"].employee_group_id_a, got["C"].employee_group_id_b, got["C"].fte_delta) == (None, "g", D("0"))


def test_month_over_month_lists_unchanged(spark):
    actuals = spark.createDataFrame([("r1", "c1", D("1")), ("r2", "c1", D("1")), ("r2", "c2", D("2"))], "import_run_id string, costcenter_id string, fte decimal(6,4)")
    got = [(r.costcenter_id, r.prev_fte, r.curr_fte, r.delta_fte) for r in diff.actuals_mom_delta(actuals, "r1", "r2").collect()]
    assert got == [("c1", D("1"), D("1"), D("0")), ("c2", None, D("2"), D("2"))]


def test_soft_delete_audit_and_restore(spark, entries):
    stored = entries(dict(id="x", valid_from="2025-01", valid_to="2025-04"), dict(id="y", valid_from="2025-04"), dict(id="z", employee="B", valid_from="2025-04"))
    asked = spark.createDataFrame([("v1", "A", None, "u", NOW), ("v1", "Q", None, "u", NOW), ("v1", "B", None, None, NOW)], "version_id string, employee_id string, container_id string, deleted_by string, deleted_at timestamp")
    gone = scd2.soft_delete(stored, asked)
    assert ids(gone.after) == ["y"]
    assert sorted((r.employee_id, r.reason) for r in gone.refused.collect()) == [("B", "missing_actor"), ("Q", "no_open_row")]
    record = audit.audit_diff(gone.before, gone.after, "u", F.lit(NOW)).collect()
    assert [(r.action, {k: (v.old, v.new) for k, v in r.changed_fields.items()}) for r in record] == [("DELETE", {"is_deleted": ("false", "true")})]
    table = gone.merge_into(stored)
    back = scd2.restore(table, spark.createDataFrame([("y",), ("x",)], "id string"))
    assert ids(back.after) == ["y"]
    assert [(r.id, r.reason) for r in back.refused.collect()] == [("x", "not_deleted")]
    assert back.after.first().deleted_by is None
    assert audit.audit_diff(back.before, back.after, "u", F.lit(NOW)).first().action == "RESTORE"
    assert back.merge_into(table).exceptAll(stored).isEmpty()


def test_restore_refuses_when_an_open_row_exists(spark, entries):
    stored = entries(dict(id="x", valid_from="2025-01", is_deleted=True), dict(id="y", valid_from="2025-02"), dict(id="p", employee="B", valid_from="2025-01", is_deleted=True), dict(id="q", employee="B", valid_from="2025-03", is_deleted=True))
    back = scd2.restore(stored, spark.createDataFrame([("x",), ("p",), ("q",)], "id string"))
    assert ids(back.after) == ["q"]
    assert sorted((r.id, r.reason) for r in back.refused.collect()) == [("p", "later_row_restored"), ("x", "open_row_exists")]


def test_audit_skips_no_ops_and_untracked_columns(entries):
    before = entries(dict(id="x", valid_from="2025-01"), dict(id="y", employee="B", valid_from="2025-01"))
    after = before.withColumn("created_by", F.lit("other")).withColumn("fte", F.when(F.col("id") == "y", F.lit(D("0.5"))).otherwise(F.col("fte")))
    got = audit.audit_diff(before, after, "u", F.lit(NOW)).collect()
    assert [(r.forecast_entry_id, r.action, dict(r.changed_fields)["fte"].new) for r in got] == [("y", "UPDATE", "0.5000")]


def test_audit_sees_a_value_move_between_columns(entries):
    """Swapped NULLs hash alike unless each column goes with a flag."""
    before = entries(dict(id="a", valid_from="2024-01", cls="x"), dict(id="b", valid_from="2024-01"))
    after = entries(dict(id="a", valid_from="2024-01", grp="x"), dict(id="b", valid_from="2024-01"))
    (record,) = audit.audit_diff(before, after, "u", F.lit(NOW)).collect()
    assert record.forecast_entry_id == "a" and set(record.changed_fields) == {"classification_id", "employee_group_id"}


def test_audit_keeps_removed_rows(entries):
    before = entries(dict(id="x", valid_from="2025-01"), dict(id="y", employee="B", valid_from="2025-01"))
    (got,) = audit.audit_diff(before, before.where("id = 'x'"), "u", F.lit(NOW)).collect()
    assert (got.forecast_entry_id, got.version_id, got.action) == ("y", "v1", "DELETE")
    (change,) = got.changed_fields.values()
    row = json.loads(change.old)
    assert set(row) == set(before.columns) and (row["employee_id"], row["valid_to"], change.new) == ("B", None, None)


def test_audit_needs_an_actor(entries):
    rows = entries(dict(id="x", valid_from="2025-01"))
    with pytest.raises(Exception, match="actor"):
        audit.audit_diff(rows.limit(0), rows, F.lit(None).cast("string"), F.lit(NOW)).collect()


def test_audit_json_keeps_nulls(entries, changes):
    stored = entries(dict(id="x", valid_from="2025-01"))
    done = scd2.scd2_apply(stored, changes((1, "set", "2025-04", "A", 0.5)))
    text = audit.changed_fields_json(done.audit.where("action = 'UPDATE'"))
    assert text.first().changed_fields == '{"valid_to":{"old":null,"new":"2025-04-01"}}'
    row = audit.audit_explode(text).first()
    assert (row.field, row.old, row.new) == ("valid_to", None, "2025-04-01")


def test_upsert_keeps_the_description(spark):
    config = tables.seed_system_config(spark, NOW).withColumn("description", F.lit("first"))
    later = NOW + dt.timedelta(days=1)
    batch = spark.createDataFrame(
        [("fc_lock_day", "5", "second", "u", 1), ("fc_lock_day", "7", "third", "u", 2), ("new", "1", "n", None, 3)],
        "key string, value string, description string, updated_by string, seq int",
    )
    got = {r.key: r for r in upsert.upsert_system_config(config, batch, later, "seq").collect()}
    assert (got["fc_lock_day"].value, got["fc_lock_day"].description, got["fc_lock_day"].updated_at) == ("7", "first", later)
    assert (got["new"].value, got["new"].description) == ("1", "n")
    assert (got["fc_horizon_months"].value, got["fc_horizon_months"].updated_at) == ("18", NOW)


def test_any_run_blocks_a_period(spark):
    runs = spark.createDataFrame([("r", 2025, 7, "failed", 0, None, "u", NOW)], TABLES["import_runs"])
    rows = spark.createDataFrame([("A", "c1", D("1"))], "employee_id string, costcenter_id string, fte decimal(6,4)")
    with pytest.raises(imports.PeriodExists):
        imports.import_month(runs, rows, 2025, 7, "u", NOW)
    load = imports.import_month(runs, rows, 2025, 8, "u", NOW, "file.json")
    head = load.runs.first()
    assert (head.period_month, head.row_count, head.status, head.source_file) == (8, 1, "completed", "file.json")
    assert load.actuals.first().import_run_id == head.id


def test_next_period_carries_the_year(spark):
    got = versions.next_period(spark.createDataFrame([(2025, 12), (2025, 1)], "period_year int, period_month int")).collect()
    assert [(r.next_year, r.next_month) for r in got] == [(2026, 1), (2025, 2)]


def test_asof_order_puts_employees_first(entries):
    rows = entries(dict(id="p", container="P1", valid_from="2025-01"), dict(id="b", employee="B", valid_from="2025-01"), dict(id="a", employee="A", valid_from="2025-01"))
    assert [r.id for r in snapshot.asof_snapshot(rows, "2025-01-01", "v1", ordered=True).collect()] == ["a", "b", "p"]


def test_asof_of_listed_subjects(spark, entries):
    rows = entries(dict(id="a2", valid_from="2025-02"), dict(id="a1", valid_from="2025-01"), dict(id="b", employee="B", valid_from="2025-01"))
    got = snapshot.asof_employee(rows, "2025-02-01", "v1", spark.createDataFrame([("A",)], "employee_id string"))
    assert ids(got) == ["a1"]


def test_rules_find_planted_violations(spark, entries):
    bad = entries(
        dict(id="same", valid_from="2025-01", valid_to="2025-01"), dict(id="mid", employee="B", valid_from="2025-01-02"),
        dict(id="dup", employee="C", valid_from="2025-01"), dict(id="dup", employee="D", valid_from="2025-01"),
        dict(id="long", employee="E", first_name="x" * 256, valid_from="2025-01"),
    )
    got = {(r.rule, r.key) for r in rules.check_table("forecast_entries", bad).collect()}
    assert got == {("end_after_start", "same"), ("start_on_first", "mid"), ("unique_id", "dup"), ("first_name_length", "long")}
    good = entries(dict(id="x", valid_from="2025-01", valid_to="2025-02"), dict(id="y", valid_from="2025-02"))
    registry = spark.createDataFrame([("v1", "l", "working", 2025, 1, 18, None, None, None, "u", NOW)], TABLES["forecast_versions"])
    assert rules.check_all({"forecast_entries": good, "forecast_versions": registry}).isEmpty()
    orphan = good.withColumn("version_id", F.lit("v9"))
    assert [(r.table, r.key, r.n_rows) for r in rules.check_references({"forecast_entries": orphan, "forecast_versions": registry}).collect()] == [("forecast_entries", "v9", 2)]


def test_archive_rule(spark):
    rows = [("a", "archived", NOW, "u"), ("b", "archived", None, None), ("c", "working", NOW, "u"), ("d", "working", None, None), ("e", "archived", NOW, None)]
    registry = spark.createDataFrame([(i, "l", s, 2025, 1, 18, None, at, by, "u", NOW) for i, s, at, by in rows], TABLES["forecast_versions"])
    found = {r.key for r in quality.dq_checks(registry, rules.table_conditions("forecast_versions", registry.columns)).collect()}
    assert found == {"b", "c", "e"}


def test_immutable_tables(spark, entries, changes):
    before = entries(dict(id="x", valid_from="2025-01"))
    more = before.unionByName(entries(dict(id="y", valid_from="2025-01")))
    assert quality.dq_immutable(before, more, before.columns).isEmpty()
    assert quality.dq_immutable(more, before, before.columns).count() == 1
    log = scd2.scd2_apply(before, changes((1, "set", "2025-04", "A", 1))).audit
    assert quality.dq_immutable(log, log, log.columns).isEmpty()


def test_immutable_by_part(spark):
    schema = "run string, v string"
    before = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("b", None), (None, "3"), ("c", "4")], schema)

    def lost(*rows):
        after = spark.createDataFrame(rows, schema)
        return sorted((tuple(r) for r in quality.dq_immutable(before, after, before.columns, "run").collect()), key=str)

    same = [tuple(r) for r in before.collect()]
    assert lost(*same) == [] and lost(*same, ("a", "9"), ("d", "1")) == []
    # an exclusive or would not see that one pair of equal rows takes the place of another
    assert lost(("a", "5"), ("a", "5"), *same[2:]) == [("a", "1"), ("a", "1")]
    assert lost(*same[1:4], ("c", "4")) == sorted([("a", "1"), (None, "3")], key=str)
    assert lost(*same[:3], ("b", ""), *same[4:]) == [("b", None)]
    assert len(lost()) == 6


@pytest.mark.parametrize("name", TABLES)
def test_every_key_length_and_missing_value_is_found(spark, name):
    """A row of NULLs, and two equal rows of too long texts."""
    types = TABLES[name]
    columns = [f for f in types.fields if f.dataType.simpleString() == "string"]
    filled = tuple("x" * 600 if f in columns else None for f in types.fields)
    table = spark.createDataFrame([filled, filled, (None,) * len(types)], types)
    found = {r.rule: r.n_rows for r in rules.check_table(name, table).collect()}
    assert {f"{c}_not_null" for c in NOT_NULL[name]} <= set(found)
    assert {f"{c}_length" for c in TEXT_LIMITS.get(name, {})} <= set(found)
    assert {"unique_" + "_".join(k) for k in [[PRIMARY_KEY[name]], *UNIQUE_KEYS.get(name, [])]} <= set(found)
    assert found[f"{PRIMARY_KEY[name]}_not_null"] == 1


def test_overlap_of_equal_starts_and_long_reach(entries):
    rows = entries(
        dict(id="a", valid_from="2025-01"), dict(id="b", valid_from="2025-01", valid_to="2025-02"), dict(id="c", valid_from="2025-06", valid_to="2025-07"),
        dict(id="d", valid_from="2025-03", is_deleted=True), dict(id="e", employee="B", valid_from="2025-01", valid_to="2025-02"), dict(id="f", employee="B", valid_from="2025-02"),
    )
    got = [(r.valid_from.month, r.n_rows, r.overlaps_from, r.overlaps_to) for r in quality.dq_overlap(rows).orderBy("valid_from").collect()]
    assert got == [(1, 2, day("2025-01"), None), (6, 1, day("2025-01"), None)]


def test_resolve_codes_keeps_unknown(spark):
    centres = spark.createDataFrame([("1", "K1")], "id string, code string")
    rows = spark.createDataFrame([("K1",), ("K2",)], "code string")
    assert {(r.code, r.cc) for r in lookup.resolve_codes(rows, centres, "code", "cc").collect()} == {("K1", "1"), ("K2", None)}


def test_config_values_are_cast(spark):
    config = tables.seed_system_config(spark, NOW)
    assert config.where("description is null").isEmpty()
    assert lookup.config_value(config, "fc_horizon_months", "int").first().value == 18
    assert lookup.config_value(config, "import_source_label", "int").first().value is None
    assert lookup.config_value(config, "nothing").isEmpty()


def test_listings(spark):
    assert [r.code for r in lookup.list_lookups(tables.seed_classification_types(spark)).collect()] == ["direct", "indirect", "overhead", "contractor"]
    assert [r.code for r in lookup.list_lookups(tables.seed_employee_groups(spark)).collect()][0] == "EG_EXEC"
    runs = spark.createDataFrame([("a", 2024, 12, "completed"), ("b", 2025, 2, "failed"), ("c", 2025, 1, "completed")], "id string, period_year int, period_month int, status string")
    assert [r.id for r in lookup.list_import_runs(runs).collect()] == ["b", "c", "a"]
    assert lookup.latest_completed_run(runs).first().id == "c"


def node(i, parent=None, active=True):
    return (i, f"K-{i}", f"name {i}", 1, parent, active)


NODE = "id string, code string, name string, level int, parent_id string, is_active boolean"


def test_inactive_nodes_hide_their_subtree(spark):
    nodes = spark.createDataFrame([node("r"), node("a", "r", False), node("b", "a"), node("c", "b"), node("d", "r")], NODE)
    tree = hierarchy.hierarchy_tree(nodes).collect()
    assert [(r.id, r.depth, r.path_ids) for r in tree] == [("r", 0, ["r"]), ("d", 1, ["r", "d"])]
    roots = spark.createDataFrame([("b",), ("a",)], "root_id string")
    assert [(r.root_id, r.id) for r in hierarchy.hierarchy_descendants(nodes, roots).collect()] == [("b", "b"), ("b", "c")]


def test_tree_walk_survives_a_cycle(spark):
    nodes = spark.createDataFrame([node("a", "b"), node("b", "a")], NODE)
    assert hierarchy.hierarchy_tree(nodes).isEmpty()
    got = hierarchy.hierarchy_descendants(nodes, spark.createDataFrame([("a",)], "root_id string"))
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_version_chain(spark):
    n = 300
    links = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)], "id string, source_version_id string")
    starts = spark.createDataFrame([(str(n - 1),), ("7",), ("nobody",)], "start_id string")
    got = hierarchy.version_chain(links, starts).collect()
    assert {(r.start_id, r.id, r.position) for r in got} == {(str(n - 1), str(i), n - i) for i in range(n)} | {("7", str(i), 8 - i) for i in range(8)}
    assert len(got) == n + 8


def test_a_ring_is_found_in_two_rounds(spark, monkeypatch):
    """However many links there are; a ring that no start leads to is no error."""
    pairs = [(f"{i}", f"{i - 1}" if i else None) for i in range(2_000)] + [("a", "b"), ("b", "a"), ("c", "a"), ("own", "own")]
    links = spark.createDataFrame(pairs, "id string, source_version_id string")
    rounds = []
    keep = hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(1) or keep(df))
    for start, most in (("a", 2), ("own", 1), ("c", 2)):
        rounds.clear()
        with pytest.raises(ValueError, match="cycle"):
            hierarchy.version_chain(links, spark.createDataFrame([(start,)], "start_id string"))
        assert len(rounds) - 1 <= most, (start, len(rounds))
    got = hierarchy.version_chain(links, spark.createDataFrame([("3",)], "start_id string"))
    assert {(r.id, r.position) for r in got.collect()} == {("3", 1), ("2", 2), ("1", 3), ("0", 4)}


def test_nodes_that_the_tree_does_not_reach(spark):
    nodes = [node("r", None), node("x", "r"), node("off", "r", active=False), node("u", "off"), node("w", "u"), node("m", "gone"), node("n", "m"),
             node("a", "b"), node("b", "a"), node("c", "a"), node("own", "own"), *[node(f"d{i}", f"d{i - 1}" if i else "c") for i in range(9)]]
    found = {r.id: r.reason for r in hierarchy.hierarchy_problems(spark.createDataFrame(nodes, NODE)).collect()}
    assert found == {**dict.fromkeys("uw", "inactive_ancestor"), **dict.fromkeys("mn", "missing_parent"),
                     **dict.fromkeys(["a", "b", "c", "own", *[f"d{i}" for i in range(9)]], "cycle")}
    reached = {r.id for r in hierarchy.hierarchy_tree(spark.createDataFrame(nodes, NODE)).collect()}
    assert reached == {"r", "x"} and not reached & set(found)


def test_overlap_of_a_hot_subject_in_blocks(spark):
    """One subject holds a third of the rows; blocks of 40 rows give what one block gives, and what all pairs give."""
    rng = random.Random(4)
    first = dt.date(1969, 1, 1)
    rows = []
    for i in range(900):
        begin = first + dt.timedelta(days=rng.randrange(700))
        until = rng.choice([None] + [begin + dt.timedelta(days=rng.randrange(1, 30))] * 60)
        rows.append((f"e{i}", "H" if i % 3 == 0 else f"s{rng.randrange(200)}", begin, until))
    table = spark.createDataFrame(rows, "id string, employee_id string, valid_from date, valid_to date").selectExpr(
        "*", "'v1' as version_id", "cast(null as string) as container_id", "false as is_deleted")
    plain, cut_up = quality.dq_overlap(table).collect(), quality.dq_overlap(table, split_rows=40).collect()
    assert sorted(map(str, plain)) == sorted(map(str, cut_up))
    far = dt.date(9999, 12, 31)
    want = set()
    for _, who, begin, _ in rows:
        mine = [(u or far, b) for _, w, b, u in rows if w == who]
        reach = max((x for x in mine if x[1] < begin), default=None)
        here = [u for u, b in mine if b == begin]
        if reach and reach[0] > begin:
            want.add((who, begin, len(here), reach[1], None if reach[0] == far else reach[0]))
        elif len(here) > 1:
            want.add((who, begin, len(here), begin, None if max(here) == far else max(here)))
    assert {(r.subject_key, r.valid_from, r.n_rows, r.overlaps_from, r.overlaps_to) for r in plain} == want and len(plain) == len(want)


def test_upsert_of_a_repeated_new_key_is_one_after_the_other(spark):
    config = spark.createDataFrame([("known", "1", "kept")], "key string, value string, description string")
    batch = spark.createDataFrame(
        [("new", "zzz", "first desc", 1), ("new", "aaa", "second desc", 2), ("known", "9", "other", 1), ("known", "5", "more", 2)],
        "key string, value string, description string, seq long",
    )
    got = {r.key: (r.value, r.description) for r in upsert.upsert(config, batch, "key", ["value"], "seq").collect()}
    assert got == {"new": ("aaa", "first desc"), "known": ("5", "kept")}


def test_two_working_versions_are_an_error(spark):
    two = spark.createDataFrame([("a", "working"), ("b", "working")], "id string, status string")
    with pytest.raises(Exception, match="more than one working version"):
        lookup.working_version(two).collect()


def test_repeated_keys_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    rows = [(i, "x") for i in range(1000)] + [(5, "x")] + [(None, None)] * 40 + [(None, "x"), (3, None)] + [(7, "y")] * 60
    table = spark.createDataFrame(rows, "a int, b string")
    monkeypatch.setattr(quality, "KEY_ROWS", 100)
    found = quality.dq_unique(table, "r", ["a", "b"])
    assert sorted(tuple(r) for r in found.collect()) == [("r", "-/-", 40), ("r", "5/x", 2), ("r", "7/y", 60)]
    text = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert ", 12), REPARTITION_BY_NUM" in text and text.rindex("HashAggregate") < text.index("REPARTITION_BY_NUM")
    assert quality.dq_unique(table.limit(0), "r", ["a"]).collect() == []
    assert quality.dq_unique(table, "r", ["b"], sizes=spark.range(1)).count() == 3
